"""Group-fairness metrics (F1-F15) from one contingency aggregate.

Every metric is derived from integer counts per (audit keys, group):
``n`` rows, ``n_pred_pos`` predicted favourable, ``n_pos`` / ``n_neg`` true
labels, ``n_tp`` / ``n_fp``. The counts are computed in a single
``groupBy().agg()`` (partial aggregation map-side, so a group holding a third
of all rows costs one partial row per task), and ratios are taken last with a
null-on-zero division. Several audits (``by`` keys, several attributes) share
that one scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritylab.functions.keys import composite_key
from paritylab.functions.stats import parity_p_value

COUNT_COLS = ("n", "n_pred_pos", "n_pos", "n_neg", "n_tp", "n_fp")
METRIC_COLS = ("spd", "di", "eod", "aod")

# Metric names used in long-format results and rule evaluation.
METRIC_NAMES = {
    "spd": "Statistical Parity Difference",
    "di": "Disparate Impact",
    "eod": "Equal Opportunity Difference",
    "aod": "Average Odds Difference",
}


def ratio(num, den) -> Column:
    """num / den as double; NULL when the denominator is 0 or NULL."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contingency_aggs(label=None, pred=None) -> list[Column]:
    """Aggregate expressions for the shared contingency counts."""
    pred_c = _as_col(pred) if pred is not None else None
    label_c = _as_col(label) if label is not None else None
    aggs = [F.count(F.lit(1)).alias("n")]
    if pred_c is not None:
        aggs.append(F.count_if(pred_c == 1).alias("n_pred_pos"))
    if label_c is not None:
        aggs.append(F.count_if(label_c == 1).alias("n_pos"))
        aggs.append(F.count_if(label_c == 0).alias("n_neg"))
        if pred_c is not None:
            aggs.append(F.count_if((label_c == 1) & (pred_c == 1)).alias("n_tp"))
            aggs.append(F.count_if((label_c == 0) & (pred_c == 1)).alias("n_fp"))
    return aggs


def contingency(df: DataFrame, group, label=None, pred=None, by: Sequence[str] = ()) -> DataFrame:
    """Counts per (by..., group); null groups are excluded."""
    g = _as_col(group)
    return (df.where(g.isNotNull())
              .groupBy(*by, g.alias("group"))
              .agg(*contingency_aggs(label, pred)))


def role_expr(sens, privileged, unprivileged=None) -> Column:
    """'privileged' / 'unprivileged' / NULL (F1 relevant-group filter)."""
    s = _as_col(sens)
    if unprivileged is None:
        unpriv = s.isNotNull() & (s != F.lit(privileged))
    else:
        unpriv = s.isin(list(unprivileged))
    return (F.when(s == F.lit(privileged), F.lit("privileged"))
             .when(unpriv, F.lit("unprivileged")))


def _rates(prefix: str = "") -> list[Column]:
    p = prefix
    return [
        ratio(f"{p}n_pred_pos", f"{p}n").alias(f"{p}rate"),
        ratio(f"{p}n_tp", f"{p}n_pos").alias(f"{p}tpr"),
        ratio(f"{p}n_fp", f"{p}n_neg").alias(f"{p}fpr"),
    ]


def metrics_from_rates(u: str = "u_", p: str = "p_", families: str = "all") -> list[Column]:
    out = []
    if families in ("all", "parity", "1"):
        out += [
            (F.col(f"{u}rate") - F.col(f"{p}rate")).alias("spd"),
            F.when(F.col(f"{p}rate") != 0, F.col(f"{u}rate") / F.col(f"{p}rate")).alias("di"),
        ]
    if families in ("all", "odds", "2"):
        out += [
            (F.col(f"{u}tpr") - F.col(f"{p}tpr")).alias("eod"),
            (F.lit(0.5) * ((F.col(f"{u}fpr") - F.col(f"{p}fpr"))
                           + (F.col(f"{u}tpr") - F.col(f"{p}tpr")))).alias("aod"),
        ]
    return out


def _with_roles(counts: DataFrame, by: Sequence[str], group_col: str) -> DataFrame:
    """Attach privileged-side counts to every row of a small count table.

    The count table has one row per group, so the window below runs over
    (#audits x #groups) rows, never over data rows.
    """
    w = Window.partitionBy(*[F.col(b) for b in by]) if by else Window.partitionBy(F.lit(0))
    cols = [F.col(c) for c in counts.columns]
    for c in ("n", "n_pred_pos", "n_pos", "n_neg", "n_tp", "n_fp"):
        if c in counts.columns:
            cols.append(F.max(F.when(F.col("is_priv"), F.col(c))).over(w).alias(f"p_{c}"))
    return counts.select(*cols)


def fairness_metrics(df: DataFrame, sens, privileged, label=None, pred=None,
                     unprivileged: Sequence | None = None, mode: str = "combined",
                     by: Sequence[str] = (), families: str = "all",
                     with_counts: bool = False) -> DataFrame:
    """SPD, DI (on ``pred``) and EOD, AOD (on ``label`` vs ``pred``).

    mode="combined": privileged vs the pooled unprivileged set, one row per
    ``by`` key. mode="individual": one row per unprivileged value.
    Without ``pred`` the parity metrics are taken over the true labels (F8).
    """
    if pred is None or label is None:
        families = "parity"
        pred = pred if pred is not None else label
        label = pred
    by = list(by)
    s = _as_col(sens)
    if mode == "combined":
        group = role_expr(sens, privileged, unprivileged)
        priv_key = "privileged"
    elif mode == "individual":
        keep = s.isNotNull() if unprivileged is None else (
            (s == F.lit(privileged)) | s.isin(list(unprivileged)))
        group = F.when(keep, s)
        priv_key = privileged
    else:
        raise ValueError(f"unknown comparison mode: {mode}")
    counts = (df.select(*by, group.alias("group"), _as_col(label).alias("_y"), _as_col(pred).alias("_p"))
                .where(F.col("group").isNotNull())
                .groupBy(*by, "group")
                .agg(*contingency_aggs("_y", "_p"))
                .withColumn("is_priv", F.col("group") == F.lit(priv_key)))
    if mode == "combined":
        # privileged vs pooled: one row per audit even when a side is empty
        wide = counts.groupBy(*by).agg(*[
            F.coalesce(F.sum(F.when(F.col("is_priv") == flag, F.col(c))), F.lit(0)).alias(f"{side}{c}")
            for flag, side in ((False, ""), (True, "p_")) for c in COUNT_COLS])
    else:
        wide = _with_roles(counts, by, "group").where(~F.col("is_priv"))
    rated = wide.select(
        "*",
        ratio("n_pred_pos", "n").alias("u_rate"), ratio("n_tp", "n_pos").alias("u_tpr"),
        ratio("n_fp", "n_neg").alias("u_fpr"),
        ratio("p_n_pred_pos", "p_n").alias("p_rate"), ratio("p_n_tp", "p_n_pos").alias("p_tpr"),
        ratio("p_n_fp", "p_n_neg").alias("p_fpr"))
    keys = by if mode == "combined" else [*by, "group"]
    extra = [*COUNT_COLS, *[f"p_{c}" for c in COUNT_COLS]] if with_counts else []
    return rated.select(*keys, *metrics_from_rates("u_", "p_", families), *extra)


def fairness_long(wide: DataFrame, by: Sequence[str] = (), group_col: str | None = None) -> DataFrame:
    """Wide metric rows -> (by..., metric, value) with display names; individual
    mode appends `` (Group: g)`` to the metric key."""
    present = [m for m in METRIC_COLS if m in wide.columns]
    stack = F.explode(F.array(*[
        F.struct(F.lit(METRIC_NAMES[m]).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in present]))
    out = wide.select(*by, *( [group_col] if group_col else []), stack.alias("kv"))
    name = F.col("kv.metric")
    if group_col:
        name = F.concat(name, F.lit(" (Group: "), F.col(group_col).cast("string"), F.lit(")"))
    return out.select(*by, name.alias("metric"), F.col("kv.value").alias("value"))


def audit_many(df: DataFrame, attrs: Sequence[str], privileged: dict, label=None, pred=None,
               composite: bool = True, by: Sequence[str] = (), sep: str = "_") -> DataFrame:
    """several sensitive settings (each attribute, plus the composite
    of all) audited in ONE scan: rows fan out to (attribute, group) pairs and
    are partially aggregated in the same stage (the plan Spark uses for
    GROUPING SETS), then each setting compares its privileged value with the
    pooled others."""
    specs = [(a, F.col(a).cast("string"), str(privileged[a])) for a in attrs]
    if composite and len(attrs) > 1:
        specs.append((sep.join(attrs), composite_key(list(attrs), sep),
                      sep.join(str(privileged[a]) for a in attrs)))
    fan = F.explode(F.array(*[
        F.struct(F.lit(name).alias("attribute"), expr.alias("grp"),
                 (expr == F.lit(pv)).alias("is_priv"))
        for name, expr, pv in specs]))
    y = _as_col(label if label is not None else pred)
    p = _as_col(pred if pred is not None else label)
    rows = (df.select(*by, fan.alias("s"), y.alias("_y"), p.alias("_p"))
              .select(*by, "s.attribute", "s.grp", "s.is_priv", "_y", "_p"))
    rows = rows.where(F.col("grp").isNotNull())
    role = F.when(F.col("is_priv"), F.lit("privileged")).otherwise(F.lit("unprivileged"))
    return fairness_metrics(rows.withColumn("_role", role), "_role", "privileged",
                            label="_y" if (label is not None and pred is not None) else None,
                            pred="_p", unprivileged=["unprivileged"], mode="combined",
                            by=[*by, "attribute"])


def group_stats(df: DataFrame, sens, target, by: Sequence[str] = ()) -> DataFrame:
    """Per-group size and positive rate (null group excluded)."""
    s = _as_col(sens)
    return (df.where(s.isNotNull())
              .groupBy(*by, s.alias("group"))
              .agg(F.count(F.lit(1)).alias("n"),
                   F.count_if(_as_col(target) == 1).alias("n_pos"))
              .select(*by, "group", "n", "n_pos", ratio("n_pos", "n").alias("positive_rate")))


def parity_significance(df: DataFrame, sens, privileged, out, by: Sequence[str] = (),
                        alpha: float = 0.05) -> DataFrame:
    """z-test of each group's favourable rate against the privileged rate."""
    stats = group_stats(df, sens, out, by).withColumn("is_priv", F.col("group") == F.lit(privileged))
    w = Window.partitionBy(*[F.col(b) for b in by]) if by else Window.partitionBy(F.lit(0))
    stats = stats.select(*stats.columns,
                         F.max(F.when(F.col("is_priv"), F.col("n"))).over(w).alias("p_n"),
                         F.max(F.when(F.col("is_priv"), F.col("positive_rate"))).over(w).alias("p_rate"))
    pv = parity_p_value(F.col("n"), F.col("positive_rate"), F.col("p_n"), F.col("p_rate"))
    return (stats.where(~F.col("is_priv"))
                 .select(*by, "group", "n", "positive_rate", pv.alias("p_value"))
                 .withColumn("significant", F.col("p_value") < F.lit(alpha)))
