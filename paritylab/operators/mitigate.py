"""Bias mitigation, table -> table (M1-M8).

Quotas come from one small aggregate (counts per group and label); rows are
then selected by distributed, md5-ordered ranks (``ranking``) or joined to
drawn positions, so a group holding a third of all rows is spread across
many tasks and every choice is reproducible under task retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritylab.functions.hashing import hash_key
from paritylab.operators.ranking import broadcast_if_small, bucket_bits, hash_rank, range_rank
from paritylab.session import cut_lineage

# Draws of one (group, label) cell are generated in chunks of this size so no
# single task materialises a huge quota.
DRAW_CHUNK = 1_000_000
# Fixed value: helper column name carrying the audited attribute through mitigation.
EVAL_COL = "_fairness_eval_sens_attr"
# Fixed value: text written into non-numeric columns of synthetic rows.
SYNTHETIC_TEXT = "SYNTHETIC"


def _target_rate(df: DataFrame, target: str) -> float:
    """Mean of the target over rows where it is numeric."""
    v = df.agg(F.avg(F.col(target).cast("string").try_cast("double")).alias("r")).first()["r"]
    return float(v) if v is not None else 0.0


def _cell_counts(df: DataFrame, target: str, sens: str) -> DataFrame:
    """(_g, n, pos, neg) per sensitive group, as a table."""
    return cut_lineage(df.where(F.col(sens).isNotNull()).groupBy(F.col(sens).cast("string").alias("_g"))
                       .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg")))


def resample(df: DataFrame, target: str, sens: str, strategy: str = "undersample",
             seed: int = 42, key: str = "row_id") -> DataFrame:
    """M1/M2. Every non-null group gets ``int(size * r)`` positives and the
    rest negatives (``size`` = own size for undersampling, largest group size
    for oversampling); undersampling keeps ``min(available, quota)`` rows
    without replacement, oversampling draws with replacement; an empty side
    stays empty; rows with target outside {0,1} or a null group vanish."""
    r = _target_rate(df, target)
    cells = _cell_counts(df, target, sens)
    top = cells.agg(F.max("n").alias("n"), F.max(F.greatest("pos", "neg")).alias("cell")).first()
    if top["n"] is None:
        return df.limit(0)
    size = F.col("n") if strategy == "undersample" else F.lit(top["n"])
    positives = F.floor(size * F.lit(r)).cast("long")
    qdf = cells.select("_g", F.explode(F.array(
        F.struct(F.lit(1).alias("_y"), positives.alias("_q"), F.col("pos").alias("_avail")),
        F.struct(F.lit(0).alias("_y"), (size - positives).alias("_q"), F.col("neg").alias("_avail")))).alias("x")).select("_g", "x.*")
    base = (df.where(F.col(sens).isNotNull() & F.col(target).isin(0, 1))
              .withColumn("_g", F.col(sens).cast("string")).withColumn("_y", F.col(target).cast("int")))
    ranked = hash_rank(base, ["_g", "_y"], seed, key, rank_col="_r", bits=bucket_bits(top["cell"]))
    if strategy == "undersample":
        kept = ranked.join(broadcast_if_small(qdf), ["_g", "_y"], "inner").where(F.col("_r") <= F.col("_q"))
        return kept.select(*df.columns)
    if strategy != "oversample":
        raise ValueError(f"unknown resampling strategy: {strategy}")
    # with replacement: draw i of cell (g, y) picks rank pmod(hash(seed|g|y|i), avail) + 1
    q = qdf.where((F.col("_avail") > 0) & (F.col("_q") > 0))
    chunks = q.select("_g", "_y", "_q", "_avail",
                      F.explode(F.sequence(F.lit(0), ((F.col("_q") - 1) / DRAW_CHUNK).cast("long")))
                      .alias("_c"))
    chunks = chunks.repartition("_g", "_y", "_c")
    lo = F.col("_c") * DRAW_CHUNK + 1
    hi = F.least(F.col("_q"), (F.col("_c") + 1) * DRAW_CHUNK)
    draws = chunks.select("_g", "_y", "_avail", F.explode(F.sequence(lo, hi)).alias("_i"))
    draws = draws.select("_g", "_y", "_i",
                         (F.pmod(hash_key(f"{seed}|draw", F.col("_g"), F.col("_y"), F.col("_i")),
                                 F.col("_avail")) + 1).alias("_r"))
    picked = draws.join(ranked, ["_g", "_y", "_r"], "inner")
    return picked.select(*df.columns)


def relabel(df: DataFrame, target: str, sens: str, privileged, unprivileged: Sequence | None = None,
            score: str = "score", key: str = "row_id") -> DataFrame:
    """M3: move the positive count of the unprivileged (pooled) and of the
    privileged group to ``int(n_group * r)``: flip the highest-scored 0s up or
    the lowest-scored 1s down (ties: smaller key first). Other rows untouched.
    Adds nothing; the number of flips is available from ``relabel_plan``."""
    plan = relabel_plan(df, target, sens, privileged, unprivileged)
    role = _role(sens, privileged, unprivileged)
    up = {k for k, v in plan.items() if v > 0}
    down = {k for k, v in plan.items() if v < 0}
    if not up and not down:
        return df
    d = df.withColumn("_role", role)
    cand = F.lit(False)
    ord_ = F.lit(None).cast("double")
    for rl in up:
        cond = (F.col("_role") == rl) & (F.col(target) == 0)
        cand = cand | cond
        ord_ = F.when(cond, -F.col(score).cast("double")).otherwise(ord_)
    for rl in down:
        cond = (F.col("_role") == rl) & (F.col(target) == 1)
        cand = cand | cond
        ord_ = F.when(cond, F.col(score).cast("double")).otherwise(ord_)
    d = d.withColumn("_cand", F.coalesce(cand, F.lit(False))).withColumn("_ord", ord_)
    cands = d.where(F.col("_cand") & F.col("_ord").isNotNull())
    rest = d.where(~(F.col("_cand") & F.col("_ord").isNotNull()))
    ranked = range_rank(cands, ["_role"], [F.col("_ord"), F.col(key)], rank_col="_r")
    limit = F.lit(0)
    for rl, v in plan.items():
        limit = F.when(F.col("_role") == rl, F.lit(abs(v))).otherwise(limit)
    flipped = ranked.withColumn(target, F.when(F.col("_r") <= limit, F.lit(1) - F.col(target))
                                .otherwise(F.col(target)).cast(df.schema[target].dataType))
    return flipped.select(*df.columns).unionByName(rest.select(*df.columns))


def _role(sens, privileged, unprivileged):
    s = F.col(sens)
    unpriv = s.isin(list(unprivileged)) if unprivileged is not None else (s.isNotNull() & (s != F.lit(privileged)))
    return F.when(s == F.lit(privileged), F.lit("privileged")).when(unpriv, F.lit("unprivileged"))


def relabel_plan(df: DataFrame, target: str, sens: str, privileged,
                 unprivileged: Sequence | None = None) -> dict:
    """Signed flips per role (+ up, - down) from one aggregate."""
    role = _role(sens, privileged, unprivileged)
    row = df.agg(
        F.avg(F.col(target).cast("double")).alias("r"),
        *[F.count_if(role == rl).alias(f"n_{rl}") for rl in ("privileged", "unprivileged")],
        *[F.count_if((role == rl) & (F.col(target) == 1)).alias(f"p_{rl}") for rl in ("privileged", "unprivileged")],
    ).first()
    r = row["r"] or 0.0
    plan = {}
    for rl in ("unprivileged", "privileged"):
        goal = int(row[f"n_{rl}"] * r)
        plan[rl] = goal - row[f"p_{rl}"]
    return plan


def counterfactual_augment(df: DataFrame, target: str, sens: str, privileged,
                           unprivileged: Sequence | None = None,
                           group_values: Sequence | None = None) -> DataFrame:
    """M6: append a copy of every row with the sensitive value swapped
    (privileged -> first unprivileged, any unprivileged -> privileged, others
    unchanged); one-hot ``sens_value`` columns and the helper evaluation
    column follow the swap; target moved last. Narrow: no shuffle."""
    priv = privileged[0] if isinstance(privileged, (list, tuple)) else privileged
    if unprivileged is None:
        first = df.where(F.col(sens).isNotNull() & (F.col(sens) != F.lit(priv))) \
                  .agg(F.min(sens).alias("m")).first()["m"]
        unpriv_list = None
        swap_to = first
    elif isinstance(unprivileged, (list, tuple)):
        unpriv_list = list(unprivileged)
        swap_to = unpriv_list[0] if unpriv_list else None
    else:
        unpriv_list = [unprivileged]
        swap_to = unprivileged
    s = F.col(sens)
    is_unpriv = s.isin(unpriv_list) if unpriv_list is not None else (s.isNotNull() & (s != F.lit(priv)))
    swapped = F.when(s == F.lit(priv), F.lit(swap_to).cast(df.schema[sens].dataType)) \
               .when(is_unpriv, F.lit(priv).cast(df.schema[sens].dataType)).otherwise(s)
    cols = [c for c in df.columns if c != target] + [target]
    copy = df.withColumn(sens, swapped)
    values = list(group_values) if group_values is not None else None
    for c in df.columns:
        if c.startswith(f"{sens}_") and c not in (sens, EVAL_COL):
            v = c[len(sens) + 1:]
            if values is None or v in [str(x) for x in values]:
                copy = copy.withColumn(c, (F.col(sens).cast("string") == F.lit(v)).cast("int"))
    if EVAL_COL in df.columns:
        copy = copy.withColumn(EVAL_COL, F.col(sens))
    return df.select(*cols).unionByName(copy.select(*cols))


def mitigate(df: DataFrame, strategy: str, target: str, sens: str, privileged,
             unprivileged: Sequence | None = None, seed: int = 42, key: str = "row_id",
             score: str | None = None, features: Sequence[str] | None = None) -> DataFrame:
    """M7/M8 dispatch: none | oversample | undersample | relabel | smote | cda."""
    if strategy in (None, "none"):
        return df
    if strategy in ("oversample", "undersample"):
        return resample(df, target, sens, strategy, seed, key)
    if strategy in ("relabel", "relabeling"):
        if score is None:
            from paritylab.plans.models import rank_score
            df = rank_score(df, target, features, key=key, out="_rank_prob")
            return relabel(df, target, sens, privileged, unprivileged, "_rank_prob", key).drop("_rank_prob")
        return relabel(df, target, sens, privileged, unprivileged, score, key)
    if strategy == "cda":
        return counterfactual_augment(df, target, sens, privileged, unprivileged)
    if strategy == "smote":
        from paritylab.operators.smote import smote
        return smote(df, target, sens, features=features, seed=seed, key=key)
    raise ValueError(f"unknown mitigation strategy: {strategy}")

