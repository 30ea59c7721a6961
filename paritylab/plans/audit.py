"""End-to-end audits (P25, P26, T8-T10, M8) and report tables.

An audit is a lazy plan: preprocessing fits a few small aggregates, the split
and the mitigation are distributed rank/join jobs, training is a Spark ML
pipeline, and every metric family comes from the shared aggregates of
``operators``. Results are long metric tables ``(metric, value)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritylab.operators import evaluate as ev
from paritylab.operators import fairness as fm
from paritylab.operators import mitigate as mt
from paritylab.operators import prep as pp
from paritylab.operators import profile as pf
from paritylab.operators.split import stratified_split
from paritylab.plans import models as md
from paritylab.plans.spec import require_columns


@dataclass
class PrepSpec:
    """Preprocessing choices (None / 'none' = skip a step)."""

    missing: str | None = "mean"       # mean | median | mode | drop
    outliers: str | None = "iqr"       # iqr (remove) | clip
    encoding: str | None = "one-hot"   # one-hot | label
    selected_features: list | None = None


@dataclass
class AuditSpec:
    attrs: list
    privileged: object                 # value, or {attr: value} for several attributes
    unprivileged: list | None = None   # None = every other value
    mode: str = "combined"             # combined | individual
    metrics: str = "all"               # parity | odds | all
    model: str = "logistic"
    seed: int = 42
    key: str = "row_id"
    extra: dict = field(default_factory=dict)


@dataclass
class FittedPrep:
    """The fitted steps of P25, replayable on other rows (e.g. test rows)."""

    target: str
    steps: list
    features: list
    sensitive: str
    privileged: object

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step(df)
        return df


def fit_preprocess(df: DataFrame, target: str, prep: PrepSpec, attrs: Sequence[str], privileged,
                   binarize: bool = False, key: str = "row_id") -> tuple[FittedPrep, DataFrame]:
    """Fit P25 on ``df`` step by step (each step is fitted on the output of the
    previous one, as in the reference) and return the fitted pipeline together
    with ``df`` transformed by it."""
    require_columns(df, list(attrs), target)
    feats = list(prep.selected_features or [c for c in df.columns if c not in (target, key)])
    work = feats + [target]
    steps = []

    def run(step):
        nonlocal df
        steps.append(step)
        df = step(df)

    strat = prep.missing
    if strat and strat not in ("none", "skip"):
        cols = [c for c in work if c in df.columns]
        if strat in ("mean", "median"):
            num = [c for c in cols if pp.is_numeric(df, c)]
            cat = [c for c in cols if not pp.is_numeric(df, c)]
            if num:
                run(pp.Imputer(strat, num).fit(df).transform)
            if cat:
                run(pp.Imputer("mode", cat).fit(df).transform)
        elif strat == "mode":
            run(pp.Imputer("mode", cols).fit(df).transform)
        else:
            run(pp.Imputer("drop", cols).transform)
    if prep.outliers and prep.outliers not in ("none", "skip"):
        how = "clip" if prep.outliers == "clip" else "remove"
        run(pp.IqrTrimmer(how, work).fit(df).transform)
    attrs = list(attrs)
    if len(attrs) > 1:
        sens = "_".join(attrs)
        run(lambda d: pp.add_composite(d, attrs)[0])
        if isinstance(privileged, dict):
            privileged = pp.composite_privileged(privileged, attrs)
    else:
        sens = attrs[0]
        if isinstance(privileged, dict):
            privileged = privileged[sens]
    if binarize:
        priv_value = privileged
        run(lambda d: pp.binarize(d, sens, priv_value))
    flags = [c for c in feats if c not in (target, sens) and isinstance(df.schema[c].dataType, T.BooleanType)]
    if flags:  # Q6: booleans are numbers, not categories
        run(lambda d: d.withColumns({c: F.col(c).cast("int") for c in flags}))
    cats = [c for c in pp.categorical_columns(df, feats) if c not in (target, sens)]
    model_feats = list(feats)
    if prep.encoding in ("one-hot", "onehot") and cats:
        enc = pp.OneHot(cats, target).fit(df)
        run(enc.transform)
        expanded = []
        for f in model_feats:
            expanded += [f] if f not in enc.values else [f"{f}_{v}" for v in enc.values[f]]
        model_feats = list(dict.fromkeys(expanded))
    elif prep.encoding == "label" and cats:
        run(pp.LabelEncode(cats, target).fit(df).transform)
    if pp.is_categorical(df, target):
        run(pp.LabelEncode([target], keep_raw=False).fit(df).transform)
    return FittedPrep(target, steps, model_feats, sens, privileged), df


def preprocess(df: DataFrame, target: str, prep: PrepSpec, attrs: Sequence[str], privileged,
               binarize: bool = False, key: str = "row_id") -> tuple[DataFrame, list[str], str, object]:
    """P25: impute -> IQR -> composite -> binarize -> encode -> target codes,
    fitted on the whole table (reference order). Returns
    (table, model features, sensitive column, privileged value)."""
    fitted, out = fit_preprocess(df, target, prep, attrs, privileged, binarize, key)
    return out, fitted.features, fitted.sensitive, fitted.privileged


def preprocess_basic(df: DataFrame, target: str, keep: Sequence[str] | None, missing: str = "mean",
                     outliers: bool = True) -> DataFrame:
    """The older order select -> impute -> IQR."""
    df = pp.select_features(df, target, keep=keep)
    df = pp.smart_impute(df, missing, df.columns) if missing in ("mean", "median") else \
        pp.Imputer(missing).fit_transform(df)
    return pp.IqrTrimmer("remove").fit_transform(df) if outliers else df


def _long(pairs: dict, prefix: str = "") -> list[tuple[str, float]]:
    return [(f"{prefix}{k}", float(v) if v is not None else None) for k, v in pairs.items()]


def run_experiment(train: DataFrame, test: DataFrame, target: str, sens: str, privileged,
                   unprivileged: Sequence | None, features: Sequence[str], model: str = "logistic",
                   mitigation: str | None = None, mode: str = "combined", metrics: str = "all",
                   seed: int = 42, key: str = "row_id", cv_folds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Mitigate the training rows, train, predict the untouched test rows,
    then performance (``Test ...``, ``Train ...``) and fairness metrics.
    Returns (long metric table, test predictions)."""
    spark = train.sparkSession
    train_m = mt.mitigate(train, mitigation, target, sens, privileged, unprivileged, seed, key,
                          features=features)
    mm_train, feats = pp.model_matrix(train_m, features, target, extra=[key, sens])
    mm_test, _ = pp.model_matrix(test, features, target, extra=[key, sens])
    mm_test = pp.align_columns(mm_test, mm_train.columns)
    res = md.train(mm_train, target, feats, model, test=mm_test, seed=seed, key=key, cv_folds=cv_folds)
    pred = res.test_predictions
    test_perf = md.evaluate_model(res.model, mm_test, target)
    rows = _long({k: v for k, v in res.train_metrics.items() if not k.startswith("CV")})
    rows += _long(test_perf, "Test ")
    if "CV Mean Accuracy" in res.train_metrics:
        rows.append(("CV Mean Accuracy", float(res.train_metrics["CV Mean Accuracy"])))
    perf_df = spark.createDataFrame(rows, "metric string, value double")
    fam = {"1": "parity", "2": "odds"}.get(metrics, metrics)
    wide = fm.fairness_metrics(pred, sens, privileged, label=target, pred="prediction",
                               unprivileged=unprivileged, mode=mode, families=fam)
    fair = fm.fairness_long(wide, group_col="group" if mode == "individual" else None)
    return perf_df.unionByName(fair), pred


def _split(df: DataFrame, target: str, sens: str, seed: int, key: str) -> tuple[DataFrame, DataFrame]:
    s = stratified_split(df, [target, sens], 0.2, seed, key, fallback=[[target]]).cache()
    return s.where(F.col("split") == "train").drop("split"), s.where(F.col("split") == "test").drop("split")


def _config(df: DataFrame, sens: str, spec: AuditSpec, privileged, binarized: bool):
    if binarized:
        return 1, [0]
    if spec.unprivileged:
        return privileged, list(spec.unprivileged)
    return privileged, None


def baseline_audit(df: DataFrame, target: str, prep: PrepSpec, spec: AuditSpec,
                   cv_folds: int = 5, leak_free: bool = False) -> dict:
    """Preprocess -> stratified split -> experiment -> stats -> reorder.

    ``leak_free=False`` fits preprocessing on the whole table before the split
    (the reference's order, SURVEY Q4); ``True`` splits the raw rows first,
    fits on the training rows and replays the fitted steps on the test rows."""
    return _audit(df, target, prep, spec, None, cv_folds, leak_free)


def mitigation_audit(df: DataFrame, target: str, prep: PrepSpec, spec: AuditSpec, strategy: str,
                     cv_folds: int = 5, leak_free: bool = False) -> dict:
    """As T9 with the mitigation on the training rows, plus the whole
    processed table mitigated for export (M8); test rows untouched."""
    return _audit(df, target, prep, spec, strategy, cv_folds, leak_free)


def _audit(df, target, prep, spec, strategy, cv_folds, leak_free=False):
    binarized = spec.mode == "combined"
    if leak_free:
        raw_sens = "_".join(spec.attrs)
        raw = df if len(spec.attrs) == 1 else pp.add_composite(df, list(spec.attrs))[0]
        s = stratified_split(raw.persist(), [target, raw_sens], 0.2, spec.seed, spec.key,
                             fallback=[[target]]).persist()
        train_raw = s.where(F.col("split") == "train").drop("split")
        test_raw = s.where(F.col("split") == "test").drop("split")
        if len(spec.attrs) > 1:
            train_raw, test_raw = train_raw.drop(raw_sens), test_raw.drop(raw_sens)
        fitted, train = fit_preprocess(train_raw, target, prep, spec.attrs, spec.privileged,
                                       binarize=binarized, key=spec.key)
        test = fitted.transform(test_raw)
        processed = train.unionByName(test, allowMissingColumns=True).persist()
        feats, sens, priv = fitted.features, fitted.sensitive, fitted.privileged
    else:
        processed, feats, sens, priv = preprocess(df, target, prep, spec.attrs, spec.privileged,
                                                  binarize=binarized, key=spec.key)
        # processed rows feed the split counts, the split and the export: persist once
        processed = processed.persist()
    priv_v, unpriv = _config(processed, sens, spec, priv, binarized)
    if not leak_free:
        train, test = _split(processed, target, sens, spec.seed, spec.key)
    metrics, pred = run_experiment(train, test, target, sens, priv_v, unpriv, feats, spec.model, strategy,
                                   spec.mode, spec.metrics, spec.seed, spec.key, cv_folds)
    export = mt.mitigate(processed, strategy, target, sens, priv_v, unpriv, spec.seed, spec.key,
                         features=feats) if strategy else processed
    export = pp.reorder(export, df.columns)
    stats = pf.audit_stats(export, target, sens, feats, original_features=len(df.columns) - 1)
    return {"metrics": metrics, "predictions": pred, "table": export, "stats": stats,
            "features": feats, "sensitive": sens, "privileged": priv_v}


# ---------------------------------------------------------------- A12-A16

def tradeoff_points(metrics: DataFrame, stage: str = "stage") -> DataFrame:
    """Per stage (x = SPD if present else DI, y = Test Accuracy; missing -> 0)."""
    spd = "Statistical Parity Difference"
    has_spd = metrics.where(F.col("metric") == spd).limit(1).count() > 0
    fkey = spd if has_spd else "Disparate Impact"
    return (metrics.groupBy(stage)
                   .agg(F.coalesce(F.max(F.when(F.col("metric") == fkey, F.col("value"))), F.lit(0.0)).alias(fkey),
                        F.coalesce(F.max(F.when(F.col("metric") == "Test Accuracy", F.col("value"))), F.lit(0.0))
                        .alias("Test Accuracy")))


def metric_long(before: DataFrame, after: DataFrame) -> DataFrame:
    """Baseline keys; mitigated value missing -> 0; long by stage."""
    b = before.where(F.col("value").isNotNull()).select("metric", F.col("value").alias("Baseline"))
    a = after.select("metric", F.col("value").alias("_m"))
    j = b.join(a, "metric", "left").select("metric", "Baseline", F.coalesce("_m", F.lit(0.0)).alias("Mitigated"))
    return j.select("metric", F.explode(F.array(
        F.struct(F.lit("Baseline").alias("stage"), F.col("Baseline").alias("value")),
        F.struct(F.lit("Mitigated").alias("stage"), F.col("Mitigated").alias("value")))).alias("kv")) \
        .select("metric", "kv.stage", "kv.value")


# Preferred order of the statistics table.
PREFERRED_STATS = ["Target Variable", "Features Selected", "Categorical Features", "Numerical Features",
                   "Total Features", "Total Samples", "Missing Values"]


def _fmt(c):
    return F.coalesce(F.format_string("%.4f", c), F.lit("N/A"))


def report_stats(before: DataFrame, after: DataFrame, key: str = "stat") -> DataFrame:
    """Union of keys, preferred order first then sorted, N/A, 4 dp."""
    j = before.select(key, F.col("value").alias("_b")).join(
        after.select(key, F.col("value").alias("_a")), key, "full_outer")
    order = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in PREFERRED_STATS]), F.col(key)),
                       F.lit(len(PREFERRED_STATS) + 1))
    return j.select(key, _fmt(F.col("_b")).alias("Baseline"), _fmt(F.col("_a")).alias("Mitigated"),
                    order.alias("_o")).orderBy("_o", key).drop("_o")


def report_metrics(before: DataFrame, after: DataFrame) -> DataFrame:
    """Union of metric keys, sorted, N/A, 4 dp."""
    j = before.select("metric", F.col("value").alias("_b")).join(
        after.select("metric", F.col("value").alias("_a")), "metric", "full_outer")
    return j.select("metric", _fmt(F.col("_b")).alias("Baseline"), _fmt(F.col("_a")).alias("Mitigated")) \
            .orderBy("metric")


def _stage_tables(stage: str, audit: dict, target: str) -> dict:
    """Confusion tables, overall and per group, and score densities of one audit's test predictions, and the
    (group, target) counts of its table."""
    sens, pred = audit["sensitive"], audit["predictions"]
    return {f"{stage}_confusion": ev.confusion(pred, target, "prediction"),
            f"{stage}_subgroup_confusion": ev.confusion(pred, target, "prediction", [sens]),
            f"{stage}_score_density": pf.score_density(pred, "probability", sens),
            f"{stage}_subgroup_counts": pf.crosstab(audit["table"], sens, target)}


def report_tables(base: dict, mitig: dict | None = None, target: str | None = None) -> dict:
    """Every report table of one audit (lazy DataFrames). The tables of predictions and of rows are added when
    ``target`` names the label."""
    out = {"baseline_metrics": base["metrics"], "baseline_stats": base["stats"]}
    if target:
        out.update(_stage_tables("baseline", base, target))
    if mitig:
        staged = base["metrics"].withColumn("stage", F.lit("Baseline")).unionByName(
            mitig["metrics"].withColumn("stage", F.lit("Mitigated")))
        out.update({
            "tradeoff": tradeoff_points(staged),
            "metric_long": metric_long(base["metrics"], mitig["metrics"]),
            "metrics_table": report_metrics(base["metrics"], mitig["metrics"]),
            "comparison": ev.compare_metrics(base["metrics"], mitig["metrics"]),
            "stats_table": report_stats(base["stats"].select("stat", "value"),
                                        mitig["stats"].select("stat", "value")),
        })
    if mitig and target:
        before, after, sens = base["table"], mitig["table"], base["sensitive"]
        out.update(_stage_tables("mitigated", mitig, target))
        out.update({"class_distribution": pf.compare_distribution(before, after, target),
                    "sensitive_distribution": pf.compare_distribution(before, after, sens),
                    "selection_rates": pf.selection_rates(before, after, sens, target),
                    "positive_rate": pf.positive_rate(after, sens, target)})
    return out
