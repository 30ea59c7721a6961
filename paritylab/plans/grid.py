"""Experiment grid (B1-B3, S6, S8-S10, F11/F12 settings, J2, J5).

The driver enumerates the (small) task list. A preprocessed, split table is computed and checkpointed once per
(dataset, sensitive setting, run), a mitigated training table once per technique, shared by the models. All
training tables of a dataset form one fleet, so each model family is fitted, folds included, for all of them in the
same passes; the test rows are scored by all models and measured with one aggregate a metric family.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paritylab.operators import evaluate as ev
from paritylab.operators import fairness as fm
from paritylab.operators import mitigate as mt
from paritylab.operators import prep as pp
from paritylab.operators.split import has_two_classes, stratified_split
from paritylab.plans import audit as au
from paritylab.plans import models as md
from paritylab.session import cut_lineage, job_pool

# The grid of the reference benchmark.
GRID_MODELS = ("logistic", "random_forest", "gbm", "svm")
GRID_MITIGATIONS = (("none", None, None), ("resampling_over", "oversample", "oversample"),
                    ("resampling_under", "undersample", "undersample"), ("relabeling", None, "relabel"),
                    ("synthetic_smote", "smote", "smote"), ("synthetic_cda", "cda", "cda"))
# Up to this many sampled rows a top-n (no full shuffle) is used.
TOP_K_LIMIT = 10_000
GRID_PREP = {"missing": "mode", "outliers": "iqr", "encoding": "one-hot", "mode": "combined", "metrics": "all"}


@dataclass
class DatasetSpec:
    """A registered dataset: target, favourable label, sensitive columns
    and their privileged values."""

    name: str
    target: str
    positive_label: object
    sensitive: tuple
    privileged: dict


def apply_spec(df: DataFrame, spec: DatasetSpec, out: str | None = None) -> DataFrame:
    """``lower(str(x)) == lower(label) -> 1`` else 0 (nulls -> 0)."""
    t = spec.target
    lab = F.coalesce(F.lower(F.col(t).cast("string")) == F.lit(str(spec.positive_label).lower()), F.lit(False))
    return df.withColumn(out or t, lab.cast("int"))


def threshold_bucket(col: str, cut: float, hi: str, lo: str):
    """``col > cut -> hi`` else ``lo`` (null -> lo)."""
    return F.when(F.col(col) > F.lit(cut), F.lit(hi)).otherwise(F.lit(lo))


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """Exactly ``n`` rows without replacement, chosen by md5 order. A
    distributed rank (no single-task sort) picks them, so n may be large."""
    from paritylab.functions.hashing import hash_key
    from paritylab.operators.ranking import hash_rank
    if n <= TOP_K_LIMIT:
        # bounded n: per-partition top-n then one merge of (n x partitions) rows
        return df.orderBy(hash_key(seed, key), F.col(key)).limit(n)
    return hash_rank(df, [], seed, key, rank_col="_r").where(F.col("_r") <= n).drop("_r", "_h")


def grid_configs(models: Sequence[str] = GRID_MODELS, mitigations=GRID_MITIGATIONS) -> list[dict]:
    """B1: model x mitigation configurations (fixed preprocessing)."""
    return [dict(model=m, technique=t, detail=d, strategy=s, **GRID_PREP)
            for m, (t, d, s) in itertools.product(models, mitigations)]


def sensitive_settings(spec: DatasetSpec) -> list[tuple[list, object]]:
    """Each attribute alone, plus the composite when there are several."""
    out = [([a], spec.privileged[a]) for a in spec.sensitive]
    if len(spec.sensitive) > 1:
        out.append((list(spec.sensitive), "_".join(str(spec.privileged[a]) for a in spec.sensitive)))
    return out


def grid_tasks(specs: Sequence[DatasetSpec], runs: int = 1) -> list[tuple]:
    """B2: dataset x sensitive setting x run from 1 (configs run inside a task)."""
    return [(s, attrs, priv, r) for s in specs for attrs, priv in sensitive_settings(s) for r in range(1, runs + 1)]


def _prepared(df: DataFrame, spec: DatasetSpec, attrs: list, run: int, key: str) -> tuple[DataFrame, list[str], str]:
    """The preprocessed rows of a task with their ``split``, the model features and the binary sensitive column.

    One reliable checkpoint: every configuration reads it, and a lost executor does not replay preprocessing."""
    prep = au.PrepSpec(missing=GRID_PREP["missing"], outliers=GRID_PREP["outliers"], encoding=GRID_PREP["encoding"])
    processed, features, sens, _ = au.preprocess(df, spec.target, prep, attrs, {a: spec.privileged[a] for a in attrs}, binarize=True, key=key)
    processed = processed.persist()
    split = cut_lineage(stratified_split(processed, [spec.target], 0.2, 42 + run, key, fallback=[]))
    processed.unpersist()
    return split, features, sens


def _chances(models: list[tuple[int, object, list[str]]]) -> Column:
    """The (config, probability) pairs of a row under the models (config, model, features). Those that score arrays do so in one function: their
    expressions side by side are more code than one generated method may have."""
    arrays = [(at, model, features) for at, model, features in models if hasattr(model, "chances")]
    alone = [F.struct(F.lit(at).alias("config"), model.probability().alias("probability")) for at, model, _ in models if not hasattr(model, "chances")]
    if not arrays:
        return F.array(*alone)
    names = list(dict.fromkeys(f for _, _, features in arrays for f in features))
    place = {f: i for i, f in enumerate(names)}
    own = [(model.chances, [place[f] for f in features]) for _, model, features in arrays]

    def score(rows: pd.Series) -> pd.Series:
        x = np.stack(rows.to_numpy())
        return pd.Series(list(np.stack([chances(x[:, at]) for chances, at in own], 1))) if len(x) else pd.Series([], dtype=object)

    found = F.pandas_udf(score, "array<double>")(F.array(*[F.col(f"`{f}`").cast("double") for f in names], F.lit(0.0)))
    pairs = F.zip_with(F.array(*[F.lit(at) for at, _, _ in arrays]), found, lambda at, p: F.struct(at.alias("config"), p.alias("probability")))
    return F.concat(pairs, F.array(*alone)) if alone else pairs


def _measured(scored: DataFrame) -> dict[int, dict]:
    """Metrics of every configuration from (config, sens, y, prediction, probability)."""
    out: dict = {}
    names = {"accuracy": "Accuracy", "precision": "Precision", "recall": "Recall", "f1": "F1", "balanced_accuracy": "Balanced Accuracy", "roc_auc": "ROC AUC",
             "spd": "Statistical Parity Difference", "di": "Disparate Impact", "eod": "Equal Opportunity Difference", "aod": "Average Odds Difference"}
    for table in (ev.performance(scored, "y", "prediction", ["config"]), ev.roc_auc(scored, "y", "probability", ["config"]),
                  fm.fairness_metrics(scored, "sens", 1, label="y", pred="prediction", unprivileged=[0], by=["config"])):
        for r in table.collect():  # one row a configuration
            out.setdefault(r["config"], {}).update({names[c]: v for c, v in r.asDict().items() if c in names})
    return out


def run_grid(spark: SparkSession, tables: dict, specs: Sequence[DatasetSpec], runs: int = 1,
             configs: Sequence[dict] | None = None, key: str = "row_id", cv_folds: int = 5,
             parallelism: int = 8, rounds: int = md.GBM_ROUNDS, patience: int | None = md.GBM_PATIENCE) -> DataFrame:
    """One record per (dataset, setting, run, config); metrics of both families. A model that is not one of the lockstep
    families runs by itself (``audit.run_experiment``). ``Seconds`` is the dataset's time, spread over its records."""
    configs = list(configs or grid_configs())
    records = []
    for spec in specs:
        t0 = time.time()
        mine = _run_dataset(spark, tables[spec.name], spec, [t for t in grid_tasks([spec], runs)], configs, key, cv_folds, parallelism, rounds, patience)
        records += [r | {"Seconds": (time.time() - t0) / len(mine)} for r in mine]
    schema = ("`Dataset` string, `Model Type` string, `Mitigation Technique` string, `Mitigation Detail` string, "
              "`Run Number` int, `Sensitive Attributes` string, `Privileged Value` string, "
              "`CV Mean Accuracy` double, `Accuracy` double, `Precision` double, `Recall` double, `F1` double, "
              "`Balanced Accuracy` double, `ROC AUC` double, `Statistical Parity Difference` double, "
              "`Disparate Impact` double, `Equal Opportunity Difference` double, "
              "`Average Odds Difference` double, `Seconds` double")
    cols = [c.split("`")[1] for c in schema.split(", ") if "`" in c]
    return spark.createDataFrame([tuple(r.get(c) for c in cols) for r in records], schema)


def _run_dataset(spark, df, spec: DatasetSpec, tasks: list, configs: list[dict], key: str, cv_folds: int, parallelism: int, rounds, patience) -> list[dict]:
    def prepare(task):
        _, attrs, _, run = task
        job_pool(spark, "grid", f"grid {spec.name} {'_'.join(attrs)} run {run}")
        return _prepared(df, spec, attrs, run, key)

    # tasks and mitigations are independent Spark jobs: submitted from driver threads, the scheduler interleaves them
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        ready = list(pool.map(prepare, tasks))
        strategies = list(dict.fromkeys(c["strategy"] for c in configs))
        usable = [i for i, (split, _, _) in enumerate(ready) if has_two_classes(split.where("split = 'train'"), spec.target)]  # J5

        def mitigated(pair):
            i, strategy = pair
            split, features, sens = ready[i]
            job_pool(spark, "grid", f"grid {spec.name} task {i} {strategy}")
            rows = mt.mitigate(split.where(F.col("split") == "train").drop("split"), strategy, spec.target, sens, 1, [0], 42 + tasks[i][3], key, features=features)
            return pp.model_matrix(rows, features, spec.target, extra=[key, sens])

        pairs = [(i, s) for i in usable for s in strategies]
        training = dict(zip(pairs, pool.map(mitigated, pairs)))
    cells = {pair: n for n, pair in enumerate(pairs)}
    together = [m for m in dict.fromkeys(c["model"] for c in configs) if md.lockstep(m)]
    fitted = md.fit_fleet([(cells[pair], *training[pair]) for pair in pairs], spec.target, together, key, 42, cv_folds, rounds, patience) if pairs and together else {}

    scored, records, metrics = [], {}, {}
    for i in usable:
        (_, attrs, privileged, run), (split, features, sens) = tasks[i], ready[i]
        test = split.where(F.col("split") == "test").drop("split")
        own = [(n, c) for n, c in enumerate(configs)]
        for n, c in own:
            records[i * len(configs) + n] = {
                "Dataset": spec.name, "Model Type": c["model"], "Mitigation Technique": c["technique"], "Mitigation Detail": c["detail"], "Run Number": run,
                "Sensitive Attributes": ", ".join(attrs), "Privileged Value": str(privileged)}
        matrix, _ = pp.model_matrix(test, features, spec.target, extra=[key, sens])
        chances = []
        for n, c in own:
            at = i * len(configs) + n
            if (cells[i, c["strategy"]], c["model"]) not in fitted:
                metrics[at] = _alone(split, test, spec, sens, features, c, 42 + run, key, cv_folds)
                continue
            model, mean, _ = fitted[cells[i, c["strategy"]], c["model"]]
            missing = [f for f in model.features if f not in matrix.columns]
            matrix = matrix.withColumns({f: F.lit(0.0) for f in missing}) if missing else matrix
            chances.append((at, model.members[0][0], list(model.features)))
            records[at]["CV Mean Accuracy"] = mean if cv_folds else None
        if chances:
            wide = matrix.select(F.col(sens).alias("sens"), F.col(spec.target).alias("y"), _chances(chances).alias("all"))
            scored.append(wide.select("sens", "y", F.explode("all").alias("one")).select("one.config", "sens", "y", "one.probability", (F.col("one.probability") > 0.5).cast("int").alias("prediction")))
    if scored:
        metrics |= _measured(cut_lineage(reduce(DataFrame.unionByName, scored)))
    return [r | metrics.get(at, {}) for at, r in sorted(records.items())]


def _alone(split, test, spec, sens, features, c: dict, seed: int, key: str, cv_folds: int) -> dict:
    """Metrics of a configuration whose model is a registered estimator."""
    train = split.where(F.col("split") == "train").drop("split")
    table, _ = au.run_experiment(train, test, spec.target, sens, 1, [0], features, c["model"], c["strategy"], "combined", "all", seed, key, cv_folds)
    found = {r["metric"]: r["value"] for r in table.collect()}  # one row a metric
    return {k.removeprefix("Test "): v for k, v in found.items() if not k.startswith("Train ")}


def write_results(df: DataFrame, directory: str, fmt: str = "csv") -> str:
    """Timestamped result folder, partitioned by dataset."""
    path = f"{directory.rstrip('/')}/benchmark_results_{time.strftime('%Y%m%d_%H%M%S')}"
    w = df.write.mode("overwrite").partitionBy("Dataset")
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))
    return path

