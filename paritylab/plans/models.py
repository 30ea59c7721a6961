"""Model training.

The four families train in lockstep on a fleet (``fleet.py``, ``newton.py``, ``trees.py``): the model on all rows and those of the
cross-validation folds take their passes together. Features are z-scored and rows brought to length 1 once per
training table. A model that a user registers is a Spark ML estimator on the same scaled features, fitted fold by fold.

``fit`` of a logistic model and the ranker use Spark ML's logistic regression: C = 1 maps to ``regParam = 1/n`` with
``standardization=False`` (Spark averages the loss over rows); the lockstep trainer finds the same coefficients.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritylab.operators import evaluate as ev
from paritylab.operators import prep as pp
from paritylab.operators.split import stratified_folds, stratified_split, train_val_test
from paritylab.plans import fleet as fl
from paritylab.plans import newton, trees
from paritylab.plans.trees import stop_round  # noqa: F401
from paritylab.session import job_pool

GBM_ROUNDS, GBM_PATIENCE = trees.ROUNDS, trees.PATIENCE
LABEL = "_label"
FEATURES = "_features"
_INPUT = {"featuresCol": FEATURES, "labelCol": LABEL}

# The lockstep trainers: (fleet, rounds, patience) -> {cell: (model, (mean, spread) of the cross-validated accuracy)}.
_LOCKSTEP: dict[str, Callable] = {
    "logistic": lambda fleet, rounds, patience: newton.fit_logistic(fleet),
    "random_forest": lambda fleet, rounds, patience: trees.fit_forest(fleet),
    "gbm": trees.fit_boosting,
    "svm": lambda fleet, rounds, patience: newton.fit_svm(fleet),
    "linear_svc": lambda fleet, rounds, patience: newton.fit_svm(fleet)}
# T5: constructors (rows, seed) -> Spark ML estimator on the scaled features.
_MODELS: dict[str, Callable] = {}


def register_model(name: str, constructor: Callable) -> None:
    """T5: make ``constructor(n_rows, seed)`` known as ``name``; it returns a classifier of (``FEATURES``, ``LABEL``)."""
    _MODELS[name] = constructor


def model_names() -> list[str]:
    return sorted({*_MODELS, *_LOCKSTEP})


def lockstep(name: str) -> bool:
    """Whether ``name`` is one of the lockstep families and no user has put an estimator in its place."""
    return name in _LOCKSTEP and name not in _MODELS


def classifier(name: str, n_rows: int, seed: int = 42):
    """The estimator of a registered model (unknown name -> error)."""
    if name in _MODELS:
        return _MODELS[name](n_rows, seed)
    if name == "logistic":
        return LogisticRegression(**_INPUT, regParam=1.0 / max(n_rows, 1), elasticNetParam=0.0, standardization=False, maxIter=10000, tol=1e-8)
    raise ValueError(f"no model named {name!r} in Spark ML; there are {', '.join(model_names())}")


def feature_stages(features: Sequence[str]) -> list:
    return [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep"),
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
            Normalizer(inputCol="_scaled", outputCol=FEATURES, p=2.0)]


def fit_scaler(df: DataFrame, features: Sequence[str]) -> PipelineModel:
    """The fitted assembler, z-score and L2 stages: fitted once per training table and shared by the model, its
    calibration members and every cross-validation fold."""
    return Pipeline(stages=feature_stages(features)).fit(df)


@dataclass
class FittedModel:
    """``members`` are (classifier, sigmoid or None); P(1) is their mean. ``scaler`` is None for rows that hold
    ``FEATURES`` already."""

    name: str
    scaler: PipelineModel | None
    members: list
    features: list = field(default_factory=list)

    @property
    def pipeline(self) -> PipelineModel:
        """Scaling and the classifier of a model with one uncalibrated member."""
        return PipelineModel(stages=[*self.scaler.stages, self.members[0][0]])

    def predict(self, df: DataFrame, target: str | None = None) -> DataFrame:
        """Adds ``prediction`` (int) and ``probability`` (P(1), double); with several members class 1 is a mean
        probability over 0.5."""
        d = df if target is None or LABEL in df.columns else df.withColumn(LABEL, F.col(target).cast("double"))
        out = self.scaler.transform(d) if self.scaler is not None else d
        probs = []
        for i, member in enumerate(self.members):
            out = _score(out, *member, f"_p{i}", f"_y{i}")
            probs.append(F.col(f"_p{i}"))
        mean = sum(probs[1:], probs[0]) / F.lit(float(len(probs)))
        label = F.col("_y0") if len(probs) == 1 else (mean > 0.5)
        scratch = ["_raw", "_scaled", FEATURES] if self.scaler is not None else []
        return out.withColumns({"probability": mean, "prediction": label.cast("int")}) \
                  .drop(*scratch, *[f"_p{i}" for i in range(len(probs))], *[f"_y{i}" for i in range(len(probs))])


def _score(df: DataFrame, model, sigmoid, prob: str, label: str) -> DataFrame:
    """``df`` with P(1) and the class of one member."""
    out = model.transform(df)
    if sigmoid is not None:
        out = sigmoid.transform(out.withColumn("_margin", vector_to_array("rawPrediction")[1])
                                .drop("probability", "prediction", "rawPrediction"))
    return out.withColumns({prob: vector_to_array("probability")[1], label: F.col("prediction")}) \
              .drop("rawPrediction", "probability", "prediction", "_margin", "_margin_vec")


@dataclass
class FleetModel:
    """A model of a fleet. ``members`` holds it as (model, None)."""

    name: str
    members: list
    features: list = field(default_factory=list)

    def predict(self, df: DataFrame, target: str | None = None) -> DataFrame:
        """Adds ``probability`` (P(1), double) and ``prediction`` (int): class 1 is a probability over 0.5."""
        d = df if target is None or LABEL in df.columns else df.withColumn(LABEL, F.col(target).cast("double"))
        d = d.withColumn("probability", self.members[0][0].probability())
        return d.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))


def fit_fleet(tables: Sequence[tuple[int, DataFrame, Sequence[str]]], target: str, names: Sequence[str], key: str = "row_id", seed: int = 42,
              folds: int = 5, rounds: int = GBM_ROUNDS, patience: int | None = GBM_PATIENCE) -> dict[tuple[int, str], tuple[FleetModel, float, float]]:
    """Every lockstep family in ``names`` on every table (number, rows, features): (model on all rows, mean and spread of the
    cross-validated accuracy; 0 and 0 where a fold is empty or leaves a single class, or ``folds`` is 0)."""
    names = list(dict.fromkeys(names))
    if wrong := [n for n in names if not lockstep(n)]:
        raise ValueError(f"no lockstep model named {wrong[0]!r}; there are {', '.join(sorted(_LOCKSTEP))}")
    fleet = fl.build(tables, target, key, seed, folds)
    try:
        # a pass is short and waits for its job: the families' passes run side by side
        with ThreadPoolExecutor(max_workers=max(1, len(names))) as pool:
            fitted = dict(zip(names, pool.map(lambda n: _LOCKSTEP[n](fleet, rounds, patience), names)))
    finally:
        fleet.release()
    return {(cell, name): (FleetModel(name, [(model, None)], list(fleet.cells[cell].features)), mean, spread)
            for name, own in fitted.items() for cell, (model, (mean, spread)) in own.items()}


def _scaled(df: DataFrame, target: str, scaler: PipelineModel, key: str) -> DataFrame:
    x = scaler.transform(df.withColumn(LABEL, F.col(target).cast("double")))
    return x.select(LABEL, FEATURES, *[k for k in [key] if k in df.columns])


def fit(df: DataFrame, target: str, features: Sequence[str], model: str = "logistic",
        seed: int = 42, n_rows: int | None = None, key: str = "row_id", scaler: PipelineModel | None = None,
        rounds: int = GBM_ROUNDS, patience: int | None = GBM_PATIENCE) -> FittedModel | FleetModel:
    """Scale (unless ``scaler`` is given) and fit; ``rounds`` and ``patience`` are those of boosting."""
    if lockstep(model) and model != "logistic":
        return fit_fleet([(0, df, features)], target, [model], key, seed, 0, rounds, patience)[0, model][0]
    scaler = scaler or fit_scaler(df, features)
    x = _scaled(df, target, scaler, key).persist()
    try:
        n = n_rows if n_rows is not None else x.count()
        return FittedModel(model, scaler, [(classifier(model, n, seed).fit(x), None)], list(features))
    finally:
        x.unpersist()


def evaluate_model(fitted: FittedModel | FleetModel, df: DataFrame, target: str) -> dict:
    """Predict and compute E1-E6 (one confusion aggregate + exact AUC)."""
    pred = fitted.predict(df, target).select(target, "prediction", "probability").cache()
    perf = ev.performance(pred, target, "prediction").first().asDict()
    auc = ev.roc_auc(pred, target, "probability").first()["roc_auc"]
    pred.unpersist()
    out = {"Accuracy": perf["accuracy"], "Precision": perf["precision"], "Recall": perf["recall"],
           "F1": perf["f1"], "Balanced Accuracy": perf["balanced_accuracy"]}
    if auc is not None:
        out["ROC AUC"] = auc
    return out


def cross_validate(df: DataFrame, target: str, features: Sequence[str], model: str = "logistic",
                   k: int = 5, seed: int = 42, key: str = "row_id", parallelism: int = 5,
                   scaler: PipelineModel | None = None, rounds: int = GBM_ROUNDS,
                   patience: int | None = GBM_PATIENCE) -> tuple[float, float]:
    """Stratified k-fold accuracy mean and population std; (0, 0) where a fold is empty or leaves a single
    class to train on. Any other failure is raised. Rows are scaled once, before they are dealt into folds, and copies of
    a row share a fold.

    The lockstep families fit all folds together; a registered estimator's k fits are Spark jobs from k driver threads."""
    if lockstep(model):
        return fit_fleet([(0, df, features)], target, [model], key, seed, k, rounds, patience)[0, model][1:]
    x = _scaled(df, target, scaler or fit_scaler(df, features), key)
    folded = stratified_folds(x, [LABEL], k, seed, key).persist()
    try:
        cells = folded.groupBy("fold", LABEL).agg(F.count(F.lit(1)).alias("n")).collect()  # folds x classes
        rows = {f: sum(r["n"] for r in cells if r["fold"] != f) for f in range(k)}
        for f in range(k):
            if len({r[LABEL] for r in cells if r["fold"] != f}) < 2 or not any(r["fold"] == f for r in cells):
                return 0.0, 0.0

        def one(f: int) -> float:
            job_pool(df.sparkSession, "cv", f"cv fold {f}")
            fitted = classifier(model, rows[f], seed).fit(folded.where(F.col("fold") != f))
            scored = FittedModel(model, None, [(fitted, None)]).predict(folded.where(F.col("fold") == f))
            return scored.agg(F.avg((F.col("prediction") == F.col(LABEL)).cast("double"))).first()[0]

        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, k))) as pool:
            accs = list(pool.map(one, range(k)))
    finally:
        folded.unpersist()
    mean = sum(accs) / k
    return mean, (sum((a - mean) ** 2 for a in accs) / k) ** 0.5


@dataclass
class TrainingResult:
    model: FittedModel | FleetModel
    train: DataFrame
    val: DataFrame
    test: DataFrame
    train_metrics: dict
    test_predictions: DataFrame


def train(df: DataFrame, target: str, features: Sequence[str], model: str = "logistic",
          test: DataFrame | None = None, seed: int = 42, key: str = "row_id",
          cv_folds: int = 5, rounds: int = GBM_ROUNDS, patience: int | None = GBM_PATIENCE) -> TrainingResult:
    """Split (60/20/20, or 75/25 of ``df`` when ``test`` is given), scale once on train, fit and cross-validate the
    model on the scaled rows, score val/test."""
    if test is None:
        parts = train_val_test(df, target, 0.2, 0.25, seed, key).cache()
        tr = parts.where(F.col("split") == "train").drop("split")
        va = parts.where(F.col("split") == "val").drop("split")
        te = parts.where(F.col("split") == "test").drop("split")
    else:
        parts = stratified_split(df, [target], 0.25, f"{seed}v", key, fallback=[],
                                 labels=("train", "val")).cache()
        tr = parts.where(F.col("split") == "train").drop("split")
        va = parts.where(F.col("split") == "val").drop("split")
        te = test
    if lockstep(model):
        fitted, mean, std = fit_fleet([(0, tr, features)], target, [model], key, seed, cv_folds, rounds, patience)[0, model]
    else:
        scaler = fit_scaler(tr, features)
        fitted = fit(tr, target, features, model, seed, key=key, scaler=scaler)
        mean, std = cross_validate(tr, target, features, model, cv_folds, seed, key, scaler=scaler) if cv_folds else (0.0, 0.0)
    metrics = {f"Train {k}": v for k, v in evaluate_model(fitted, tr, target).items()}
    if cv_folds:
        metrics["CV Mean Accuracy"], metrics["CV Std Accuracy"] = mean, std
    return TrainingResult(fitted, tr, va, te, metrics, fitted.predict(te, target))


def rank_score(df: DataFrame, target: str, features: Sequence[str] | None = None,
               key: str = "row_id", out: str = "_rank_prob") -> DataFrame:
    """M4: P(1) of a logistic ranker on the numeric features (mean-imputed,
    z-scored, L2-normalised), appended as ``out``."""
    cand = features if features is not None else [c for c in df.columns if c != target]
    num = [c for c in pp.numeric_columns(df, cand) if c not in (target, key)]
    if not num:
        return df.withColumn(out, F.lit(0.5))
    imp = pp.Imputer("mean", num).fit(df)
    # imputed copies under private names: the scored frame keeps every input
    # column, so no join back to the input is needed
    work = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(float(imp.fill.get(c) or 0.0)))
                            .alias(f"_f_{c}") for c in num])
    work = work.withColumn(LABEL, F.col(target).cast("double"))
    n = work.count()
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, regParam=1.0 / max(n, 1),
                            standardization=False, maxIter=1000)
    pipe = Pipeline(stages=[*feature_stages([f"_f_{c}" for c in num]), lr]).fit(work)
    scored = pipe.transform(work).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*df.columns, out)
