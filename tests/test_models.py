"""Spark ML logistic regression equals the C = 1 penalised objective the reference fits."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from paritylab.plans import models as md
from paritylab.sources.fixtures import load_view
from tests.conftest import SMALL

FEATS = ["c_acctbal", "n_orders", "max_price"]


def _newton(X, y, iters=50):
    """argmin 0.5 |w|^2 + sum logloss(y, Xw + b) (intercept unpenalised)."""
    n, d = X.shape
    Xb = np.hstack([X, np.ones((n, 1))])
    w = np.zeros(d + 1)
    reg = np.eye(d + 1)
    reg[d, d] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-Xb @ w))
        g = Xb.T @ (p - y) + reg @ w
        H = Xb.T @ (Xb * (p * (1 - p))[:, None]) + reg
        w -= np.linalg.solve(H, g)
    return w


def test_logistic_matches_penalised_objective(spark):
    d = load_view(spark, SMALL, "audit_customers").select("row_id", "y", *FEATS).fillna(0.0, subset=FEATS)
    fitted = md.fit(d, "y", FEATS, "logistic")
    lr = fitted.pipeline.stages[-1]
    spark_w = np.array(list(lr.coefficients) + [lr.intercept])
    feats = fitted.pipeline.stages[:-1]
    x = d.withColumn(md.LABEL, F.col("y").cast("double"))
    for st in feats:
        x = st.transform(x)
    pdf = x.select(vector_to_array(md.FEATURES).alias("f"), "y").toPandas()
    X = np.vstack(pdf["f"].to_numpy())
    w = _newton(X, pdf["y"].to_numpy().astype(float))
    assert np.allclose(spark_w, w, rtol=1e-4, atol=1e-5)


def test_each_model_family_predicts(spark):
    d = load_view(spark, SMALL, "audit_customers").select("row_id", "y", *FEATS).fillna(0.0, subset=FEATS)
    for m in ("random_forest", "svm"):
        fitted = md.fit(d, "y", FEATS, m)
        p = fitted.predict(d, "y")
        r = p.agg(F.min("probability"), F.max("probability"), F.countDistinct("prediction")).first()
        assert 0.0 <= r[0] <= r[1] <= 1.0


def test_boosting_stops_after_patience(spark):
    assert md.stop_round([3.0, 2.0, 2.5, 2.5, 2.5], 3) == 5
    assert md.stop_round([3.0, 2.0, 2.5, 1.0], 3) is None
    assert md.stop_round([], 3) is None
    d = load_view(spark, SMALL, "audit_customers").select("row_id", "y", *FEATS).fillna(0.0, subset=FEATS)
    fitted = md.fit(d, "y", FEATS, "gbm", rounds=3, patience=1)
    assert 2 <= fitted.members[0][0].getNumTrees <= 3
    assert fitted.predict(d, "y").columns == ["row_id", "y", *FEATS, md.LABEL, "probability", "prediction"]


def test_models_can_be_registered(spark):
    from pyspark.ml.classification import NaiveBayes
    import pytest

    with pytest.raises(ValueError, match="no model named"):
        md.classifier("bayes", 10)
    md.register_model("bayes", lambda n, seed: NaiveBayes(featuresCol=md.FEATURES, labelCol=md.LABEL, modelType="gaussian"))
    try:
        d = load_view(spark, SMALL, "audit_customers").select("row_id", "y", *FEATS).fillna(0.0, subset=FEATS)
        p = md.fit(d, "y", FEATS, "bayes").predict(d, "y")
        assert p.where("probability BETWEEN 0 AND 1").count() == d.count()
    finally:
        md._MODELS.pop("bayes")


def test_cross_validation_counts_rows_of_every_fold(spark):
    d = load_view(spark, SMALL, "audit_customers").select("row_id", "y", *FEATS).fillna(0.0, subset=FEATS)
    mean, std = md.cross_validate(d, "y", FEATS, "logistic", k=3)
    assert 0.5 < mean <= 1.0 and 0.0 <= std < 0.5
    assert md.cross_validate(d.where("y = 1"), "y", FEATS, "logistic", k=3) == (0.0, 0.0)


def test_registered_grid_is_the_whole_grid(spark, monkeypatch):
    from paritylab.plans import grid as gd
    import __spark_entry__ as entry
    from tests.conftest import SMOKE

    asked = []

    class Fixed:
        @staticmethod
        def probability():
            return F.lit(0.6)

    def fit_fleet(tables, target, names, key, seed, folds, rounds, patience):
        asked.append((len(tables), list(names), folds, rounds, patience))
        return {(i, n): (md.FleetModel(n, [(Fixed, None)], list(f)), 0.5, 0.1) for i, _, f in tables for n in names}

    monkeypatch.setattr(md, "fit_fleet", fit_fleet)
    rows = entry.queries()["grid_customers_logistic"](spark, SMOKE).collect()
    assert asked == [(18, list(gd.GRID_MODELS), 5, 1000, 20)] and len(rows) == 72
    assert {(r["Model Type"], r["Sensitive Attributes"], r["Privileged Value"]) for r in rows} == {
        (m, *a) for m in gd.GRID_MODELS for a in (("segment", "BUILDING"), ("region", "EUROPE"), ("segment, region", "BUILDING_EUROPE"))}
    assert all(r["CV Mean Accuracy"] == 0.5 and r["Recall"] is not None for r in rows)


def test_grid_mixes_lockstep_and_registered_models(spark):
    from pyspark.ml.classification import NaiveBayes
    from paritylab.plans import grid as gd

    md.register_model("bayes", lambda n, seed: NaiveBayes(featuresCol=md.FEATURES, labelCol=md.LABEL, modelType="gaussian"))
    try:
        d = load_view(spark, SMALL, "audit_customers").select("row_id", "y", "segment", *FEATS).persist()
        spec = gd.DatasetSpec("customers", "y", 1, ("segment",), {"segment": "BUILDING"})
        rows = gd.run_grid(spark, {"customers": d}, [spec], configs=gd.grid_configs(("logistic", "bayes"), gd.GRID_MITIGATIONS[:1]), cv_folds=2).collect()
        assert [r["Model Type"] for r in rows] == ["logistic", "bayes"]
        assert all(0.4 < r["Accuracy"] <= 1 and 0.4 < r["CV Mean Accuracy"] <= 1 and r["Disparate Impact"] is not None for r in rows)
    finally:
        md._MODELS.pop("bayes")


def test_grid_scores_all_models_of_a_task_in_one_function(spark):
    from paritylab.plans import grid as gd

    names = list(gd.GRID_MODELS)
    d = load_view(spark, SMALL, "audit_customers").select("row_id", "y", *FEATS).fillna(0.0, subset=FEATS).persist()
    tables = [(0, d, FEATS), (1, d.where("row_id % 2 = 0"), [FEATS[2], FEATS[0]])]
    fitted = md.fit_fleet(tables, "y", names, folds=0, rounds=3, patience=2)
    own = [(10 * cell + i, fitted[cell, n][0].members[0][0], features) for cell, _, features in tables for i, n in enumerate(names)]
    scores = d.select("row_id", F.explode(gd._chances(own)).alias("one")).select("row_id", "one.*")
    got = {(r["row_id"], r["config"]): r["probability"] for r in scores.collect()}
    want = d.select("row_id", *[m.probability().alias(str(at)) for at, m, _ in own]).collect()
    assert len(got) == len(want) * len(own)
    assert max(abs(got[r["row_id"], at] - r[str(at)]) for r in want for at, _, _ in own) < 1e-12
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "exp(" not in plan.lower()
    d.unpersist()
