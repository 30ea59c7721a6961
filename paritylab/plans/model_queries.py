"""Registered dataset-spec, sampling, training, audit and grid queries.

Fitted models (T*, M4, B3) have no SQL twin: they are rows-only checks, and tests hold them against plain versions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paritylab.plans import audit as au
from paritylab.plans import fleet as fl
from paritylab.plans import grid as gd
from paritylab.plans import models as md
from paritylab.plans import newton as nw
from paritylab.plans.mitigation_queries import h
from paritylab.plans.registry import register, view, with_views
from paritylab.sources.fixtures import load_table

# Registry label mapping and derived bucket
register("apply_spec_orders", """
SELECT o_orderkey AS row_id, CAST(COALESCE(lower(CAST(o_orderstatus AS VARCHAR)) = 'f', FALSE) AS INTEGER) AS o_orderstatus,
       CASE WHEN o_totalprice > 150000 THEN 'aged' ELSE 'young' END AS price_cat FROM orders""")(
    lambda spark, sf: gd.apply_spec(load_table(spark, sf, "orders"),
                                    gd.DatasetSpec("orders", "o_orderstatus", "F", ("o_orderpriority",), {}))
    .select(F.col("o_orderkey").alias("row_id"), "o_orderstatus",
            gd.threshold_bucket("o_totalprice", 150000, "aged", "young").alias("price_cat")))

# Exact-n sample without replacement (the limit IS the operator)
register("sample_n_orders", with_views("", "audit_orders").rstrip() + f""",
r AS (SELECT row_id, segment, ROW_NUMBER() OVER (ORDER BY {h('42', 'row_id')}, row_id) AS rn FROM audit_orders)
SELECT row_id, segment FROM r WHERE rn <= 1000""")(
    lambda spark, sf: gd.sample_n(view(spark, sf, "audit_orders").select("row_id", "segment"), 1000, 42))

_CUST_FEATURES = ["c_acctbal", "n_orders", "max_price"]


# M4: ranker probability per row
@register("rank_score_customers")
def _rank(spark, sf):
    d = view(spark, sf, "audit_customers")
    return md.rank_score(d, "y", _CUST_FEATURES).select("row_id", F.round("_rank_prob", 6).alias("rank_prob"))


# Train a logistic model on the customer view, metrics as a long table
@register("train_logistic_customers")
def _train(spark, sf):
    d = view(spark, sf, "audit_customers").select("row_id", "y", *_CUST_FEATURES)
    d = d.fillna(0.0, subset=_CUST_FEATURES).persist()
    res = md.train(d, "y", _CUST_FEATURES, "logistic")
    test = md.evaluate_model(res.model, res.test, "y")
    rows = [(k, float(v)) for k, v in res.train_metrics.items()] + [(f"Test {k}", float(v)) for k, v in test.items()]
    return spark.createDataFrame(rows, "metric string, value double")


# The lockstep solutions are optima, those of every fold and every calibration member, and folds are stratified
@register("newton_optima_customers", with_views("", "audit_customers").rstrip() + """,
p AS (SELECT y, ROW_NUMBER() OVER (PARTITION BY y ORDER BY row_id) - 1 AS place FROM audit_customers WHERE y IS NOT NULL),
m AS (SELECT range AS m FROM range(0, 6)), j AS (SELECT range AS j FROM range(0, 5))
SELECT 'logistic' AS family, CAST(m AS INTEGER) AS model, (SELECT COUNT(*) FROM p WHERE place % 5 <> m) AS n_rows, TRUE AS at_optimum FROM m
UNION ALL SELECT 'svm', CAST(m * 5 + j AS INTEGER), (SELECT COUNT(*) FROM p WHERE place % 5 <> m AND (place // 5) % 5 <> j), TRUE FROM m, j""")
def _optima(spark, sf):
    d = view(spark, sf, "audit_customers").select("row_id", "y", *_CUST_FEATURES).fillna(0.0, subset=_CUST_FEATURES)
    fleet = fl.build([(0, d, _CUST_FEATURES)], "y")
    rows = [(f, m, n, g < 1e-6) for f, found in (("logistic", nw.logistic_coefficients(fleet)), ("svm", nw.svm_weights(fleet)))
            for _, m, n, g in nw.optimality(fleet, found, f)]
    fleet.release()
    return spark.createDataFrame(rows, "family string, model int, n_rows bigint, at_optimum boolean")


_SPEC = au.AuditSpec(attrs=["segment"], privileged="BUILDING", mode="individual", model="logistic")
_PREP = au.PrepSpec(missing="mean", outliers="iqr", encoding="one-hot",
                    selected_features=["region", "c_acctbal", "n_orders", "max_price", "segment"])


# Baseline audit (individual mode) on the customer view
@register("baseline_audit_customers")
def _baseline(spark, sf):
    return au.baseline_audit(view(spark, sf, "audit_customers").persist(), "y", _PREP, _SPEC)["metrics"]


# T10 + M8: mitigation audit with undersampling
@register("mitigation_audit_customers")
def _mitig(spark, sf):
    return au.mitigation_audit(view(spark, sf, "audit_customers").persist(), "y", _PREP, _SPEC,
                               "undersample")["metrics"]


# Grid of the four models over the six mitigations on the customer view, for each attribute and their
# composite, with the operator's own folds (the name is from when it ran the logistic model alone)
@register("grid_customers_logistic")
def _grid(spark, sf):
    spec = gd.DatasetSpec("customers", "y", 1, ("segment", "region"), {"segment": "BUILDING", "region": "EUROPE"})
    d = view(spark, sf, "audit_customers").persist()
    res = gd.run_grid(spark, {"customers": d}, [spec], runs=1)
    return res.drop("Seconds")


# M3 + M4: relabeling ranked by the logistic ranker, as the reference runs it
@register("relabel_ranker_customers")
def _relabel_ranker(spark, sf):
    from paritylab.operators import mitigate as mt
    d = view(spark, sf, "audit_customers").select("row_id", "segment", "y", *_CUST_FEATURES).persist()
    out = mt.mitigate(d, "relabel", "y", "segment", "BUILDING", features=_CUST_FEATURES)
    return out.select("row_id", "segment", "y")
