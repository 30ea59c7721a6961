"""Invariants of the operators on the provided tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from paritylab.operators import evaluate as ev
from paritylab.operators import fairness as fm
from paritylab.operators import mitigate as mt
from paritylab.operators import results as rs
from paritylab.operators.ranking import hash_rank
from paritylab.operators.split import stratified_split
from paritylab.functions.hashing import hash_key
from paritylab.sources.fixtures import load_view
from tests.conftest import SMALL


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    out = entry.entry(spark)
    assert out.columns == ["group", "spd", "di", "eod", "aod"]
    assert out.count() >= 1


def test_bucketed_rank_equals_row_number(spark):
    d = load_view(spark, SMALL, "audit_orders").select("row_id", "segment")
    fast = hash_rank(d, ["segment"], 42, bits=6).select("row_id", "rank")
    w = Window.partitionBy("segment").orderBy(hash_key(42, "row_id"), "row_id")
    slow = d.select("row_id", F.row_number().over(w).alias("rank"))
    assert fast.exceptAll(slow).count() == 0 and slow.exceptAll(fast).count() == 0


def test_split_is_partition_with_quotas(spark):
    d = load_view(spark, SMALL, "audit_orders").select("row_id", "segment", "y")
    s = stratified_split(d, ["y", "segment"], 0.2, 42)
    assert s.count() == d.count() and s.select("row_id").distinct().count() == d.count()
    n_test = s.where("split = 'test'").count()
    assert n_test == -(-d.count() * 2 // 10)  # ceil(0.2 n)


def test_cda_doubles_and_equalises_label_parity(spark):
    d = load_view(spark, SMALL, "audit_customers").select("row_id", "segment", "y")
    d2 = d.where(F.col("segment").isin("BUILDING", "AUTOMOBILE"))
    out = mt.counterfactual_augment(d2, "y", "segment", "BUILDING", ["AUTOMOBILE"])
    assert out.count() == 2 * d2.count()
    spd = fm.fairness_metrics(out, "segment", "BUILDING", label="y").first()["spd"]
    assert abs(spd) < 1e-12


def test_undersample_subset(spark):
    d = load_view(spark, SMALL, "audit_customers").select("row_id", "segment", "y")
    out = mt.resample(d, "y", "segment", "undersample", 1)
    assert out.exceptAll(d).count() == 0


def test_relabel_hits_goal(spark):
    d = load_view(spark, SMALL, "audit_orders").select("row_id", "segment", "y", "score")
    plan = mt.relabel_plan(d, "y", "segment", "BUILDING")
    out = mt.relabel(d, "y", "segment", "BUILDING", score="score")
    r = d.agg(F.avg("y")).first()[0]
    role = mt._role("segment", "BUILDING", None)
    got = out.withColumn("role", role).groupBy("role").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()
    for row in got:
        if row["role"] is not None:
            assert row["p"] == int(row["n"] * r)
    assert plan


def test_auc_symmetry(spark):
    d = load_view(spark, SMALL, "audit_orders")
    a = ev.roc_auc(d, "y", "score").first()["roc_auc"]
    b = ev.roc_auc(d.withColumn("neg", -F.col("score")), "y", "neg").first()["roc_auc"]
    assert abs(a + b - 1.0) < 1e-12


def test_pareto_non_dominated(spark):
    g = load_view(spark, SMALL, "grid_results")
    front = rs.pareto_frontier(g).collect()
    pts = [(r["Dataset"], r["Accuracy"], abs(r["Statistical Parity Difference"])) for r in g.collect()]
    for r in front:
        x, y = r["Accuracy"], abs(r["Statistical Parity Difference"])
        assert not any(d == r["Dataset"] and (ox >= x and oy <= y) and (ox > x or oy < y) for d, ox, oy in pts)
