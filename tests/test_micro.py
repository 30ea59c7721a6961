"""Hand-computed edge cases (FIXTURES.md section 3)."""

import math

import pytest
from pyspark.sql import functions as F

from paritylab.functions.stats import parity_p_value
from paritylab.operators import evaluate as ev
from paritylab.operators import fairness as fm
from paritylab.operators import mitigate as mt
from paritylab.operators import prep as pp
from paritylab.operators import results as rs


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_h1_parity(spark):
    df = rows(spark, [(i, "a", p) for i, p in enumerate([1, 1, 0, 0])] +
              [(10 + i, "b", p) for i, p in enumerate([1, 0, 0, 0])], "row_id int, g string, yhat int")
    r = fm.fairness_metrics(df, "g", "a", pred="yhat", mode="combined").first()
    assert r["spd"] == pytest.approx(-0.25)
    assert r["di"] == pytest.approx(0.5)


def test_h2_odds(spark):
    a = [(1, 1), (1, 1), (0, 1), (0, 0)]
    b = [(1, 1), (1, 0), (0, 0), (0, 0)]
    df = rows(spark, [("a", y, p) for y, p in a] + [("b", y, p) for y, p in b], "g string, y int, yhat int")
    r = fm.fairness_metrics(df, "g", "a", label="y", pred="yhat", mode="individual").first()
    assert r["group"] == "b"
    assert r["eod"] == pytest.approx(-0.5)
    assert r["aod"] == pytest.approx(-0.5)


def test_h3_zero_denominator(spark):
    df = rows(spark, [("a", 0), ("a", 0), ("b", 1)], "g string, yhat int")
    r = fm.fairness_metrics(df, "g", "a", pred="yhat").first()
    assert r["spd"] == pytest.approx(1.0)
    assert r["di"] is None


def test_h4_h5_ztest(spark):
    df = spark.range(1).select(
        parity_p_value(F.lit(100), F.lit(0.6), F.lit(100), F.lit(0.4)).alias("p"),
        parity_p_value(F.lit(100), F.lit(1.0), F.lit(100), F.lit(1.0)).alias("p1"))
    r = df.first()
    assert r["p"] == pytest.approx(0.004678, abs=1e-6)
    assert r["p1"] == 1.0


def test_h6_mode_tie(spark):
    df = rows(spark, [("b",), ("a",), (None,), ("a",), ("b",)], "v string")
    assert pp.Imputer("mode", ["v"]).fit(df).fill["v"] == "a"


def test_h7_iqr_skip(spark):
    df = rows(spark, [(float(i),) for i in range(9)], "x double")  # 9 distinct values
    t = pp.IqrTrimmer("remove", ["x"]).fit(df)
    assert t.bounds == {}
    df2 = rows(spark, [(5.0,)] * 40 + [(float(i),) for i in range(10)], "x double")  # IQR = 0
    assert pp.IqrTrimmer("remove", ["x"]).fit(df2).bounds == {}


def test_h8_clip_null(spark):
    df = rows(spark, [(None,), (0.0,), (5.0,)], "x double")
    t = pp.IqrTrimmer("clip", ["x"])
    t.bounds = {"x": (1.0, 2.0)}
    assert [r["x"] for r in t.transform(df).collect()] == [None, 1.0, 2.0]


def test_h9_label_encode(spark):
    df = rows(spark, [(1, "b"), (2, None), (3, "a")], "row_id int, c string")
    out = pp.LabelEncode(["c"]).fit_transform(df).orderBy("row_id").collect()
    assert [r["c"] for r in out] == [1, 2, 0]
    assert [r["c_raw"] for r in out] == ["b", None, "a"]


def test_h10_composite(spark):
    df = rows(spark, [("x", None)], "a string, b string")
    out, name = pp.add_composite(df, ["a", "b"])
    assert name == "a_b" and out.first()[name] == "x_nan"


def _h11(spark):
    data = [(i, "a", 1) for i in range(4)] + [(10 + i, "b", 0) for i in range(4)]
    return rows(spark, data, "row_id int, g string, y int")


def test_h11_undersample(spark):
    out = mt.resample(_h11(spark), "y", "g", "undersample", 7)
    counts = {(r["g"], r["y"]): r["count"] for r in out.groupBy("g", "y").count().collect()}
    assert counts == {("a", 1): 2, ("b", 0): 2}


def test_h12_oversample(spark):
    out = mt.resample(_h11(spark), "y", "g", "oversample", 7)
    counts = {(r["g"], r["y"]): r["count"] for r in out.groupBy("g", "y").count().collect()}
    assert counts == {("a", 1): 2, ("b", 0): 2}


def test_h13_relabel(spark):
    data = [(i, "u", 0, float(i)) for i in range(4)] + [(10 + i, "p", 1, float(i)) for i in range(4)]
    df = rows(spark, data, "row_id int, g string, y int, score double")
    out = {r["row_id"]: r["y"] for r in mt.relabel(df, "y", "g", "p", score="score").collect()}
    assert [out[i] for i in range(4)] == [0, 0, 1, 1]          # top-scored unprivileged flipped up
    assert [out[10 + i] for i in range(4)] == [0, 0, 1, 1]     # lowest-scored privileged flipped down


def test_h14_cda(spark):
    df = rows(spark, [(1, "p", 1), (2, "u", 0), (3, "z", 1)], "row_id int, s string, y int")
    out = mt.counterfactual_augment(df, "y", "s", "p", ["u"]).collect()
    assert len(out) == 6
    assert sorted(r["s"] for r in out[3:]) == ["p", "u", "z"]
    assert out[0].__fields__[-1] == "y"


def test_h15_auc(spark):
    df = rows(spark, [(0, 1.0), (1, 2.0), (0, 2.0), (1, 3.0)], "y int, score double")
    assert ev.roc_auc(df, "y", "score").first()["roc_auc"] == pytest.approx(0.875)


def test_h16_pareto(spark):
    df = rows(spark, [("d", 0.9, 0.2), ("d", 0.8, -0.1), ("d", 0.8, 0.1), ("d", 0.7, 0.3)],
              "Dataset string, Accuracy double, spd double")
    out = rs.pareto_frontier(df, "Accuracy", "spd").collect()
    assert sorted((r["Accuracy"], r["spd"]) for r in out) == [(0.8, -0.1), (0.8, 0.1), (0.9, 0.2)]


def test_h17_high_performers(spark):
    df = rows(spark, [("d", "m", f"t{i}", float(v)) for i, v in enumerate([1, 1, 1, 1, 10])],
              "Dataset string, `Model Type` string, `Mitigation Technique` string, Accuracy double")
    out = rs.high_performers(df, "Accuracy").collect()
    assert [r["Accuracy"] for r in out] == [10.0] and out[0]["is_statistical_outlier"]
    df2 = rows(spark, [("d", "m", f"t{i}", float(v)) for i, v in enumerate([1, 2, 3, 4, 5])],
               "Dataset string, `Model Type` string, `Mitigation Technique` string, Accuracy double")
    out2 = rs.high_performers(df2, "Accuracy").collect()
    assert len(out2) == 5 and not any(r["is_statistical_outlier"] for r in out2)


def test_h18_rename_headers():
    assert pp.dedupe_columns(["a", "a", "b", "a"]) == ["a", "a_dup_1", "b", "a_dup_2"]


def test_erf_matches_math(spark):
    from paritylab.functions.stats import erf
    xs = [-3.0, -0.5, 0.0, 0.1, 1.0, 2.5, 5.9, 7.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erf(F.col("x")).alias("e"))
    for r in df.collect():
        assert r["e"] == pytest.approx(math.erf(r["x"]), abs=1e-12)


def test_smote_tiny_subgroup_returns_input(spark):
    from paritylab.operators.smote import smote
    df = rows(spark, [(1, "a", 1, None), (2, "a", 0, 2.0), (3, "a", 0, 3.0), (4, "b", 1, 4.0), (5, "b", 1, 5.0)],
              "row_id int, g string, y int, x double")
    out = smote(df, "y", "g", ["x"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))


def test_smote_balances_subgroups(spark):
    from paritylab.operators.smote import smote
    data = [(i, "a", 1, float(i)) for i in range(6)] + [(10 + i, "a", 0, float(i) * 2) for i in range(3)] + \
           [(20 + i, "b", 1, float(i) + 0.5) for i in range(4)]
    df = rows(spark, data, "row_id int, g string, y int, x double")
    out = smote(df, "y", "g", ["x"], k=2)
    counts = {(r["g"], r["y"]): r["count"] for r in out.groupBy("g", "y").count().collect()}
    assert counts == {("a", 1): 6, ("a", 0): 6, ("b", 1): 6}
    assert out.where("row_id < 0").count() == 5  # 3 + 2 synthetic rows


def test_absent_privileged_group_has_no_p_value(spark):
    from paritylab.operators.fairness import parity_significance

    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "g string, y int")
    rows = parity_significance(df, "g", "nobody", "y").collect()
    assert len(rows) == 0 or all(r["p_value"] is None and r["significant"] is None for r in rows)
    same = {r["group"]: r["p_value"] for r in parity_significance(df.where("y = 1"), "g", "a", "y").collect()}
    assert same == {"b": 1.0}
