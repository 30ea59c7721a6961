import pytest
from pyspark.sql import functions as F

from paritylab.operators import rules as rl
from paritylab.plans.spec import detect_sensitive, metric_families, parse_attributes


def test_detect_sensitive():
    assert detect_sensitive(["Age", "Race", "x"]) == "Race"
    assert detect_sensitive(["x", "sex", "age"]) == "sex"
    assert detect_sensitive(["x"]) is None


def test_parse_attributes():
    assert parse_attributes(" a, b ", ["a", "b"]) == ["a", "b"]
    with pytest.raises(ValueError):
        parse_attributes("a, z", ["a"])
    assert metric_families("2") == "odds"


def test_missing_columns_are_named(spark):
    from paritylab.plans.audit import PrepSpec, fit_preprocess
    df = spark.createDataFrame([(1, "a", 1)], "row_id int, g string, y int")
    with pytest.raises(ValueError, match="h"):
        fit_preprocess(df, "y", PrepSpec(), ["h"], "a")
    with pytest.raises(ValueError, match="z"):
        fit_preprocess(df, "z", PrepSpec(), ["g"], "a")


def test_short_lines_are_padded_and_long_ones_fail(spark, tmp_path):
    from paritylab.sources import io
    (tmp_path / "a.csv").write_text("k;v\n1\n2;x\nk;v\n")
    got = io.read_table(spark, str(tmp_path / "a.csv"), sep=";", infer_types=False).collect()
    assert [tuple(r) for r in got] == [("1", None), ("2", "x"), ("k", "v")]
    (tmp_path / "b.csv").write_text("k;v\n1;2;3\n")
    with pytest.raises(Exception, match="more than 2 fields"):
        io.read_table(spark, str(tmp_path / "b.csv"), sep=";", infer_types=False).collect()


def test_methodology_rules(spark):
    sel = spark.createDataFrame([(1, "Drop", "Label Encoding"), (2, "Mean/Median", "One-Hot Encoding")],
                                "audit_id int, missing_values string, encoding string")
    out = {(r["audit_id"], r["category"]) for r in rl.methodology_rules(sel).collect()}
    assert out == {(1, "Missing Data Bias"), (1, "Encoding Choice")}


def test_unknown_model_and_strategy(spark):
    from paritylab.operators.mitigate import mitigate
    from paritylab.plans.models import classifier
    with pytest.raises(ValueError):
        classifier("nope", 10)
    df = spark.createDataFrame([(1, "a", 1)], "row_id int, g string, y int")
    with pytest.raises(ValueError):
        mitigate(df, "nope", "y", "g", "a")


def test_reader_and_first_name_helpers(spark):
    from paritylab.operators.prep import pick_first
    from paritylab.sources import io

    assert pick_first(["a", "b", "a"], "a") == 0 and pick_first(["a", "b"], "b") == 1
    io.register_reader("Probe", lambda s, path: s.range(3).withColumn("path", F.lit(path)))
    try:
        assert {r["path"] for r in io.read_table(spark, "rows.probe").collect()} == {"rows.probe"}
    finally:
        io._READERS.pop("probe")
