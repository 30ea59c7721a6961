"""Sources/sinks, remaining preprocessing helpers and composed plans."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from paritylab.operators import prep as pp
from paritylab.operators import profile as pf
from paritylab.operators import results as rs
from paritylab.plans import audit as au
from paritylab.plans import grid as gd
from paritylab.sources import io
from paritylab.sources.fixtures import load_view
from tests.conftest import SMOKE


def _orders(spark):
    return load_view(spark, SMOKE, "audit_orders")


def test_delimiter_inference_and_retry(spark):
    d = _orders(spark).select("row_id", "segment", "o_totalprice")
    path = os.path.join(tempfile.mkdtemp(prefix="paritylab-io-"), "semi.csv")
    d.coalesce(1).write.option("header", True).option("sep", ";").csv(path)
    assert io.infer_delimiter(spark, path) == ";"
    back = io.read_table(spark, path)            # comma read gives one column -> retried with ';'
    assert back.columns == ["row_id", "segment", "o_totalprice"]
    assert dict(back.dtypes)["row_id"] == "bigint" and dict(back.dtypes)["o_totalprice"] == "double"
    assert back.count() == d.count()


def test_duplicate_headers_get_suffixes(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="paritylab-io-"), "dup.csv")
    spark.createDataFrame([("1", "2", "3")], "a string, b string, c string") \
        .toDF("a", "a", "b").coalesce(1).write.option("header", True).csv(path)
    assert io.read_table(spark, path).columns == ["a", "a_dup_1", "b"]


def test_results_sink_and_source(spark):
    g = load_view(spark, SMOKE, "grid_results")
    out = gd.write_results(g, tempfile.mkdtemp(prefix="paritylab-res-"))
    back = rs.read_results(spark, out)
    assert back.count() == g.count()
    with pytest.raises(ValueError):
        rs.check_results(g.drop("Accuracy"))


def test_validate_dataset(spark):
    ok, _ = pf.validate_dataset(_orders(spark))
    assert ok
    assert not pf.validate_dataset(_orders(spark).select("row_id"))[0]
    assert not pf.validate_dataset(_orders(spark).limit(0))[0]


def test_text_target_and_remaining(spark):
    d = _orders(spark).select("row_id", "status", "segment", F.col("region").alias("target"))
    enc = pp.encode_target(d, "target")
    assert dict(enc.dtypes)["target"] == "int"
    assert sorted(r["target"] for r in enc.select("target").distinct().collect()) == [0, 1, 2, 3, 4]
    assert "status" not in pp.handle_remaining(d, ["status"], "drop").columns
    assert dict(pp.handle_remaining(d, ["status"], "label").dtypes)["status"] == "int"


def test_preprocess_basic_and_report_tables(spark):
    d = _orders(spark).select("row_id", "segment", "acctbal_n", "o_totalprice", "y")
    basic = au.preprocess_basic(d, "y", ["segment", "acctbal_n", "o_totalprice", "row_id"])
    assert basic.where(F.col("acctbal_n").isNull()).count() == 0
    g = load_view(spark, SMOKE, "grid_results")
    tables = rs.results_report(g)
    assert set(tables) >= {"pareto", "high_performers", "top_table", "distribution Accuracy", "heatmap Accuracy",
                           "tradeoff Statistical Parity Difference", "heatmap Statistical Parity Difference"}
    eod = g.withColumn("Equal Opportunity Difference", F.lit(0.1))
    assert "tradeoff Equal Opportunity Difference" in rs.results_report(eod)
    runs = spark.createDataFrame([("d", "m", "t", float(v)) for v in (1, 2, 3, 4, 50)],
                                 "`Dataset` string, `Model Type` string, `Mitigation Technique` string, Accuracy double")
    box = rs.metric_distribution(runs, "Accuracy").first()
    assert (box["whisker_low"], box["whisker_high"], box["outliers"]) == (1.0, 4.0, [50.0])
    assert tables["pareto"].count() >= 1


def test_mitigation_audit_report(spark):
    d = load_view(spark, SMOKE, "audit_customers").persist()
    prep = au.PrepSpec(missing="mean", outliers=None, encoding="one-hot",
                       selected_features=["region", "c_acctbal", "n_orders", "max_price", "segment"])
    spec = au.AuditSpec(attrs=["segment"], privileged="BUILDING", mode="combined")
    base = au.baseline_audit(d, "y", prep, spec, cv_folds=0)
    mit = au.mitigation_audit(d, "y", prep, spec, "cda", cv_folds=0)
    t = au.report_tables(base, mit, "y")
    sizes = {k: t[k].count() for k in t if k.startswith(("baseline_", "mitigated_")) or k.endswith(("distribution", "rate", "rates"))}
    assert len(sizes) == 14 and all(sizes.values())
    assert t["baseline_confusion"].agg(F.sum("n")).first()[0] == base["predictions"].count()
    assert sizes["selection_rates"] == sizes["positive_rate"] * 2 + 1
    names = {r["metric"] for r in t["metrics_table"].collect()}
    assert {"Test Accuracy", "Statistical Parity Difference", "Disparate Impact"} <= names
    assert mit["table"].count() == 2 * d.count()
    assert t["tradeoff"].count() == 2


def test_leak_free_audit_fits_on_training_rows(spark):
    d = load_view(spark, SMOKE, "audit_customers").persist()
    prep = au.PrepSpec(missing="mean", outliers="iqr", encoding="one-hot",
                       selected_features=["region", "c_acctbal", "n_orders", "max_price", "segment"])
    spec = au.AuditSpec(attrs=["segment", "region"], privileged={"segment": "BUILDING", "region": "EUROPE"},
                        mode="individual")
    res = au.baseline_audit(d, "y", prep, spec, cv_folds=0, leak_free=True)
    names = {r["metric"] for r in res["metrics"].collect()}
    assert "Test Accuracy" in names and any(n.startswith("Statistical Parity Difference (Group:") for n in names)
    assert res["sensitive"] == "segment_region"
    fitted, _ = au.fit_preprocess(d, "y", prep, ["segment"], "BUILDING")
    assert fitted.transform(d).columns == au.preprocess(d, "y", prep, ["segment"], "BUILDING")[0].columns


def test_malformed_line_is_an_error(spark):
    lines = _orders(spark).select(F.concat_ws(",", F.col("row_id").cast("string"), "segment").alias("value"))
    bad = spark.createDataFrame([("row_id,segment",), ("1,a,EXTRA",)], "value string")
    path = os.path.join(tempfile.mkdtemp(prefix="paritylab-io-"), "bad.csv")
    bad.unionByName(lines).coalesce(1).write.text(path)
    with pytest.raises(Exception):
        io.read_table(spark, path).collect()


def test_written_lines_have_a_header_in_each_file(spark):
    from paritylab.plans.value_queries import _written
    from paritylab.sources import io

    body = spark.range(100).selectExpr("concat(id, ';x, ', id) AS value").repartition(4)
    path = _written(spark, " id ;a, b; c", body)
    heads = spark.read.text(path).where("value = ' id ;a, b; c'")
    assert heads.count() == heads.selectExpr("input_file_name() AS f").distinct().count() == 4
    got = io.read_table(spark, path, sep=";", infer_types=False)
    assert got.columns == ["id", "a, b", "c"]
    assert sorted(map(tuple, got.collect())) == sorted((str(i), f"x, {i}", None) for i in range(100))


def test_files_with_quoted_breaks_are_read_by_record(spark, tmp_path):
    from paritylab.sources import io

    (tmp_path / "t.csv").mkdir()
    (tmp_path / "t.csv" / "a.csv").write_text('id,"a\nb",c\n1,"two\nlines",3\n2,"say ""hi"", x",4\n3,5" pipe\n')
    (tmp_path / "t.csv" / "b.csv").write_text('id,"a\nb",c\n7,"plain",8\n')
    (tmp_path / "t.csv" / "c.csv").write_text('id,ab,c\n9,"one, line",10\n')
    got = io.read_table(spark, str(tmp_path / "t.csv"), sep=",", infer_types=False)
    assert got.columns == ["id", "a\nb", "c"]
    assert sorted(map(tuple, got.collect())) == [("1", "two\nlines", "3"), ("2", 'say "hi", x', "4"), ("3", '5" pipe', None), ("7", "plain", "8"), ("9", "one, line", "10")]
    by_line, by_record = io.files_with_breaks(spark, str(tmp_path / "t.csv"), ",")
    assert [p[-5:] for p in by_line] == ["c.csv"] and [p[-5:] for p in by_record] == ["a.csv", "b.csv"]
    (tmp_path / "open.csv").write_text('id,a\n1,"never closed\n2,x\n')
    with pytest.raises(ValueError, match="never closed"):
        io.read_table(spark, str(tmp_path / "open.csv"), sep=",")


def test_delimiters_inside_quotes_do_not_count(spark, tmp_path):
    from paritylab.sources import io

    (tmp_path / "q.csv").write_text('a;b\n"x, y, z";1\n"p, q, r, s";2\n"t, u, v";3\n')
    assert io.infer_delimiter(spark, str(tmp_path / "q.csv"), None) == ";"
