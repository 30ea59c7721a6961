"""Registered queries for ranks by value, exact quantiles, classes, name rules and delimited files."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import functions as F

from paritylab.functions.quantiles import exact_quantiles, long_values
from paritylab.operators import evaluate as ev
from paritylab.operators import prep as pp
from paritylab.operators import profile as pf
from paritylab.operators import ranking as rk
from paritylab.operators import split as sp
from paritylab.plans import grid as gr
from paritylab.plans.registry import register, view, with_views
from paritylab.session import ensure_checkpoint_dir
from paritylab.sources import io
from paritylab.sources.fixtures import register_tables

PROBS = (0.01, 0.25, 0.5, 0.9)


def _table(spark, sf, name):
    register_tables(spark, sf, (name,))
    return spark.table(name)


@register("quantiles_lineitem", "\nUNION ALL ".join(
    f"SELECT l_returnflag, '{c}' AS \"column\", " + ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {p}) AS q{i}" for i, p in enumerate(PROBS))
    + " FROM lineitem GROUP BY l_returnflag" for c in ("l_extendedprice", "l_quantity")))
def _quantiles(spark, sf):
    """Exact quantiles of a column with many values and of one with few, per flag."""
    long = long_values(_table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], ["l_returnflag"])
    return exact_quantiles(long, ["l_returnflag", "column"], PROBS)


def _rank_sql(order: str) -> str:
    return f"""SELECT l_orderkey, l_linenumber, l_returnflag,
  ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY {order}l_orderkey, l_linenumber) AS "rank" FROM lineitem"""


def _ranked(spark, sf, *score):
    rows = _table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return rk.range_rank(rows, ["l_returnflag"], [*score, F.col("l_orderkey"), F.col("l_linenumber")]) \
        .select("l_orderkey", "l_linenumber", "l_returnflag", F.col("rank").cast("long").alias("rank"))


@register("value_rank_lineitem", _rank_sql("l_quantity, "))
def _value_rank(spark, sf):
    """K1: rank by a score with fifty values."""
    return _ranked(spark, sf, F.col("l_quantity"))


@register("tied_rank_lineitem", _rank_sql(""))
def _tied_rank(spark, sf):
    """K1: rank by a constant score: the ties are the whole stratum."""
    return _ranked(spark, sf, F.lit(1.0))


@register("four_value_rank_lineitem", _rank_sql("CAST(floor(l_quantity / 13) AS BIGINT), "))
def _four_value_rank(spark, sf):
    return _ranked(spark, sf, F.floor(F.col("l_quantity") / 13))


@register("multiclass_performance_orders", with_views("""SELECT * FROM (
WITH t AS (SELECT region, status AS y, CASE WHEN o_totalprice > 200000 THEN 'O' WHEN o_totalprice > 60000 THEN 'F' ELSE 'P' END AS p FROM audit_orders),
k AS (SELECT region, y AS c FROM t UNION SELECT region, p FROM t),
m AS (SELECT k.region, c, COUNT_IF(y = c) AS s, COUNT_IF(p = c) AS f, COUNT_IF(y = c AND p = c) AS h FROM k JOIN t ON k.region = t.region GROUP BY ALL),
r AS (SELECT *, COALESCE(h / NULLIF(f, 0), 0.0) AS pr, COALESCE(h / NULLIF(s, 0), 0.0) AS rc FROM m)
SELECT region, SUM(h) / SUM(s) AS accuracy, SUM(s * pr) / SUM(s) AS "precision", SUM(s * rc) / SUM(s) AS recall,
  SUM(s * COALESCE(2 * pr * rc / NULLIF(pr + rc, 0), 0.0)) / SUM(s) AS f1, AVG(CASE WHEN s > 0 THEN rc END) AS balanced_accuracy,
  CAST(SUM(s) AS BIGINT) AS n FROM r GROUP BY region)""", "audit_orders"))
def _multiclass(spark, sf):
    """E1-E5 with three classes."""
    price = F.col("o_totalprice")
    df = view(spark, sf, "audit_orders").withColumn("p", F.when(price > 200000, "O").when(price > 60000, "F").otherwise("P"))
    return ev.performance(df, "status", "p", ["region"])


@register("confusion_orders", with_views("SELECT y AS y_true, y_pred, COUNT(*) AS n FROM audit_orders GROUP BY ALL", "audit_orders"))
def _confusion(spark, sf):
    """One confusion table of all rows."""
    return ev.confusion(view(spark, sf, "audit_orders"), "y", "y_pred")


@register("grid_configurations", """SELECT segment, m AS "Model Type", t AS "Mitigation Technique", r AS "Run Number", COUNT(*) AS n_rows
FROM (SELECT c_mktsegment AS segment FROM customer) s,
(VALUES ('logistic'), ('random_forest'), ('gbm'), ('svm')) a(m),
(VALUES ('none'), ('resampling_over'), ('resampling_under'), ('relabeling'), ('synthetic_smote'), ('synthetic_cda')) b(t),
(VALUES (1), (2)) c(r) GROUP BY ALL""")
def _configurations(spark, sf):
    """B1/B2: the configurations and runs of a grid over the customers of each segment."""
    spec = gr.DatasetSpec("customer", "y", 1, ("c_mktsegment",), {"c_mktsegment": "BUILDING"})
    runs = [t[3] for t in gr.grid_tasks([spec], 2)]
    cells = [F.struct(F.lit(c["model"]).alias("Model Type"), F.lit(c["technique"]).alias("Mitigation Technique"), F.lit(r).alias("Run Number"))
             for c, r in itertools.product(gr.grid_configs(), runs)]
    sizes = _table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n_rows"))
    return sizes.select("segment", "n_rows", F.explode(F.array(*cells)).alias("x")).select("segment", "x.*", "n_rows")


@register("deduped_names_region", "SELECT r_regionkey AS k, r_name AS k_dup_1, r_regionkey AS v, r_regionkey AS k_dup_2 FROM region")
def _deduped(spark, sf):
    """V6: repeated column names of a table."""
    t = _table(spark, sf, "region")
    wide = t.select("r_regionkey", "r_name", F.col("r_regionkey").alias("a"), F.col("r_regionkey").alias("b"))
    return wide.toDF(*pp.dedupe_columns(["k", "k", "v", "k"]))


@register("deduped_names_customers", "SELECT c_custkey AS k, c_name AS k_dup_1, c_custkey AS v, c_nationkey AS k_dup_2 FROM customer")
def _deduped_customers(spark, sf):
    """V6: the same over a table that grows."""
    t = _table(spark, sf, "customer")
    wide = t.select("c_custkey", "c_name", F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("b"))
    return wide.toDF(*pp.dedupe_columns(["k", "k", "v", "k"]))


@register("two_class_segments", "SELECT COUNT(DISTINCT CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) = 2 AS two_classes, COUNT(*) AS n FROM customer")
def _two_classes(spark, sf):
    """The degenerate-run guard."""
    t = _table(spark, sf, "customer").withColumn("y", (F.col("c_acctbal") > 0).cast("int"))
    return t.agg(F.lit(sp.has_two_classes(t, "y")).alias("two_classes"), F.count(F.lit(1)).alias("n"))


def _written(spark, head: str, body) -> str:
    """Delimited files of these lines in the shared checkpoint folder, one a task, each with this header line."""
    path = f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}.csv"
    (body.select(F.col("value").alias(head)).write.option("header", True).option("sep", "\u0001").option("quote", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


@register("delimited_nations", """SELECT n_nationkey AS id, n_name || ', N' AS "place, note",
CASE WHEN n_regionkey > 1 THEN n_regionkey END AS region FROM nation UNION ALL SELECT NULL, 'place, note', NULL""")
def _delimited(spark, sf):
    """A semicolon file with padded names, short lines and a data line like the header."""
    t = _table(spark, sf, "nation")
    line = F.concat_ws(";", F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit(", N")),
                       F.when(F.col("n_regionkey") > 1, F.col("n_regionkey").cast("string")))
    body = t.select(line.alias("value")).unionAll(t.limit(1).select(F.lit(";place, note;")))
    got = io.read_table(spark, _written(spark, " id ;place, note; region", body), sep=";", infer_types=False)
    kinds = dict(t.dtypes)
    return got.select(F.col("id").cast(kinds["n_nationkey"]).alias("id"), "place, note", F.col("region").cast(kinds["n_regionkey"]).alias("region"))


@register("delimited_customers", """SELECT c_custkey AS id, c_name || ', N' AS "place, note",
CASE WHEN c_nationkey > 12 THEN c_nationkey END AS region FROM customer UNION ALL SELECT NULL, 'place, note', NULL""")
def _delimited_customers(spark, sf):
    """The same over a table that grows, in as many files as tasks."""
    t = _table(spark, sf, "customer")
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), F.concat("c_name", F.lit(", N")),
                       F.when(F.col("c_nationkey") > 12, F.col("c_nationkey").cast("string")))
    body = t.select(line.alias("value")).unionAll(t.limit(1).select(F.lit(";place, note;")))
    got = io.read_table(spark, _written(spark, " id ;place, note; region", body), sep=";", infer_types=False)
    kinds = dict(t.dtypes)
    return got.select(F.col("id").cast(kinds["c_custkey"]).alias("id"), "place, note", F.col("region").cast(kinds["c_nationkey"]).alias("region"))


@register("sniffed_nations", """SELECT CAST(n_nationkey AS VARCHAR) AS name, n_name || ', N' AS "city, state", CAST(n_regionkey AS VARCHAR) AS age FROM nation
UNION ALL SELECT 'name', 'city, state', 'age'""")
def _sniffed(spark, sf):
    """The delimiter is inferred although every line has a comma; a data line equal to the header stays."""
    t = _table(spark, sf, "nation")
    line = F.concat_ws(";", F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit(", N")), F.col("n_regionkey").cast("string"))
    body = t.select(line.alias("value")).unionAll(t.limit(1).select(F.lit("name;city, state;age")))
    return io.read_table(spark, _written(spark, "name;city, state;age", body), infer_types=False)


@register("quoted_breaks_customers", """SELECT c_custkey AS id, c_name || chr(10) || 'says "hi", ' || chr(10) || c_mktsegment AS "note, place",
CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment FROM customer""")
def _quoted_breaks(spark, sf):
    """Quoted fields with line breaks, delimiters and quotes, written and read back; the column's name is quoted, too."""
    t = _table(spark, sf, "customer")
    note = F.concat(F.col("c_name"), F.lit('\nsays "hi", \n'), F.col("c_mktsegment"))
    body = t.select(F.col("c_custkey").alias("id"), note.alias("note, place"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment"))
    path = io.write_table(body, f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}.csv")
    got = io.read_table(spark, path, sep=",", infer_types=False)
    return got.select(F.col("id").cast(dict(t.dtypes)["c_custkey"]).alias("id"), "note, place", "segment")


@register("sniffed_customers", """SELECT CAST(c_custkey AS VARCHAR) AS name, c_name || ', a, b, c' AS "city, state", c_mktsegment || ';' AS age FROM customer""")
def _sniffed_customers(spark, sf):
    """The delimiter is counted outside quotes, over all lines of a table that grows."""
    t = _table(spark, sf, "customer")
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), F.concat(F.lit('"'), F.col("c_name"), F.lit(', a, b, c"')), F.concat(F.lit('"'), F.col("c_mktsegment"), F.lit(';"')))
    return io.read_table(spark, _written(spark, "name;city, state;age", t.select(line.alias("value"))), infer_types=False, sample_lines=None)


@register("validated_customers", "SELECT COUNT(*) > 0 AS valid, COUNT(*) AS n FROM customer")
def _validated(spark, sf):
    """V1: at least one row and two columns."""
    t = _table(spark, sf, "customer")
    return t.agg(F.lit(pf.validate_dataset(t)[0]).alias("valid"), F.count(F.lit(1)).alias("n"))


@register("selected_customers", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _selected(spark, sf):
    """A keep list with an unknown name; the target stays, last."""
    return pp.select_features(_table(spark, sf, "customer"), "c_mktsegment", keep=["c_custkey", "no_such_column", "c_mktsegment", "c_acctbal"])


@register("encoded_target_customers", "SELECT c_custkey, DENSE_RANK() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment FROM customer")
def _encoded_target(spark, sf):
    """A text target as codes in text order."""
    out = pp.encode_target(_table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")
    return out.select("c_custkey", F.col("c_mktsegment").cast("long").alias("c_mktsegment"))


@register("remaining_customers", "SELECT c_custkey, DENSE_RANK() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment FROM customer")
def _remaining(spark, sf):
    """The categorical columns that are left, as codes."""
    out = pp.handle_remaining(_table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey", "c_mktsegment"])
    return out.select("c_custkey", F.col("c_mktsegment").cast("long").alias("c_mktsegment"))


@register("aligned_matrix_customers", """SELECT c_custkey, COALESCE(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0.0)::DOUBLE AS c_acctbal,
(c_acctbal > 5000)::INTEGER::DOUBLE AS rich, 0 AS unseen, c_nationkey FROM customer""")
def _aligned(spark, sf):
    """The numeric matrix of some features (nulls 0, booleans 0 / 1), in the columns of another one."""
    t = _table(spark, sf, "customer")
    t = t.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"), (F.col("c_acctbal") > 5000).alias("rich"), "c_mktsegment", "c_nationkey")
    matrix, _ = pp.model_matrix(t, ["c_acctbal", "rich", "c_mktsegment", "no_such_column"], "c_nationkey", extra=["c_custkey"])
    return pp.align_columns(matrix, ["c_custkey", "c_acctbal", "rich", "unseen", "c_nationkey"])


@register("reordered_customers", "SELECT c_custkey, c_name, c_acctbal, c_acctbal * 2 AS twice FROM customer")
def _reordered(spark, sf):
    """Original columns first, new ones last."""
    t = _table(spark, sf, "customer")
    mixed = t.select((F.col("c_acctbal") * 2).alias("twice"), "c_acctbal", "c_custkey", "c_name")
    return pp.reorder(mixed, [c for c in t.columns if c in mixed.columns])


@register("read_results_grid", with_views('SELECT "Dataset", "Model Type", "Mitigation Technique", "Accuracy" FROM grid_results', "grid_results"))
def _read_results(spark, sf):
    """A result table written, read back and checked for its required columns."""
    from paritylab.operators import results as rs

    path = f"{ensure_checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"
    view(spark, sf, "grid_results").write.option("header", True).csv(path)
    return rs.read_results(spark, path).select("Dataset", "Model Type", "Mitigation Technique", "Accuracy")
