"""Audit views over the provided tables.

Each view is one SQL text that runs unchanged in Spark SQL and in DuckDB
(the oracle); ``register_tables`` exposes the parquet tables as temp views
and ``load_view`` returns a view as a lazy DataFrame. Nulls are injected by
key modulus because the provided tables contain none.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

AUDIT_ORDERS = """
SELECT o_orderkey AS row_id, c_mktsegment AS segment, r_name AS region, o_orderstatus AS status,
       CAST(o_orderpriority IN ('1-URGENT','2-HIGH') AS INT) AS y,
       CAST(o_totalprice >= 250000 AS INT) AS y_pred,
       o_totalprice AS score, o_totalprice, c_acctbal,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE c_acctbal END AS acctbal_n,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS segment_n
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

AUDIT_LINEITEM = """
SELECT l_returnflag AS grp, l_linestatus AS grp2, CAST(l_discount >= 0.05 AS INT) AS y,
       CAST(l_tax >= 0.04 AS INT) AS y_pred,
       l_quantity AS score, l_extendedprice, l_quantity, l_discount, l_tax FROM lineitem
"""

AUDIT_DOCS = """
SELECT doc_id AS row_id, lang, quality AS y, toxic, CAST(n_chars >= 500 AS INT) AS y_pred,
       n_chars AS score
FROM labels JOIN documents USING (doc_id)
"""

AUDIT_CUSTOMERS = """
SELECT c_custkey AS row_id, r_name AS region, c_mktsegment AS segment, c_acctbal,
       COUNT(o_orderkey) AS n_orders, MAX(o_totalprice) AS max_price,
       CAST(SUM(CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END) >= 5 AS INT) AS y
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4
"""

TEXT_NUMBERS = """
SELECT o_orderkey AS row_id,
       CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS STRING) END AS mostly_numeric,
       CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS STRING) END AS partly_numeric,
       o_orderstatus AS status
FROM orders
"""

# Grid-result shaped table (one row per segment x status x region).
_GRID_TEMPLATE = """
SELECT segment AS {q}Dataset{q}, status AS {q}Model Type{q}, region AS {q}Mitigation Technique{q},
       AVG(CAST(y = y_pred AS INT)) AS {q}Accuracy{q},
       AVG(y_pred) - 0.5 AS {q}Statistical Parity Difference{q}
FROM audit_orders GROUP BY 1, 2, 3
"""
GRID_RESULTS_SPARK = _GRID_TEMPLATE.format(q="`")
GRID_RESULTS_DUCKDB = _GRID_TEMPLATE.format(q='"')

VIEWS = {
    "audit_orders": AUDIT_ORDERS,
    "audit_lineitem": AUDIT_LINEITEM,
    "audit_docs": AUDIT_DOCS,
    "audit_customers": AUDIT_CUSTOMERS,
    "text_numbers": TEXT_NUMBERS,
    "grid_results": GRID_RESULTS_SPARK,
}
DEPENDS = {"grid_results": ("audit_orders",)}


def duckdb_views() -> dict[str, str]:
    """The same views in DuckDB syntax (for oracle CTEs)."""
    out = dict(VIEWS)
    out["text_numbers"] = TEXT_NUMBERS.replace("AS STRING", "AS VARCHAR")
    out["grid_results"] = GRID_RESULTS_DUCKDB
    return out


# Base tables each view reads (only these are registered for it).
VIEW_TABLES = {
    "audit_orders": ("orders", "customer", "nation", "region"),
    "audit_lineitem": ("lineitem",),
    "audit_docs": ("labels", "documents"),
    "audit_customers": ("customer", "nation", "region", "orders"),
    "text_numbers": ("orders",),
    "grid_results": ("orders", "customer", "nation", "region"),
}

# (session id, table) -> directory already registered; avoids re-reading
# parquet footers for every query of a session.
_REGISTERED: dict[tuple[int, str], str] = {}


def register_tables(spark: SparkSession, sf_dir: str, tables=BASE_TABLES) -> None:
    for t in tables:
        k = (id(spark), t)
        if _REGISTERED.get(k) == sf_dir and spark.catalog.tableExists(t):
            continue
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            spark.read.parquet(path).createOrReplaceTempView(t)
            _REGISTERED[k] = sf_dir


def load_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Register the base tables the view needs and return fixture view ``name``."""
    register_tables(spark, sf_dir, VIEW_TABLES.get(name, BASE_TABLES))
    for dep in DEPENDS.get(name, ()):
        spark.sql(VIEWS[dep]).createOrReplaceTempView(dep)
    df = spark.sql(VIEWS[name])
    df.createOrReplaceTempView(name)
    return df


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register_tables(spark, sf_dir, (name,))
    return spark.table(name)
