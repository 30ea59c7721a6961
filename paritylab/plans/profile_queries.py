"""Registered profiling (V*, A1-A5, A9-A11) and preprocessing (P*) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from paritylab.operators import prep as pp
from paritylab.operators import profile as pf
from paritylab.plans.registry import register, view, with_views
from paritylab.sources.fixtures import load_table


def _sql(views: tuple[str, ...], body: str) -> str:
    if not views:
        return body
    return with_views("", *views).rstrip() + ",\n" + body


def _q(name, views, body):
    return register(name, _sql(views, body))


# ---------------------------------------------------------------- V2, V3
@_q("duplicate_rows_documents", (), """
SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT text, lang, COUNT(*) AS n FROM documents GROUP BY text, lang) d""")
def _dup_docs(spark, sf):
    return pf.count_duplicates(load_table(spark, sf, "documents").select("text", "lang"))


@_q("drop_duplicates_documents", (), """
SELECT MIN(doc_id) AS doc_id, lang, md5(text) AS text_md5 FROM documents GROUP BY text, lang""")
def _dedup_docs(spark, sf):
    d = pf.drop_duplicates(load_table(spark, sf, "documents").select("doc_id", "text", "lang"), key="doc_id")
    return d.select("doc_id", "lang", F.md5("text").alias("text_md5"))


# ---------------------------------------------------------------- V5, V7, V8, V9, V10, V12, V16
register("validate_labels_docs", "SELECT COALESCE(MAX(CAST(CAST(quality AS VARCHAR) IN ('0', '1') AS INTEGER)) = 1, FALSE) "
         "AS labels_present FROM labels")(
    lambda spark, sf: pf.validate_labels(load_table(spark, sf, "labels"), "quality", [0, 1]))


@_q("infer_numeric_text", ("text_numbers",), """
c AS (SELECT 1)
SELECT row_id,
       CASE WHEN regexp_full_match(mostly_numeric, '\\s*[+-]?((\\d+(\\.\\d*)?)|(\\.\\d+))([eE][+-]?\\d+)?\\s*')
            THEN CAST(trim(mostly_numeric) AS DOUBLE) END AS mostly_numeric,
       partly_numeric, status
FROM text_numbers""")
def _infer(spark, sf):
    df, _ = pf.infer_numeric(view(spark, sf, "text_numbers"))
    return df


@_q("basic_stats_orders", ("audit_orders",), """
c AS (SELECT 1)
SELECT COUNT(*) AS rows,
       CAST(COUNT_IF(acctbal_n IS NULL) + COUNT_IF(segment_n IS NULL) AS BIGINT) AS missing_cells
FROM audit_orders""")
def _basic(spark, sf):
    return pf.basic_stats(view(spark, sf, "audit_orders"))


_COLS_ORDERS = ["row_id", "segment", "region", "status", "y", "y_pred", "score", "o_totalprice",
                "c_acctbal", "acctbal_n", "segment_n"]


@_q("missing_profile_orders", ("audit_orders",), "c AS (SELECT 1)\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(COUNT_IF({c} IS NULL) AS BIGINT) AS missing FROM audit_orders"
    for c in _COLS_ORDERS))
def _missing(spark, sf):
    return pf.missing_profile(view(spark, sf, "audit_orders"))


@_q("audit_stats_orders", ("audit_orders",), """
c AS (SELECT 1)
SELECT 'Total Samples' AS stat, CAST(NULL AS VARCHAR) AS "group", CAST(COUNT(*) AS DOUBLE) AS value FROM audit_orders
UNION ALL SELECT 'Missing Values', NULL, CAST(COUNT_IF(acctbal_n IS NULL) + COUNT_IF(segment_n IS NULL) AS DOUBLE) FROM audit_orders
UNION ALL SELECT 'Global Positive Rate', NULL, AVG(CAST(y AS DOUBLE)) FROM audit_orders
UNION ALL SELECT 'Total Features', NULL, 10.0
UNION ALL SELECT 'Features Selected', NULL, 10.0
UNION ALL SELECT 'Numerical Features', NULL, 7.0
UNION ALL SELECT 'Categorical Features', NULL, 4.0
UNION ALL SELECT 'Group ' || chr(39) || segment || chr(39) || ' Size', segment, CAST(COUNT(*) AS DOUBLE)
          FROM audit_orders WHERE segment IS NOT NULL GROUP BY segment
UNION ALL SELECT 'Group ' || chr(39) || segment || chr(39) || ' Pos. Rate', segment, AVG(CAST(y AS DOUBLE))
          FROM audit_orders WHERE segment IS NOT NULL GROUP BY segment""")
def _audit_stats(spark, sf):
    return pf.audit_stats(view(spark, sf, "audit_orders"), "y", "segment", original_features=10)


@_q("target_distribution_docs", ("audit_docs",), """
c AS (SELECT y, COUNT(*) AS n FROM audit_docs WHERE y IS NOT NULL GROUP BY y)
SELECT y, n, CAST(n AS DOUBLE) / CAST(SUM(n) OVER () AS DOUBLE) AS share FROM c""")
def _tdist(spark, sf):
    return pf.target_distribution(view(spark, sf, "audit_docs"), "y")


@_q("group_values_orders", ("audit_orders",), "c AS (SELECT 1)\nSELECT DISTINCT region FROM audit_orders")
def _gvals(spark, sf):
    return pf.group_values(view(spark, sf, "audit_orders"), "region")


# ---------------------------------------------------------------- A1-A5, A9, A11
@_q("class_distribution_orders", ("audit_orders",), "c AS (SELECT 1)\nSELECT y, COUNT(*) AS n FROM audit_orders GROUP BY y")
def _classes(spark, sf):
    return pf.class_distribution(view(spark, sf, "audit_orders"), "y")


def _box_sql(by: str | None) -> str:
    cols = ["row_id", "c_acctbal", "n_orders", "max_price", "y"]
    byc = f"{by}, " if by else ""
    long = " UNION ALL ".join(
        f"SELECT {byc}'{c}' AS \"column\", CAST({c} AS DOUBLE) AS value FROM audit_customers WHERE {c} IS NOT NULL"
        for c in cols)
    keys = f"{byc}\"column\""
    jk = " AND ".join([f"l.{by} = q.{by}"] if by else []) + (" AND " if by else "") + 'l."column" = q."column"'
    return f"""l AS ({long}),
q0 AS (SELECT {keys}, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
              quantile_cont(value, 0.75) AS q3 FROM l GROUP BY {keys}),
q AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM q0)
SELECT {''.join(f'q.{by}, ' if by else '')}q."column", q.q1, q.median, q.q3,
       MIN(CASE WHEN value >= lo_fence AND value <= hi_fence THEN value END) AS whisker_low,
       MAX(CASE WHEN value >= lo_fence AND value <= hi_fence THEN value END) AS whisker_high,
       CAST(COUNT_IF(NOT (value >= lo_fence AND value <= hi_fence)) AS BIGINT) AS n_outliers, COUNT(*) AS n
FROM l JOIN q ON {jk}
GROUP BY {''.join(f'q.{by}, ' if by else '')}q."column", q.q1, q.median, q.q3, q.lo_fence, q.hi_fence"""


@_q("box_stats_customers", ("audit_customers",), _box_sql(None))
def _box(spark, sf):
    return pf.box_stats(view(spark, sf, "audit_customers"))


@_q("box_stats_by_target_customers", ("audit_customers",), _box_sql("y"))
def _box_y(spark, sf):
    return pf.box_stats(view(spark, sf, "audit_customers"), by=["y"])


_CORR_COLS = ["row_id", "c_acctbal", "n_orders", "max_price", "y"]


@_q("correlation_customers", ("audit_customers",), "c AS (SELECT 1)\n" + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr "
    f"FROM audit_customers" for a in _CORR_COLS for b in _CORR_COLS))
def _corr(spark, sf):
    return pf.correlation(view(spark, sf, "audit_customers")).withColumn("corr", F.round("corr", 6))


@_q("target_conditioned_counts_orders", ("audit_orders",), "l AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, y AS target FROM audit_orders"
    for c in ["segment", "region", "status", "segment_n"]) + ")\n"
    "SELECT \"column\", value, target, COUNT(*) AS n FROM l GROUP BY 1, 2, 3")
def _tcc(spark, sf):
    return pf.target_conditioned_counts(view(spark, sf, "audit_orders"), "y")


@_q("crosstab_orders", ("audit_orders",), """
c AS (SELECT 1)
SELECT segment, CAST(COUNT_IF(y = 0) AS BIGINT) AS "0", CAST(COUNT_IF(y = 1) AS BIGINT) AS "1" FROM audit_orders
WHERE segment IS NOT NULL AND y IS NOT NULL GROUP BY segment""")
def _crosstab(spark, sf):
    return pf.crosstab(view(spark, sf, "audit_orders"), "segment", "y", values=[0, 1])


@_q("positive_rate_docs", ("audit_docs",),
    "c AS (SELECT 1)\nSELECT lang, AVG(CAST(y AS DOUBLE)) AS positive_rate FROM audit_docs GROUP BY lang")
def _posrate(spark, sf):
    return pf.positive_rate(view(spark, sf, "audit_docs"), "lang", "y")


# A10: per-group KDE over a histogram (grid 200, 2048 bins), rounded
@_q("score_density_lineitem", ("audit_lineitem",), """
b AS (SELECT grp, CAST(l_discount * 10 AS DOUBLE) AS s FROM audit_lineitem WHERE grp IS NOT NULL),
st AS (SELECT grp, COUNT(*) AS n, stddev_samp(s) AS sd FROM b GROUP BY grp),
h AS (SELECT grp, least(floor(s * 2048), 2047) AS bin, COUNT(*) AS cnt, AVG(s) AS center FROM b GROUP BY 1, 2),
e AS (SELECT h.grp, cnt, center, n, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw, i
      FROM h JOIN st USING (grp), range(0, 200) t(i))
SELECT grp AS "group", CAST(i AS DOUBLE) / 199 AS x,
       round(SUM(cnt * exp(-0.5 * ((CAST(i AS DOUBLE) / 199 - center) / bw) * ((CAST(i AS DOUBLE) / 199 - center) / bw))
                 / (bw * sqrt(2 * pi()))) / ANY_VALUE(n), 6) AS density
FROM e WHERE bw > 0 GROUP BY grp, i""")
def _kde(spark, sf):
    d = view(spark, sf, "audit_lineitem").withColumn("s", F.col("l_discount") * 10)
    return pf.score_density(d, "s", "grp").withColumn("density", F.round("density", 6))


# ---------------------------------------------------------------- P2-P8
@_q("impute_mean_orders", ("audit_orders",), """
m AS (SELECT AVG(acctbal_n) AS v FROM audit_orders)
SELECT row_id, round(COALESCE(acctbal_n, v), 6) AS acctbal_n FROM audit_orders, m""")
def _imp_mean(spark, sf):
    d = pp.Imputer("mean", ["acctbal_n"]).fit_transform(view(spark, sf, "audit_orders"))
    return d.select("row_id", F.round("acctbal_n", 6).alias("acctbal_n"))


@_q("impute_median_orders", ("audit_orders",), """
m AS (SELECT quantile_cont(acctbal_n, 0.5) AS v FROM audit_orders)
SELECT row_id, COALESCE(acctbal_n, v) AS acctbal_n FROM audit_orders, m""")
def _imp_median(spark, sf):
    return pp.Imputer("median", ["acctbal_n"]).fit_transform(view(spark, sf, "audit_orders")) \
        .select("row_id", "acctbal_n")


_MODE_SQL = """
m AS (SELECT segment_n AS v FROM audit_orders WHERE segment_n IS NOT NULL GROUP BY segment_n
      ORDER BY COUNT(*) DESC, segment_n LIMIT 1)
"""


@_q("impute_mode_orders", ("audit_orders",), _MODE_SQL +
    "SELECT row_id, COALESCE(segment_n, v) AS segment_n FROM audit_orders, m")
def _imp_mode(spark, sf):
    return pp.Imputer("mode", ["segment_n"]).fit_transform(view(spark, sf, "audit_orders")) \
        .select("row_id", "segment_n")


@_q("drop_missing_orders", ("audit_orders",), """
c AS (SELECT 1)
SELECT row_id, acctbal_n, segment_n FROM audit_orders WHERE acctbal_n IS NOT NULL AND segment_n IS NOT NULL""")
def _drop(spark, sf):
    return pp.Imputer("drop", ["acctbal_n", "segment_n"]).transform(view(spark, sf, "audit_orders")) \
        .select("row_id", "acctbal_n", "segment_n")


@_q("smart_impute_orders", ("audit_orders",), _MODE_SQL + """,
a AS (SELECT AVG(acctbal_n) AS mean_v FROM audit_orders)
SELECT row_id, round(COALESCE(acctbal_n, mean_v), 6) AS acctbal_n, COALESCE(segment_n, v) AS segment_n
FROM audit_orders, m, a""")
def _smart(spark, sf):
    d = pp.smart_impute(view(spark, sf, "audit_orders"), "mean", ["acctbal_n", "segment_n"])
    return d.select("row_id", F.round("acctbal_n", 6).alias("acctbal_n"), "segment_n")


# ---------------------------------------------------------------- P9, P10
def _iqr_bounds_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"SELECT '{c}' AS col, quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, "
                     f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, COUNT(DISTINCT {c}) AS d FROM {src}")
    return ("b0 AS (" + " UNION ALL ".join(parts) + "),\n"
            "b AS (SELECT col, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b0 "
            "WHERE d >= 10 AND q3 - q1 <> 0)")


def _bound(c):
    return f"(SELECT lo FROM b WHERE col = '{c}')", f"(SELECT hi FROM b WHERE col = '{c}')"


_IQR_COLS = ["c_acctbal", "n_orders", "max_price"]


@_q("iqr_remove_customers", ("audit_customers",), _iqr_bounds_sql("audit_customers", _IQR_COLS) + "\n"
    "SELECT row_id FROM audit_customers WHERE " + " AND ".join(
        f"COALESCE({c} >= {_bound(c)[0]} AND {c} <= {_bound(c)[1]}, (SELECT COUNT(*) FROM b WHERE col = '{c}') = 0)"
        for c in _IQR_COLS))
def _iqr_remove(spark, sf):
    return pp.IqrTrimmer("remove", _IQR_COLS).fit_transform(view(spark, sf, "audit_customers")).select("row_id")


@_q("iqr_clip_orders", ("audit_orders",), _iqr_bounds_sql("audit_orders", ["o_totalprice", "acctbal_n"]) + "\n"
    "SELECT row_id, " + ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL WHEN (SELECT COUNT(*) FROM b WHERE col = '{c}') = 0 THEN CAST({c} AS DOUBLE) "
        f"ELSE least(greatest(CAST({c} AS DOUBLE), {_bound(c)[0]}), {_bound(c)[1]}) END AS {c}"
        for c in ["o_totalprice", "acctbal_n"]) + " FROM audit_orders")
def _iqr_clip(spark, sf):
    return pp.IqrTrimmer("clip", ["o_totalprice", "acctbal_n"]).fit_transform(view(spark, sf, "audit_orders")) \
        .select("row_id", "o_totalprice", F.col("acctbal_n").cast("double").alias("acctbal_n"))


# ---------------------------------------------------------------- P11-P17
_STATUS = ["F", "O", "P"]
_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@_q("one_hot_orders", ("audit_orders",), "c AS (SELECT 1)\nSELECT row_id, status, region, " + ", ".join(
    [f"CAST(COALESCE(status = '{v}', FALSE) AS INTEGER) AS \"status_{v}\"" for v in _STATUS]
    + [f"CAST(COALESCE(region = '{v}', FALSE) AS INTEGER) AS \"region_{v}\"" for v in _REGIONS])
    + " FROM audit_orders")
def _onehot(spark, sf):
    d = view(spark, sf, "audit_orders").select("row_id", "status", "region")
    return pp.OneHot(["status", "region"]).fit_transform(d)


_SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@_q("label_encode_orders", ("audit_orders",), """
k AS (SELECT v, CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS INTEGER) AS code
      FROM (SELECT DISTINCT COALESCE(segment_n, 'nan') AS v FROM audit_orders) d)
SELECT row_id, code AS segment_n, segment_n AS segment_n_raw
FROM audit_orders JOIN k ON COALESCE(segment_n, 'nan') = k.v""")
def _labenc(spark, sf):
    d = view(spark, sf, "audit_orders").select("row_id", "segment_n")
    return pp.LabelEncode(["segment_n"]).fit_transform(d)


@_q("value_mapping_orders", ("audit_orders",), """
k AS (SELECT v, CAST(ROW_NUMBER() OVER (ORDER BY v) - 1 AS INTEGER) AS code
      FROM (SELECT DISTINCT COALESCE(segment_n, 'nan') AS v FROM audit_orders) d)
SELECT DISTINCT segment_n AS original, code AS encoded
FROM audit_orders JOIN k ON COALESCE(segment_n, 'nan') = k.v WHERE segment_n IS NOT NULL""")
def _valmap(spark, sf):
    before = view(spark, sf, "audit_orders").select("row_id", "segment_n")
    after = pp.LabelEncode(["segment_n"]).fit_transform(before)
    return pf.value_mapping(before, after, "segment_n")


@_q("binarize_orders", ("audit_orders",), """
c AS (SELECT 1)
SELECT row_id, CASE WHEN segment_n = 'BUILDING' THEN 1 ELSE 0 END AS segment_n FROM audit_orders""")
def _binarize(spark, sf):
    return pp.binarize(view(spark, sf, "audit_orders"), "segment_n", "BUILDING").select("row_id", "segment_n")


@_q("composite_orders", ("audit_orders",), """
c AS (SELECT 1)
SELECT row_id, COALESCE(segment_n, 'nan') || '_' || COALESCE(region, 'nan') AS segment_n_region FROM audit_orders""")
def _composite(spark, sf):
    d, name = pp.add_composite(view(spark, sf, "audit_orders"), ["segment_n", "region"])
    return d.select("row_id", name)


# ---------------------------------------------------------------- P22, P23
@_q("standardize_customers", ("audit_customers",), """
s AS (SELECT AVG(c_acctbal) AS m1, stddev_pop(c_acctbal) AS s1, AVG(max_price) AS m2, stddev_pop(max_price) AS s2
      FROM audit_customers)
SELECT row_id, round((c_acctbal - m1) / s1, 6) AS c_acctbal,
       round(CASE WHEN s2 IS NULL OR s2 = 0 THEN 0.0 ELSE (max_price - m2) / s2 END, 6) AS max_price
FROM audit_customers, s""")
def _std(spark, sf):
    d = view(spark, sf, "audit_customers").select("row_id", "c_acctbal", "max_price")
    out, _ = pp.standardize(d, ["c_acctbal", "max_price"])
    return out.select("row_id", F.round("c_acctbal", 6).alias("c_acctbal"),
                      F.round("max_price", 6).alias("max_price"))


@_q("l2_normalize_customers", ("audit_customers",), """
n AS (SELECT row_id, c_acctbal, COALESCE(max_price, 0.0) AS max_price,
             sqrt(0.0 + c_acctbal * c_acctbal + COALESCE(max_price, 0.0) * COALESCE(max_price, 0.0)) AS nrm
      FROM audit_customers)
SELECT row_id, round(CASE WHEN nrm > 0 THEN c_acctbal / nrm ELSE c_acctbal END, 9) AS c_acctbal,
       round(CASE WHEN nrm > 0 THEN max_price / nrm ELSE max_price END, 9) AS max_price FROM n""")
def _l2(spark, sf):
    d = view(spark, sf, "audit_customers").select("row_id", "c_acctbal", F.coalesce("max_price", F.lit(0.0)).alias("max_price"))
    out = pp.l2_normalize(d, ["c_acctbal", "max_price"])
    return out.select("row_id", F.round("c_acctbal", 9).alias("c_acctbal"), F.round("max_price", 9).alias("max_price"))


# A10 exact variant: every row at every grid point (oracle: the same sum)
@_q("score_density_exact_orders", ("audit_orders",), """
b AS (SELECT region AS grp, CAST(o_totalprice / 600000.0 AS DOUBLE) AS s FROM audit_orders WHERE region IS NOT NULL),
st AS (SELECT grp, COUNT(*) AS n, stddev_samp(s) AS sd FROM b GROUP BY grp),
e AS (SELECT b.grp, s, n, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw, i FROM b JOIN st USING (grp), range(0, 200) t(i))
SELECT grp AS "group", CAST(i AS DOUBLE) / 199 AS x,
       round(SUM(exp(-0.5 * ((CAST(i AS DOUBLE) / 199 - s) / bw) * ((CAST(i AS DOUBLE) / 199 - s) / bw))
                 / (bw * sqrt(2 * pi()))) / ANY_VALUE(n), 6) AS density
FROM e WHERE bw > 0 GROUP BY grp, i""")
def _kde_exact(spark, sf):
    d = view(spark, sf, "audit_orders").withColumn("s", F.col("o_totalprice") / 600000.0)
    return pf.score_density(d, "s", "region", exact=True).withColumn("density", F.round("density", 6))
