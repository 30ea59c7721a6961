"""Registered preprocessing-pipeline, report-table and source/sink queries."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import functions as F

from paritylab.operators import evaluate as ev
from paritylab.operators import fairness as fm
from paritylab.operators import mitigate as mt
from paritylab.operators import prep as pp
from paritylab.operators import profile as pf
from paritylab.plans import audit as au
from paritylab.plans import models as md
from paritylab.plans.registry import combined_sql, register, view, with_views
from paritylab.session import ensure_checkpoint_dir
from paritylab.sources import io
from paritylab.sources.fixtures import load_table


def _sql(views, body):
    return with_views("", *views).rstrip() + ",\n" + body


# ---------------------------------------------------------------- P25 preprocessing pipeline
_SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_STATUS = ["F", "O", "P"]


def _mode_cte(name, col):
    return (f"{name} AS (SELECT {col} AS v FROM base WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY COUNT(*) DESC, {col} LIMIT 1)")


def _bounds_cte(cols):
    parts = [f"SELECT '{c}' AS col, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, "
             f"COUNT(DISTINCT {c}) AS d FROM imp" for c in cols]
    return ("b0 AS (" + " UNION ALL ".join(parts) + "),\n"
            "bd AS (SELECT col, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM b0 "
            "WHERE d >= 10 AND q3 - q1 <> 0)")


def _keep(c):
    return (f"COALESCE({c} >= (SELECT lo FROM bd WHERE col = '{c}') AND {c} <= (SELECT hi FROM bd WHERE col = '{c}'), "
            f"(SELECT COUNT(*) FROM bd WHERE col = '{c}') = 0)")


_PREP_SQL = _sql(("audit_orders",), f"""base AS (SELECT row_id, region, segment_n, status, acctbal_n, o_totalprice, y FROM audit_orders),
m AS (SELECT AVG(acctbal_n) AS a, AVG(o_totalprice) AS t, AVG(CAST(y AS DOUBLE)) AS yy FROM base),
{_mode_cte('ms', 'segment_n')},
{_mode_cte('mst', 'status')},
imp AS (SELECT row_id, region, COALESCE(segment_n, ms.v) AS segment_n, COALESCE(status, mst.v) AS status,
               CAST(COALESCE(acctbal_n, a) AS DOUBLE) AS acctbal_n, CAST(COALESCE(o_totalprice, t) AS DOUBLE) AS o_totalprice,
               CAST(COALESCE(y, yy) AS DOUBLE) AS y FROM base, m, ms, mst),
{_bounds_cte(['acctbal_n', 'o_totalprice', 'y'])},
kept AS (SELECT * FROM imp WHERE {_keep('acctbal_n')} AND {_keep('o_totalprice')} AND {_keep('y')})
SELECT row_id, CASE WHEN region = 'EUROPE' THEN 1 ELSE 0 END AS region, segment_n, status,
       round(acctbal_n, 6) AS acctbal_n, o_totalprice, y,
       {', '.join(f"CAST(COALESCE(segment_n = '{v}', FALSE) AS INTEGER) AS segment_n_{v}" for v in _SEGS)},
       {', '.join(f"CAST(COALESCE(status = '{v}', FALSE) AS INTEGER) AS status_{v}" for v in _STATUS)}
FROM kept""")


@register("preprocess_orders", _PREP_SQL)
def _preprocess(spark, sf):
    d = view(spark, sf, "audit_orders").select("row_id", "region", "segment_n", "status", "acctbal_n",
                                               "o_totalprice", "y")
    prep = au.PrepSpec(missing="mean", outliers="iqr", encoding="one-hot",
                       selected_features=["segment_n", "status", "acctbal_n", "o_totalprice"])
    out, _, _, _ = au.preprocess(d, "y", prep, ["region"], "EUROPE", binarize=True)
    return out.withColumn("acctbal_n", F.round("acctbal_n", 6))


# Drop rows missing the balance, then mode-impute the segment
@register("drop_then_mode_orders", _sql(("audit_orders",), """base AS (SELECT row_id, acctbal_n, segment_n FROM audit_orders
                                         WHERE acctbal_n IS NOT NULL),
ms AS (SELECT segment_n AS v FROM base WHERE segment_n IS NOT NULL GROUP BY segment_n ORDER BY COUNT(*) DESC, segment_n LIMIT 1)
SELECT row_id, acctbal_n, COALESCE(segment_n, v) AS segment_n FROM base, ms"""))
def _drop_mode(spark, sf):
    d = view(spark, sf, "audit_orders").select("row_id", "acctbal_n", "segment_n")
    return pp.drop_then_mode(d, ["acctbal_n"], ["segment_n"])


# ---------------------------------------------------------------- V11 display names from a lookup table
@register("rename_groups_nation", """
WITH s AS (SELECT CAST(c_nationkey AS VARCHAR) AS "group", COUNT(*) AS n,
                  CAST(COUNT_IF(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS n_pos
           FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)
SELECT COALESCE(n_name, s."group") AS "group", n, n_pos, CAST(n_pos AS DOUBLE) / CAST(n AS DOUBLE) AS positive_rate
FROM s LEFT JOIN nation ON s."group" = CAST(n_nationkey AS VARCHAR)""")
def _rename(spark, sf):
    o, c, n = (load_table(spark, sf, t) for t in ("orders", "customer", "nation"))
    d = o.join(c, o.o_custkey == c.c_custkey).withColumn(
        "y", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int"))
    stats = fm.group_stats(d, "c_nationkey", "y").withColumn("group", F.col("group").cast("string"))
    mapping = n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return pf.rename_groups(stats, mapping)


# ---------------------------------------------------------------- A12-A15, E8 from two audits
def _stage_long(df, pred, stage):
    wide = fm.fairness_metrics(df, "segment", "BUILDING", label="y", pred=pred, mode="combined")
    long = fm.fairness_long(wide)
    acc = ev.performance(df, "y", pred).select(F.lit("Test Accuracy").alias("metric"),
                                               F.col("accuracy").alias("value"))
    return long.unionByName(acc).withColumn("stage", F.lit(stage))


def _stages(spark, sf):
    d = view(spark, sf, "audit_orders").withColumn("y_pred_after", (F.col("o_totalprice") >= 150000).cast("int"))
    return _stage_long(d, "y_pred", "Baseline"), _stage_long(d, "y_pred_after", "Mitigated")


def _stages_sql() -> str:
    out = ["src AS (SELECT *, CAST(o_totalprice >= 150000 AS INTEGER) AS y_pred_after FROM audit_orders)"]
    names = {"spd": "Statistical Parity Difference", "di": "Disparate Impact",
             "eod": "Equal Opportunity Difference", "aod": "Average Odds Difference"}
    for stage, pred in (("Baseline", "y_pred"), ("Mitigated", "y_pred_after")):
        body = combined_sql("src", "segment", "'BUILDING'", "y", pred)
        for cte in ("c", "w", "r"):
            body = re.sub(rf"\b{cte} AS \(", f"{cte}_{stage} AS (", body)
        body = body.replace("FROM c )", f"FROM c_{stage} )").replace("FROM c)", f"FROM c_{stage})")
        body = body.replace("FROM w)", f"FROM w_{stage})")
        head, sel = body.rsplit("\nSELECT ", 1)
        sel = sel.replace("FROM r", f"FROM r_{stage}")
        out.append(head + f",\nm_{stage} AS (SELECT " + sel + ")")
        rows = [f"SELECT '{stage}' AS stage, '{v}' AS metric, {k} AS value FROM m_{stage}" for k, v in names.items()]
        rows.append(f"SELECT '{stage}', 'Test Accuracy', CAST(COUNT_IF(y = {pred}) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) FROM src")
        out.append(f"l_{stage} AS (" + " UNION ALL ".join(rows) + ")")
    return ",\n".join(out)


_STAGES = _sql(("audit_orders",), _stages_sql())


@register("compare_metrics_orders", _STAGES + """
SELECT COALESCE(b.metric, a.metric) AS metric, b.value AS baseline, a.value AS mitigated, a.value - b.value AS difference
FROM l_Baseline b FULL OUTER JOIN l_Mitigated a ON a.metric = b.metric""")
def _compare(spark, sf):
    b, a = _stages(spark, sf)
    return ev.compare_metrics(b, a)


@register("report_metrics_orders", _STAGES + """
SELECT COALESCE(b.metric, a.metric) AS metric, COALESCE(printf('%.4f', b.value), 'N/A') AS "Baseline",
       COALESCE(printf('%.4f', a.value), 'N/A') AS "Mitigated"
FROM l_Baseline b FULL OUTER JOIN l_Mitigated a ON a.metric = b.metric""")
def _report_metrics(spark, sf):
    b, a = _stages(spark, sf)
    return au.report_metrics(b, a)


@register("metric_long_orders", _STAGES + """
SELECT b.metric, 'Baseline' AS stage, b.value FROM l_Baseline b WHERE b.value IS NOT NULL
UNION ALL SELECT b.metric, 'Mitigated', COALESCE(a.value, 0.0) FROM l_Baseline b LEFT JOIN l_Mitigated a ON a.metric = b.metric
WHERE b.value IS NOT NULL""")
def _metric_long(spark, sf):
    b, a = _stages(spark, sf)
    return au.metric_long(b, a)


@register("tradeoff_points_orders", _STAGES + """,
u AS (SELECT * FROM l_Baseline UNION ALL SELECT * FROM l_Mitigated)
SELECT stage, COALESCE(MAX(CASE WHEN metric = 'Statistical Parity Difference' THEN value END), 0.0) AS "Statistical Parity Difference",
       COALESCE(MAX(CASE WHEN metric = 'Test Accuracy' THEN value END), 0.0) AS "Test Accuracy"
FROM u GROUP BY stage""")
def _tradeoff(spark, sf):
    b, a = _stages(spark, sf)
    return au.tradeoff_points(b.unionByName(a))


# Statistics table before / after counterfactual augmentation
def _stats_sql(src):
    return (f"SELECT 'Total Samples' AS stat, CAST(COUNT(*) AS DOUBLE) AS value FROM {src} "
            f"UNION ALL SELECT 'Missing Values', CAST(COUNT_IF(max_price IS NULL) AS DOUBLE) FROM {src} "
            f"UNION ALL SELECT 'Global Positive Rate', AVG(CAST(y AS DOUBLE)) FROM {src} "
            f"UNION ALL SELECT 'Features Selected', 5.0 UNION ALL SELECT 'Numerical Features', 4.0 "
            f"UNION ALL SELECT 'Categorical Features', 2.0 "
            f"UNION ALL SELECT 'Group ' || chr(39) || segment || chr(39) || ' Size', CAST(COUNT(*) AS DOUBLE) FROM {src} "
            f"WHERE segment IS NOT NULL GROUP BY segment "
            f"UNION ALL SELECT 'Group ' || chr(39) || segment || chr(39) || ' Pos. Rate', AVG(CAST(y AS DOUBLE)) FROM {src} "
            f"WHERE segment IS NOT NULL GROUP BY segment")


@register("report_stats_cda", _sql(("audit_customers",), f"""base AS (SELECT row_id, segment, region, c_acctbal, max_price, y FROM audit_customers),
aft AS (SELECT row_id, segment, region, c_acctbal, max_price, y FROM base UNION ALL
        SELECT row_id, CASE WHEN segment = 'BUILDING' THEN 'AUTOMOBILE' WHEN segment IN ('AUTOMOBILE', 'FURNITURE') THEN 'BUILDING'
               ELSE segment END, region, c_acctbal, max_price, y FROM base),
sb AS ({_stats_sql('base')}),
sa AS ({_stats_sql('aft')})
SELECT COALESCE(sb.stat, sa.stat) AS stat, COALESCE(printf('%.4f', sb.value), 'N/A') AS "Baseline",
       COALESCE(printf('%.4f', sa.value), 'N/A') AS "Mitigated"
FROM sb FULL OUTER JOIN sa ON sa.stat = sb.stat"""))
def _report_stats(spark, sf):
    d = view(spark, sf, "audit_customers").select("row_id", "segment", "region", "c_acctbal", "max_price", "y")
    after = mt.counterfactual_augment(d, "y", "segment", "BUILDING", ["AUTOMOBILE", "FURNITURE"])
    sb = pf.audit_stats(d, "y", "segment").select("stat", "value")
    sa = pf.audit_stats(after, "y", "segment").select("stat", "value")
    return au.report_stats(sb, sa)


# ---------------------------------------------------------------- S1, S3, S5: CSV sink and source round trip
@register("csv_roundtrip_orders", _sql(("audit_orders",), """c AS (SELECT 1)
SELECT row_id, segment, CAST(y AS BIGINT) AS y, o_totalprice, acctbal_n, segment_n FROM audit_orders"""))
def _csv(spark, sf):
    d = view(spark, sf, "audit_orders").select("row_id", "segment", "y", "o_totalprice", "acctbal_n", "segment_n")
    # a folder under the shared checkpoint directory (never a machine-local path on a cluster)
    path = os.path.join(ensure_checkpoint_dir(spark), f"csv-{uuid.uuid4().hex}", "audit_orders.csv")
    io.write_table(d, path)
    return io.read_table(spark, path)


# ---------------------------------------------------------------- T2-T4: the other model families (rows-only)
_FEATS = ["c_acctbal", "n_orders", "max_price"]


def _train_model(model, cv_folds):
    def run(spark, sf):
        d = view(spark, sf, "audit_customers").select("row_id", "y", *_FEATS).fillna(0.0, subset=_FEATS).persist()
        res = md.train(d, "y", _FEATS, model, cv_folds=cv_folds)
        test = md.evaluate_model(res.model, res.test, "y")
        rows = [(k, float(v)) for k, v in res.train_metrics.items()] + [(f"Test {k}", float(v)) for k, v in test.items()]
        return spark.createDataFrame(rows, "metric string, value double")
    return run


for _m in ("random_forest", "gbm", "svm"):
    register(f"train_{_m}_customers")(_train_model(_m, 5))
