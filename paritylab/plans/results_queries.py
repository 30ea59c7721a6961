"""Registered grid-result analysis (B4-B12) and recommendation (R1-R8) queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from paritylab.operators import evaluate as ev
from paritylab.operators import fairness as fm
from paritylab.operators import results as rs
from paritylab.operators import rules as rl
from paritylab.plans.registry import individual_sql, register, view, with_views

SPD = "Statistical Parity Difference"
KEYS_SQL = '"Dataset", "Model Type", "Mitigation Technique"'


def _sql(views: tuple[str, ...], body: str) -> str:
    return with_views("", *views).rstrip() + ",\n" + body


def _q(name, body, views=("grid_results",)):
    return register(name, _sql(views, body))


def grid(spark, sf):
    return view(spark, sf, "grid_results")


@_q("filter_results_grid", """c AS (SELECT 1)
SELECT * FROM grid_results WHERE "Dataset" = 'BUILDING' AND "Mitigation Technique" = 'EUROPE'""")
def _filter(spark, sf):
    return rs.filter_results(grid(spark, sf), dataset="BUILDING", mitigation="EUROPE")


@_q("tradeoff_grid", f"""c AS (SELECT 1)
SELECT {KEYS_SQL}, "Accuracy", "{SPD}" FROM grid_results""")
def _tradeoff(spark, sf):
    return rs.results_tradeoff(grid(spark, sf))


@_q("grouped_metrics_grid", f"""l AS (SELECT "Dataset", "Model Type", 'Accuracy' AS "Metric", "Accuracy" AS "Value" FROM grid_results
      UNION ALL SELECT "Dataset", "Model Type", '{SPD}', "{SPD}" FROM grid_results)
SELECT "Dataset", "Model Type", "Metric", round(AVG("Value"), 9) AS "Value" FROM l GROUP BY 1, 2, 3""")
def _grouped(spark, sf):
    g = rs.grouped_metrics(grid(spark, sf), ["Accuracy", SPD, "ROC AUC"])
    return g.withColumn("Value", F.round("Value", 9))


@_q("metric_distribution_grid", f"""q AS (SELECT "Model Type", "Mitigation Technique", quantile_cont("{SPD}", 0.25) AS q1,
  quantile_cont("{SPD}", 0.5) AS median, quantile_cont("{SPD}", 0.75) AS q3, MIN("{SPD}") AS min, MAX("{SPD}") AS max, COUNT(*) AS n
  FROM grid_results WHERE "{SPD}" IS NOT NULL GROUP BY 1, 2),
v AS (SELECT q.*, "{SPD}" AS x, "{SPD}" BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM q JOIN grid_results USING ("Model Type", "Mitigation Technique") WHERE "{SPD}" IS NOT NULL)
SELECT "Model Type", "Mitigation Technique", q1, median, q3, min, max, n, MIN(CASE WHEN inside THEN x END) AS whisker_low,
  MAX(CASE WHEN inside THEN x END) AS whisker_high, CAST(COUNT_IF(NOT inside) AS BIGINT) AS n_outliers FROM v GROUP BY ALL""")
def _dist(spark, sf):
    box = rs.metric_distribution(grid(spark, sf), SPD, by=())
    return box.withColumn("outliers", F.size("outliers").cast("bigint")).withColumnRenamed("outliers", "n_outliers")


@_q("metric_heatmap_grid", """c AS (SELECT 1)
SELECT "Model Type", "Mitigation Technique", round(AVG("Accuracy"), 9) AS "Accuracy"
FROM grid_results GROUP BY 1, 2 HAVING AVG("Accuracy") IS NOT NULL""")
def _heat(spark, sf):
    return rs.metric_heatmap(grid(spark, sf), "Accuracy", by=()).withColumn("Accuracy", F.round("Accuracy", 9))


@_q("pareto_grid", f"""c AS (SELECT 1)
SELECT g.* FROM grid_results g WHERE NOT EXISTS (
  SELECT 1 FROM grid_results o WHERE o."Dataset" = g."Dataset"
    AND o."Accuracy" >= g."Accuracy" AND abs(o."{SPD}") <= abs(g."{SPD}")
    AND (o."Accuracy" > g."Accuracy" OR abs(o."{SPD}") < abs(g."{SPD}")))""")
def _pareto(spark, sf):
    return rs.pareto_frontier(grid(spark, sf))


@_q("high_performers_grid", """q AS (SELECT "Dataset", quantile_cont("Accuracy", 0.75) + 1.5 * (quantile_cont("Accuracy", 0.75)
                   - quantile_cont("Accuracy", 0.25)) AS fence FROM grid_results GROUP BY 1),
j AS (SELECT g.*, COALESCE(g."Accuracy" > q.fence, FALSE) AS above,
             ROW_NUMBER() OVER (PARTITION BY g."Dataset" ORDER BY g."Accuracy" DESC NULLS LAST, g."Model Type", g."Mitigation Technique") AS rank
      FROM grid_results g JOIN q USING ("Dataset")),
k AS (SELECT *, MAX(CAST(above AS INTEGER)) OVER (PARTITION BY "Dataset") AS anyv FROM j)
SELECT "Dataset", "Model Type", "Mitigation Technique", "Accuracy", "Statistical Parity Difference",
       anyv = 1 AS is_statistical_outlier, rank
FROM k WHERE CASE WHEN anyv = 1 THEN above ELSE rank <= 5 END""")
def _high(spark, sf):
    return rs.high_performers(grid(spark, sf), "Test Accuracy")


@_q("format_results_grid", f"""c AS (SELECT 1)
SELECT "Dataset", "Model Type", "Mitigation Technique", "Accuracy", "{SPD}" FROM grid_results""")
def _format(spark, sf):
    return rs.format_results(grid(spark, sf))


@_q("top_table_grid", f"""r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "Dataset" ORDER BY "Model Type", "Mitigation Technique") AS rn
      FROM grid_results)
SELECT {KEYS_SQL}, printf('%.4f', "Accuracy") AS "Accuracy", printf('%.4f', "{SPD}") AS "{SPD}" FROM r WHERE rn <= 10""")
def _top(spark, sf):
    return rs.results_top_table(grid(spark, sf), ["Accuracy", SPD])


def _advised(recs: str) -> str:
    """The rules' rows with the advised step of each category, and no p-value."""
    steps = ", ".join("('{}', '{}')".format(rl.RULES[k][0], rl.ACTIONS[k]) for k in rl.RULES)
    return f"""
SELECT r.*, a.action, CAST(NULL AS DOUBLE) AS p_value FROM ({recs}) r
JOIN (VALUES {steps}) AS a(category, action) ON r.category = a.category"""


# ---------------------------------------------------------------- R1-R8 over one audit per region
def _stage_metrics(df, pred: str, stage: str, by: str = "region"):
    wide = fm.fairness_metrics(df, "segment", "BUILDING", label="y", pred=pred, mode="individual",
                               by=[by])
    long = fm.fairness_long(wide, by=[by], group_col="group")
    acc = ev.performance(df, "y", pred, by=[by]).select(
        by, F.lit(rl.ACCURACY_KEY).alias("metric"), F.col("accuracy").alias("value"))
    return long.unionByName(acc).withColumn("stage", F.lit(stage))


def _recs_for(by: str, threshold: int):
    def run(spark, sf):
        d = view(spark, sf, "audit_orders").withColumn("y_pred_after",
                                                       (F.col("o_totalprice") >= threshold).cast("int"))
        metrics = _stage_metrics(d, "y_pred", "before", by).unionByName(
            _stage_metrics(d, "y_pred_after", "after", by))
        return rl.fairness_rules(metrics.withColumnRenamed(by, "audit_id"))
    return run


def _recs_sql(by: str = "region", threshold: int = 150000) -> str:
    def stage(pred, name):
        body = individual_sql("src", "segment", "'BUILDING'", "y", pred, by=[by])
        # rename CTEs per stage to keep them apart
        for cte in ("c", "r", "p"):
            body = re.sub(rf"\b{cte} AS \(", f"{cte}_{name} AS (", body)
        body = (body.replace("FROM c)", f"FROM c_{name})").replace("FROM r WHERE", f"FROM r_{name} WHERE")
                    .replace("FROM r JOIN p", f"FROM r_{name} r JOIN p_{name} p"))
        head, sel = body.rsplit("\nSELECT ", 1)
        return head + f",\nm_{name} AS (SELECT " + sel + ")"
    fair = {"spd": "Statistical Parity Difference", "di": "Disparate Impact",
            "eod": "Equal Opportunity Difference", "aod": "Average Odds Difference"}
    longs = []
    for name in ("before", "after"):
        for k, v in fair.items():
            longs.append(f"SELECT {by} AS audit_id, '{name}' AS stage, '{v} (Group: ' || \"group\" || ')' AS metric, "
                         f"{k} AS value FROM m_{name}")
        pred = "y_pred" if name == "before" else "y_pred_after"
        longs.append(f"SELECT {by}, '{name}', 'Test Accuracy', CAST(COUNT_IF(y = {pred}) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) "
                     f"FROM src GROUP BY {by}")
    ideals = {"Disparate Impact": ("di", 1.0), "Statistical Parity Difference": ("spd", 0.0),
              "Equal Opportunity Difference": ("eod", 0.0), "Average Odds Difference": ("aod", 0.0)}
    picks = []
    for base, (short, ideal) in ideals.items():
        for st in ("before", "after"):
            picks.append(f"""{short}_{st} AS (SELECT audit_id, value AS v FROM (SELECT audit_id, value,
                ROW_NUMBER() OVER (PARTITION BY audit_id ORDER BY abs(value - {ideal}) DESC, value DESC) AS rn
                FROM lng WHERE stage = '{st}' AND contains(metric, '{base}') AND value IS NOT NULL) x WHERE rn = 1)""")
    ids = "ids AS (SELECT DISTINCT audit_id FROM lng)"
    cols = []
    joins = []
    for base, (short, ideal) in ideals.items():
        for st in ("before", "after"):
            cols.append(f"COALESCE({short}_{st}.v, {ideal}) AS {short}_{st[0]}")
            joins.append(f"LEFT JOIN {short}_{st} USING (audit_id)")
    for st in ("before", "after"):
        cols.append(f"COALESCE((SELECT MAX(value) FROM lng l WHERE l.audit_id = ids.audit_id AND l.stage = '{st}' "
                    f"AND l.metric = 'Test Accuracy'), 0.0) AS acc_{st[0]}")
    g = f"g AS (SELECT audit_id, {', '.join(cols)} FROM ids {' '.join(joins)})"
    f4 = "printf('%.4f', {})".format
    recs = f"""
SELECT audit_id, 'Fairness Gap Remaining' AS category, 'Mitigation improved parity, but a significant gap still exists.' AS description,
       'Largest Statistical Parity Difference is ' || {f4('spd_a')} || '.' AS evidence, 'High' AS confidence_level
FROM g WHERE (di_a < 0.8 OR di_a > 1.25 OR abs(spd_a) > 0.1) AND (abs(di_a - 1.0) < abs(di_b - 1.0) OR abs(spd_a) < abs(spd_b))
UNION ALL SELECT audit_id, 'Low Mitigation Impact', 'The current method had minimal effect on fairness.',
       'Statistical Parity Difference remains high at ' || {f4('spd_a')} || '.', 'High'
FROM g WHERE (di_a < 0.8 OR di_a > 1.25 OR abs(spd_a) > 0.1) AND NOT (abs(di_a - 1.0) < abs(di_b - 1.0) OR abs(spd_a) < abs(spd_b))
UNION ALL SELECT audit_id, 'Beyond Parity', 'Successfully achieved Demographic Parity.',
       'SPD dropped to ' || {f4('spd_a')} || ' and DI is ' || {f4('di_a')} || '.', 'High'
FROM g WHERE NOT (di_a < 0.8 OR di_a > 1.25 OR abs(spd_a) > 0.1) AND (abs(spd_b) > 0.1 OR di_b < 0.8 OR di_b > 1.25)
UNION ALL SELECT audit_id, 'Error Rate Imbalance', 'Model accuracy is still significantly different between groups.',
       'Equal Opportunity Difference is ' || {f4('eod_a')} || '.', 'High'
FROM g WHERE (abs(eod_a) > 0.1 OR abs(aod_a) > 0.1) AND (abs(eod_a) < abs(eod_b) OR abs(aod_a) < abs(aod_b))
UNION ALL SELECT audit_id, 'Stubborn Error Bias', 'Mitigation failed to balance error rates.',
       'Average Odds Difference is ' || {f4('aod_a')} || '.', 'High'
FROM g WHERE (abs(eod_a) > 0.1 OR abs(aod_a) > 0.1) AND NOT (abs(eod_a) < abs(eod_b) OR abs(aod_a) < abs(aod_b))
UNION ALL SELECT audit_id, 'Equalized Odds Achieved', 'Successfully balanced error rates across groups.',
       'EOD dropped to ' || {f4('eod_a')} || '.', 'High'
FROM g WHERE NOT (abs(eod_a) > 0.1 OR abs(aod_a) > 0.1) AND (abs(eod_b) > 0.1 OR abs(aod_b) > 0.1)
UNION ALL SELECT audit_id, 'Significant Accuracy Trade-off', 'Accuracy dropped significantly after mitigation.',
       'Accuracy dropped by ' || {f4('acc_b - acc_a')} || ' (' || {f4('acc_b')} || ' -> ' || {f4('acc_a')} || ')', 'High'
FROM g WHERE acc_b > 0 AND (acc_b - acc_a) > 0.05"""
    src = f"src AS (SELECT *, CAST(o_totalprice >= {threshold} AS INTEGER) AS y_pred_after FROM audit_orders)"
    body = ",\n".join([src, stage("y_pred", "before"), stage("y_pred_after", "after"),
                       "lng AS (" + " UNION ALL ".join(longs) + ")", *picks, ids, g])
    return _sql(("audit_orders",), body + _advised(recs))


@register("methodology_advice_orders", _sql(("audit_orders",), """s AS (SELECT DISTINCT status AS audit_id,
  CASE WHEN status = 'O' THEN 'Drop rows' WHEN status = 'F' THEN 'Mean' END AS missing_values,
  CASE WHEN status <> 'O' THEN 'Label Encoding' END AS encoding FROM audit_orders)""" + _advised("""
SELECT audit_id, 'Missing Data Bias' AS category, 'Exclusion bias risk due to ''Drop'' strategy.' AS description,
       'Rows with missing data were removed.' AS evidence, 'Medium' AS confidence_level FROM s WHERE missing_values LIKE '%Drop%'
UNION ALL SELECT audit_id, 'Encoding Choice', 'Potential ordinal bias from Label Encoding.',
       'Categorical features were mapped to integers.', 'Medium' FROM s WHERE encoding LIKE '%Label Encoding%'""")))
def _methodology(spark, sf):
    """One audit per order status with its own choices."""
    status = F.col("status")
    choices = view(spark, sf, "audit_orders").select(status.alias("audit_id")).distinct().withColumns({
        "missing_values": F.when(F.col("audit_id") == "O", "Drop rows").when(F.col("audit_id") == "F", "Mean"),
        "encoding": F.when(F.col("audit_id") != "O", "Label Encoding")})
    return rl.methodology_rules(choices)


register("recommendations_by_region", _recs_sql("region", 150000))(_recs_for("region", 150000))
# a second scenario: one audit per order status, a lower threshold for the "after" predictions
register("recommendations_by_status", _recs_sql("status", 100000))(_recs_for("status", 100000))
