"""Registered fairness and performance queries (F*, E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from paritylab.operators import evaluate as ev
from paritylab.operators import fairness as fm
from paritylab.plans.registry import (combined_sql, individual_sql, register, view,
                                      with_views)

def _sql(views: tuple[str, ...], body: str) -> str:
    txt = with_views("", *views)
    return txt.rstrip() + ",\n" + body


# Privileged segment vs each other segment
register("fairness_individual_orders", _sql(("audit_orders",),
         individual_sql("audit_orders", "segment", "'BUILDING'", "y", "y_pred")))(
    lambda spark, sf: fm.fairness_metrics(view(spark, sf, "audit_orders"), "segment", "BUILDING",
                                          label="y", pred="y_pred", mode="individual"))

# privileged vs pooled others, one audit per region (``by``)
register("fairness_combined_orders_by_region", _sql(("audit_orders",),
         combined_sql("audit_orders", "segment", "'BUILDING'", "y", "y_pred", by=["region"])))(
    lambda spark, sf: fm.fairness_metrics(view(spark, sf, "audit_orders"), "segment", "BUILDING",
                                          label="y", pred="y_pred", mode="combined", by=["region"]))

# nullable attribute: null group excluded from both sides
register("fairness_combined_orders_nullable", _sql(("audit_orders",),
         combined_sql("audit_orders", "segment_n", "'BUILDING'", "y", "y_pred")))(
    lambda spark, sf: fm.fairness_metrics(view(spark, sf, "audit_orders"), "segment_n", "BUILDING",
                                          label="y", pred="y_pred", mode="combined"))

# scale fixture: 600k rows at sf0.1, privileged return flag N, by line status
register("fairness_individual_lineitem", _sql(("audit_lineitem",),
         individual_sql("audit_lineitem", "grp", "'N'", "y", "y_pred", by=["grp2"])))(
    lambda spark, sf: fm.fairness_metrics(view(spark, sf, "audit_lineitem"), "grp", "N",
                                          label="y", pred="y_pred", mode="individual", by=["grp2"]))

# F8: parity over the true labels of a table (dataset metric)
register("fairness_label_parity_docs", _sql(("audit_docs",),
         individual_sql("audit_docs", "lang", "'en'", "y", "y", parity_only=True)))(
    lambda spark, sf: fm.fairness_metrics(view(spark, sf, "audit_docs"), "lang", "en",
                                          label="y", mode="individual"))


# two attributes and their composite in one scan
def _audit_many_sql() -> str:
    def one(attr_name, expr, priv):
        return (f"SELECT '{attr_name}' AS attribute, CASE WHEN {expr} = '{priv}' THEN 'privileged' "
                f"ELSE 'unprivileged' END AS role, y, y_pred FROM audit_orders WHERE {expr} IS NOT NULL")
    comp = "(COALESCE(CAST(segment AS VARCHAR), 'nan') || '_' || COALESCE(CAST(region AS VARCHAR), 'nan'))"
    fan = " UNION ALL ".join([one("segment", "segment", "BUILDING"), one("region", "region", "EUROPE"),
                              one("segment_region", comp, "BUILDING_EUROPE")])
    return _sql(("audit_orders",), f"fan AS ({fan}),\n" + combined_sql(
        "fan", "role", "'privileged'", "y", "y_pred", by=["attribute"]))


register("fairness_intersectional_orders", _audit_many_sql())(
    lambda spark, sf: fm.audit_many(view(spark, sf, "audit_orders"), ["segment", "region"],
                                    {"segment": "BUILDING", "region": "EUROPE"},
                                    label="y", pred="y_pred"))

# z-test p-value of each group's favourable-outcome rate vs privileged
_ERF_SQL = """
z AS (SELECT g.*, p.n AS p_n, p.positive_rate AS p_rate FROM g JOIN g AS p ON p."group" = 'BUILDING'
      WHERE g."group" <> 'BUILDING'),
zz AS (SELECT *, (positive_rate * n + p_rate * p_n) / (n + p_n) AS pooled FROM z),
s AS (SELECT *, sqrt(pooled * (1.0 - pooled) * (1.0 / n + 1.0 / p_n)) AS se FROM zz),
x AS (SELECT *, CASE WHEN se = 0 THEN NULL ELSE abs((positive_rate - p_rate) / se) / sqrt(2.0) END AS ax FROM s),
terms AS (SELECT "group", k, SUM(ln(2 * k + 1)) OVER (PARTITION BY "group" ORDER BY k) AS lnfact, ax
          FROM x, range(0, 201) t(k) WHERE ax IS NOT NULL AND ax > 0),
ser AS (SELECT "group", SUM(exp((2 * k + 1) * ln(ax) + k * ln(2.0) - lnfact)) AS sm, ANY_VALUE(ax) AS ax
        FROM terms GROUP BY "group"),
pv AS (SELECT x."group", CASE WHEN x.se = 0 OR x.se IS NULL THEN 1.0
        WHEN x.ax = 0 THEN 1.0
        WHEN x.ax > 6.0 THEN 0.0
        ELSE 2.0 * (1.0 - 0.5 * (1.0 + least(2.0 / sqrt(pi()) * exp(-x.ax * x.ax) * ser.sm, 1.0))) END AS p_value
       FROM x LEFT JOIN ser ON x."group" = ser."group")
SELECT z."group", z.n, z.positive_rate, round(pv.p_value, 6) AS p_value, round(pv.p_value, 6) < 0.05 AS significant
FROM z JOIN pv ON z."group" = pv."group"
"""

register("parity_significance_orders", _sql(("audit_orders",),
         "g AS (SELECT segment AS \"group\", COUNT(*) AS n, COUNT_IF(y_pred = 1) AS n_pos, "
         "CAST(COUNT_IF(y_pred = 1) AS DOUBLE) / NULLIF(COUNT(*), 0) AS positive_rate "
         "FROM audit_orders WHERE segment IS NOT NULL GROUP BY segment),\n" + _ERF_SQL))(
    lambda spark, sf: fm.parity_significance(view(spark, sf, "audit_orders"), "segment", "BUILDING",
                                             "y_pred")
    .select("group", "n", "positive_rate", F.round("p_value", 6).alias("p_value"),
            (F.round("p_value", 6) < 0.05).alias("significant")))

# E1-E5 per segment
_PERF_SQL = """
c AS (SELECT segment, COUNT_IF(y = 1 AND y_pred = 1) AS tp, COUNT_IF(y = 0 AND y_pred = 0) AS tn,
             COUNT_IF(y = 0 AND y_pred = 1) AS fp, COUNT_IF(y = 1 AND y_pred = 0) AS fn
      FROM audit_orders GROUP BY segment),
d AS (SELECT *, tp + tn + fp + fn AS n, tp + fn AS s1, tn + fp AS s0,
      COALESCE(CASE WHEN tp + fp <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END, 0.0) AS prec1,
      COALESCE(CASE WHEN tn + fn <> 0 THEN CAST(tn AS DOUBLE) / CAST(tn + fn AS DOUBLE) END, 0.0) AS prec0,
      COALESCE(CASE WHEN tp + fn <> 0 THEN CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END, 0.0) AS rec1,
      COALESCE(CASE WHEN tn + fp <> 0 THEN CAST(tn AS DOUBLE) / CAST(tn + fp AS DOUBLE) END, 0.0) AS rec0
      FROM c),
e AS (SELECT *, CASE WHEN prec0 + rec0 <> 0 THEN 2.0 * prec0 * rec0 / (prec0 + rec0) ELSE 0.0 END AS f10,
              CASE WHEN prec1 + rec1 <> 0 THEN 2.0 * prec1 * rec1 / (prec1 + rec1) ELSE 0.0 END AS f11,
              CAST(s0 > 0 AS INTEGER) + CAST(s1 > 0 AS INTEGER) AS present FROM d)
SELECT segment,
       CASE WHEN n <> 0 THEN CAST(tp + tn AS DOUBLE) / CAST(n AS DOUBLE) END AS accuracy,
       (CAST(s0 AS DOUBLE) * prec0 + CAST(s1 AS DOUBLE) * prec1) / CAST(n AS DOUBLE) AS precision,
       (CAST(s0 AS DOUBLE) * rec0 + CAST(s1 AS DOUBLE) * rec1) / CAST(n AS DOUBLE) AS recall,
       (CAST(s0 AS DOUBLE) * f10 + CAST(s1 AS DOUBLE) * f11) / CAST(n AS DOUBLE) AS f1,
       CASE WHEN present > 0 THEN ((CASE WHEN s0 > 0 THEN rec0 ELSE 0.0 END) + (CASE WHEN s1 > 0 THEN rec1 ELSE 0.0 END))
            / CAST(present AS DOUBLE) END AS balanced_accuracy,
       CAST(n AS BIGINT) AS n
FROM e
"""
register("performance_orders_by_segment", _sql(("audit_orders",), _PERF_SQL))(
    lambda spark, sf: ev.performance(view(spark, sf, "audit_orders"), "y", "y_pred", by=["segment"]))

# Confusion matrix per group
register("confusion_by_segment", _sql(("audit_orders",),
         "c AS (SELECT 1)\nSELECT segment, y AS y_true, y_pred, COUNT(*) AS n FROM audit_orders GROUP BY 1, 2, 3"))(
    lambda spark, sf: ev.confusion(view(spark, sf, "audit_orders"), "y", "y_pred", by=["segment"]))


def _auc_sql(src: str, by: str) -> str:
    return (f"sc AS (SELECT {by}, CAST(score AS DOUBLE) AS score, COUNT_IF(y = 1) AS pos, COUNT_IF(y = 0) AS neg "
            f"FROM {src} WHERE score IS NOT NULL GROUP BY 1, 2),\n"
            f"cum AS (SELECT *, SUM(neg) OVER (PARTITION BY {by} ORDER BY score ROWS UNBOUNDED PRECEDING) AS cum_neg FROM sc)\n"
            f"SELECT {by}, CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0 THEN "
            f"CAST(SUM(CAST(pos AS HUGEINT) * (2 * CAST(cum_neg - neg AS HUGEINT) + neg)) AS DOUBLE) / "
            f"CAST(2 * CAST(SUM(pos) AS HUGEINT) * CAST(SUM(neg) AS HUGEINT) AS DOUBLE) END AS roc_auc "
            f"FROM cum GROUP BY {by}")


# Exact AUC, continuous score (orders) and heavily tied score (lineitem)
register("roc_auc_orders_by_segment", _sql(("audit_orders",), _auc_sql("audit_orders", "segment")))(
    lambda spark, sf: ev.roc_auc(view(spark, sf, "audit_orders"), "y", "score", by=["segment"]))
register("roc_auc_lineitem_by_flag", _sql(("audit_lineitem",), _auc_sql("audit_lineitem", "grp")))(
    lambda spark, sf: ev.roc_auc(view(spark, sf, "audit_lineitem"), "y", "score", by=["grp"]))

# Precision-recall points per distinct threshold
_PR_SQL = """
sc AS (SELECT grp, CAST(score AS DOUBLE) AS score, COUNT_IF(y = 1) AS pos, COUNT_IF(y = 0) AS neg
       FROM audit_lineitem WHERE score IS NOT NULL GROUP BY 1, 2),
cum AS (SELECT *, SUM(pos) OVER (PARTITION BY grp ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
                  SUM(neg) OVER (PARTITION BY grp ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_neg,
                  SUM(pos) OVER (PARTITION BY grp) AS total_pos FROM sc)
SELECT grp, score AS threshold, CAST(pos AS BIGINT) AS pos,
       CASE WHEN cum_pos + cum_neg <> 0 THEN CAST(cum_pos AS DOUBLE) / CAST(cum_pos + cum_neg AS DOUBLE) END AS precision,
       CASE WHEN total_pos > 0 THEN CAST(cum_pos AS DOUBLE) / CAST(total_pos AS DOUBLE) ELSE 1.0 END AS recall,
       CAST(total_pos AS BIGINT) AS total_pos
FROM cum
"""
register("pr_curve_lineitem_by_flag", _sql(("audit_lineitem",), _PR_SQL))(
    lambda spark, sf: ev.pr_curve(view(spark, sf, "audit_lineitem"), "y", "score", by=["grp"]))

# Average precision (sum of doubles -> compared at 9 decimals)
_AP_SQL = """
sc AS (SELECT segment, CAST(score AS DOUBLE) AS score, COUNT_IF(y = 1) AS pos, COUNT_IF(y = 0) AS neg
       FROM audit_orders WHERE score IS NOT NULL GROUP BY 1, 2),
cum AS (SELECT *, SUM(pos) OVER (PARTITION BY segment ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos,
                  SUM(neg) OVER (PARTITION BY segment ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_neg,
                  SUM(pos) OVER (PARTITION BY segment) AS total_pos FROM sc)
SELECT segment, round(CASE WHEN MAX(total_pos) > 0 THEN
       SUM(CAST(pos AS DOUBLE) * CAST(cum_pos AS DOUBLE) / CAST(cum_pos + cum_neg AS DOUBLE)) / CAST(MAX(total_pos) AS DOUBLE)
       END, 9) AS average_precision
FROM cum GROUP BY segment
"""
register("average_precision_orders_by_segment", _sql(("audit_orders",), _AP_SQL))(
    lambda spark, sf: ev.average_precision(view(spark, sf, "audit_orders"), "y", "score", by=["segment"])
    .select("segment", F.round("average_precision", 9).alias("average_precision")))
