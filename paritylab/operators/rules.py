"""Recommendation rules over many audits at once.

Input: a long metric table ``(audit_id, stage, metric, value)`` with stage in
{'before', 'after'}; metric keys may carry a `` (Group: g)`` suffix. One
aggregate pivots each audit to one row of worst gaps; each rule is a CASE on
that row; triggered rules are emitted as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric base names and their ideal values.
IDEALS = {
    "Disparate Impact": 1.0,
    "Statistical Parity Difference": 0.0,
    "Equal Opportunity Difference": 0.0,
    "Average Odds Difference": 0.0,
}
ACCURACY_KEY = "Test Accuracy"

# Rule categories, descriptions, confidence levels and evidence
# formats.
RULES = {
    "gap_remaining": ("Fairness Gap Remaining",
                      "Mitigation improved parity, but a significant gap still exists.", "High",
                      "Largest Statistical Parity Difference is %.4f."),
    "low_impact": ("Low Mitigation Impact", "The current method had minimal effect on fairness.", "High",
                   "Statistical Parity Difference remains high at %.4f."),
    "beyond_parity": ("Beyond Parity", "Successfully achieved Demographic Parity.", "High",
                      "SPD dropped to %.4f and DI is %.4f."),
    "error_imbalance": ("Error Rate Imbalance",
                        "Model accuracy is still significantly different between groups.", "High",
                        "Equal Opportunity Difference is %.4f."),
    "stubborn": ("Stubborn Error Bias", "Mitigation failed to balance error rates.", "High",
                 "Average Odds Difference is %.4f."),
    "odds_achieved": ("Equalized Odds Achieved", "Successfully balanced error rates across groups.", "High",
                      "EOD dropped to %.4f."),
    "accuracy_tradeoff": ("Significant Accuracy Trade-off",
                          "Accuracy dropped significantly after mitigation.", "High",
                          "Accuracy dropped by %.4f (%.4f -> %.4f)"),
    "missing_bias": ("Missing Data Bias", "Exclusion bias risk due to 'Drop' strategy.", "Medium",
                     "Rows with missing data were removed."),
    "encoding": ("Encoding Choice", "Potential ordinal bias from Label Encoding.", "Medium",
                 "Categorical features were mapped to integers."),
}


def worst_gaps(metrics: DataFrame, audit: str = "audit_id") -> DataFrame:
    """Per (audit, stage, base metric) the value furthest from its ideal
    (a base with no key yields the ideal), plus the accuracy, one row per audit."""
    aggs = []
    for stage in ("before", "after"):
        for base, ideal in IDEALS.items():
            hit = (F.col("stage") == stage) & F.col("metric").contains(base) & F.col("value").isNotNull()
            dist = F.abs(F.col("value") - F.lit(ideal))
            picked = F.max_by(F.when(hit, F.col("value")), F.when(hit, F.struct(dist, F.col("value"))))
            aggs.append(F.coalesce(picked, F.lit(ideal)).alias(f"{_short(base)}_{stage}"))
        acc = F.max(F.when((F.col("stage") == stage) & (F.col("metric") == ACCURACY_KEY), F.col("value")))
        aggs.append(F.coalesce(acc, F.lit(0.0)).alias(f"acc_{stage}"))
    return metrics.groupBy(audit).agg(*aggs)


def _short(base: str) -> str:
    return {"Disparate Impact": "di", "Statistical Parity Difference": "spd",
            "Equal Opportunity Difference": "eod", "Average Odds Difference": "aod"}[base]


# The step that each rule advises.
ACTIONS = {
    "gap_remaining": "Add an in-processing method, such as adversarial debiasing, to the pre-processing step.",
    "low_impact": "Choose another mitigation method, and look for features that stand in for the sensitive attribute.",
    "beyond_parity": "Turn to equalized odds next: compare the error rates of qualified members of the groups.",
    "error_imbalance": "Post-process the scores, for example with calibrated equalized odds and a threshold per group.",
    "stubborn": "Use a constrained training method, or gather better balanced data for the smaller groups.",
    "odds_achieved": "Keep watching the error rates of the groups as new data arrives.",
    "accuracy_tradeoff": "Weaken the mitigation, for example with smaller resampling ratios, or train a stronger model.",
    "missing_bias": "Compare how often each group lacks values before rows are dropped; impute where it differs.",
    "encoding": "Use one-hot encoding, so that no order is read into the categories.",
}


def _rec(key: str, *values: Column) -> Column:
    """One recommendation; ``values`` fill the evidence format in order. These rules rest on no test, so p_value is null."""
    category, description, confidence, template = RULES[key]
    return F.struct(F.lit(category).alias("category"), F.lit(description).alias("description"),
                    (F.format_string(template, *values) if values else F.lit(template)).alias("evidence"),
                    F.lit(ACTIONS[key]).alias("action"), F.lit(confidence).alias("confidence_level"),
                    F.lit(None).cast("double").alias("p_value"))


def fairness_rules(metrics: DataFrame, audit: str = "audit_id") -> DataFrame:
    """Triggered recommendations, one row each."""
    g = worst_gaps(metrics, audit)
    di_a, di_b, spd_a, spd_b = (F.col(c) for c in ("di_after", "di_before", "spd_after", "spd_before"))
    eod_a, eod_b, aod_a, aod_b = (F.col(c) for c in ("eod_after", "eod_before", "aod_after", "aod_before"))
    acc_a, acc_b = F.col("acc_after"), F.col("acc_before")
    parity_gap_a = (di_a < 0.8) | (di_a > 1.25) | (F.abs(spd_a) > 0.1)
    parity_gap_b = (F.abs(spd_b) > 0.1) | (di_b < 0.8) | (di_b > 1.25)
    parity_better = (F.abs(di_a - 1.0) < F.abs(di_b - 1.0)) | (F.abs(spd_a) < F.abs(spd_b))
    odds_gap_a = (F.abs(eod_a) > 0.1) | (F.abs(aod_a) > 0.1)
    odds_gap_b = (F.abs(eod_b) > 0.1) | (F.abs(aod_b) > 0.1)
    odds_better = (F.abs(eod_a) < F.abs(eod_b)) | (F.abs(aod_a) < F.abs(aod_b))
    parity = (F.when(parity_gap_a & parity_better, _rec("gap_remaining", spd_a))
               .when(parity_gap_a, _rec("low_impact", spd_a))
               .when(parity_gap_b, _rec("beyond_parity", spd_a, di_a)))
    odds = (F.when(odds_gap_a & odds_better, _rec("error_imbalance", eod_a))
             .when(odds_gap_a, _rec("stubborn", aod_a))
             .when(odds_gap_b, _rec("odds_achieved", eod_a)))
    accuracy = F.when((acc_b > 0) & ((acc_b - acc_a) > 0.05), _rec("accuracy_tradeoff", acc_b - acc_a, acc_b, acc_a))
    recs = g.select(audit, F.explode(F.array(parity, odds, accuracy)).alias("r")).where(F.col("r").isNotNull())
    return recs.select(audit, "r.*")


def methodology_rules(selections: DataFrame, audit: str = "audit_id") -> DataFrame:
    """R9/R10 from a table (audit_id, missing_values, encoding)."""
    r9 = F.when(F.coalesce(F.col("missing_values"), F.lit("")).contains("Drop"),
                _rec("missing_bias"))
    r10 = F.when(F.coalesce(F.col("encoding"), F.lit("")).contains("Label Encoding"),
                 _rec("encoding"))
    recs = selections.select(audit, F.explode(F.array(r9, r10)).alias("r")).where(F.col("r").isNotNull())
    return recs.select(audit, "r.*")


def recommendations(metrics: DataFrame, selections: DataFrame | None = None,
                    audit: str = "audit_id") -> DataFrame:
    out = fairness_rules(metrics, audit)
    if selections is not None:
        out = out.unionByName(methodology_rules(selections, audit))
    return out
