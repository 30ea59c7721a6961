"""The fairness contingency counts as a streaming aggregate.

The counts behind SPD / DI / EOD / AOD are sums, so a stream of prediction
rows can maintain them in Spark's state store (``outputMode("complete")`` or
``"update"``); the metrics are a projection of the latest counts. This adds
no operator: it is ``operators.fairness`` applied to a streaming DataFrame.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritylab.operators.fairness import contingency_aggs, metrics_from_rates, ratio, role_expr


def stream_fairness_counts(stream: DataFrame, sens: str, privileged, label: str, pred: str,
                           unprivileged: Sequence | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Running (by..., role) counts of a streaming DataFrame."""
    role = role_expr(sens, privileged, unprivileged)
    return (stream.select(*by, role.alias("role"), F.col(label).alias("_y"), F.col(pred).alias("_p"))
                  .where(F.col("role").isNotNull())
                  .groupBy(*by, "role").agg(*contingency_aggs("_y", "_p")))


def metrics_from_stream_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Batch projection of a snapshot of the streaming counts to metrics."""
    cols = ("n", "n_pred_pos", "n_pos", "n_neg", "n_tp", "n_fp")
    wide = counts.groupBy(*by).agg(*[
        F.coalesce(F.sum(F.when(F.col("role") == side, F.col(c))), F.lit(0)).alias(f"{pre}{c}")
        for side, pre in (("unprivileged", ""), ("privileged", "p_")) for c in cols])
    rated = wide.select(
        "*", ratio("n_pred_pos", "n").alias("u_rate"), ratio("n_tp", "n_pos").alias("u_tpr"),
        ratio("n_fp", "n_neg").alias("u_fpr"), ratio("p_n_pred_pos", "p_n").alias("p_rate"),
        ratio("p_n_tp", "p_n_pos").alias("p_tpr"), ratio("p_n_fp", "p_n_neg").alias("p_fpr"))
    return rated.select(*by, *metrics_from_rates("u_", "p_", "all"))
