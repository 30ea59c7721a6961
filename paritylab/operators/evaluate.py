"""Performance metrics and curves (E1-E12) from shared aggregates.

Point metrics come from the (label, prediction) counts per ``by`` key (one
partial aggregate), for any set of classes; scores are for binary labels in {0,1}: ROC AUC and precision-recall use a
per-score count table and distributed running sums (``ranking.running_sums``),
never an unpartitioned window over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritylab.operators.fairness import ratio
from paritylab.operators.ranking import broadcast_if_small, running_sums


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def confusion(df: DataFrame, label, pred, by: Sequence[str] = ()) -> DataFrame:
    """Counts per (by..., y, y_pred); pass ``by=[sens]`` for per-group matrices."""
    return (df.groupBy(*by, _c(label).alias("y_true"), _c(pred).alias("y_pred"))
              .agg(F.count(F.lit(1)).alias("n")))


def _safe(num: Column, den: Column) -> Column:
    return F.coalesce(F.when(den != 0, num.cast("double") / den.cast("double")), F.lit(0.0))


def performance(df: DataFrame, label, pred, by: Sequence[str] = ()) -> DataFrame:
    """E1-E5 for any set of classes: accuracy; precision, recall and F1 weighted by class support, zero where
    undefined; balanced accuracy over the classes that occur as labels. Rows without label or prediction are
    left out. One count per (by, label, prediction), then per class."""
    by = list(by)
    table = df.select(*by, _c(label).alias("_y"), _c(pred).alias("_p"))
    kinds = {t for n, t in table.dtypes if n in ("_y", "_p")}
    kind = "string" if "string" in kinds else "double"  # labels and predictions meet in one type
    table = table.select(*by, F.col("_y").cast(kind), F.col("_p").cast(kind)).where("_y IS NOT NULL AND _p IS NOT NULL")
    cells = table.groupBy(*by, "_y", "_p").agg(F.count(F.lit(1)).alias("_n"))
    none, hit = F.lit(0).cast("long"), F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(F.lit(0).cast("long"))
    sides = F.array(F.struct(F.col("_y").alias("c"), F.col("_n").alias("s"), none.alias("p"), hit.alias("t")),
                    F.struct(F.col("_p").alias("c"), none.alias("s"), F.col("_n").alias("p"), none.alias("t")))
    classes = (cells.select(*by, F.explode(sides).alias("x")).groupBy(*by, F.col("x.c").alias("_class"))
               .agg(F.sum("x.s").alias("s"), F.sum("x.p").alias("p"), F.sum("x.t").alias("t"))
               .withColumns({"prec": _safe(F.col("t"), F.col("p")), "rec": _safe(F.col("t"), F.col("s"))})
               .withColumn("f1", _safe(F.lit(2.0) * F.col("prec") * F.col("rec"), F.col("prec") + F.col("rec"))))

    def weighted(c):
        return F.sum(F.col("s").cast("double") * F.col(c)) / F.sum("s").cast("double")

    return classes.groupBy(*by).agg(
        ratio(F.sum("t"), F.sum("s")).alias("accuracy"), weighted("prec").alias("precision"), weighted("rec").alias("recall"),
        weighted("f1").alias("f1"), F.avg(F.when(F.col("s") > 0, F.col("rec"))).alias("balanced_accuracy"),
        F.coalesce(F.sum("s"), F.lit(0)).alias("n"))


def score_counts(df: DataFrame, label, score, by: Sequence[str] = ()) -> DataFrame:
    """Positives / negatives per distinct score (ties aggregated)."""
    return (df.where(_c(score).isNotNull())
              .groupBy(*by, _c(score).cast("double").alias("score"))
              .agg(F.count_if(_c(label) == 1).alias("pos"),
                   F.count_if(_c(label) == 0).alias("neg")))


def roc_auc(df: DataFrame, label, score, by: Sequence[str] = ()) -> DataFrame:
    """Exact ROC AUC with ties counted 1/2 (Mann-Whitney in integers);
    NULL unless both classes are present."""
    sc = score_counts(df, label, score, by)
    cum = running_sums(sc, "score", ["neg"], by=by)
    dec = "decimal(38,0)"
    term = F.col("pos").cast(dec) * (F.lit(2).cast(dec) * (F.col("cum_neg") - F.col("neg")).cast(dec)
                                     + F.col("neg").cast(dec))
    agg = cum.groupBy(*by).agg(F.sum(term).alias("_num"), F.sum("pos").alias("_p"),
                               F.sum("neg").alias("_n"))
    den = F.lit(2).cast(dec) * F.col("_p").cast(dec) * F.col("_n").cast(dec)
    auc = F.when((F.col("_p") > 0) & (F.col("_n") > 0),
                 F.col("_num").cast("double") / den.cast("double"))
    return agg.select(*by, auc.alias("roc_auc"))


def pr_curve(df: DataFrame, label, score, by: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score threshold t (score >= t predicted 1)."""
    sc = score_counts(df, label, score, by)
    cum = running_sums(sc, "score", ["pos", "neg"], by=by, descending=True)
    keys = list(by) or ["_k"]
    totals = sc.groupBy(*by).agg(F.sum("pos").alias("_P"))
    if not by:
        cum, totals = cum.withColumn("_k", F.lit(0)), totals.withColumn("_k", F.lit(0))
    cum = cum.join(broadcast_if_small(totals), keys, "inner")  # one row per audit key
    return cum.select(
        *by, F.col("score").alias("threshold"), F.col("pos"),
        ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        F.when(F.col("_P") > 0, F.col("cum_pos").cast("double") / F.col("_P").cast("double"))
         .otherwise(F.lit(1.0)).alias("recall"),
        F.col("_P").alias("total_pos"))


def average_precision(df: DataFrame, label, score, by: Sequence[str] = ()) -> DataFrame:
    """AP = sum_n (R_n - R_{n-1}) P_n = (1/P) sum_t pos_t * precision_t."""
    pts = pr_curve(df, label, score, by)
    return (pts.groupBy(*by)
               .agg(F.sum(F.col("pos").cast("double") * F.col("precision")).alias("_s"),
                    F.max("total_pos").alias("_P"))
               .select(*by, F.when(F.col("_P") > 0, F.col("_s") / F.col("_P").cast("double"))
                       .alias("average_precision")))


def compare_metrics(before: DataFrame, after: DataFrame, key: str = "metric",
                    value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Full outer join of two long metric tables on the metric key."""
    b = before.select(*by, key, F.col(value).alias("baseline"))
    a = after.select(*by, key, F.col(value).alias("mitigated"))
    j = b.join(a, [*by, key], "full_outer")
    return j.select(*by, key, "baseline", "mitigated",
                    (F.col("mitigated") - F.col("baseline")).alias("difference"))
