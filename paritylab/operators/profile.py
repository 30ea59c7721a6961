"""Validation, profiling and exploratory tables.

Each profile is one aggregate over the table (or one ``groupBy``), returning a
small DataFrame: the data behind the reference's plots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritylab.functions import quantiles as qn
from paritylab.operators.prep import TEXT_TYPES, categorical_columns, numeric_columns
from paritylab.operators.ranking import broadcast_if_small

# Fixed value: share of castable non-null cells above which a text column is numeric.
NUMERIC_SHARE = 0.8
_NUMBER_RE = r"^\s*[+-]?((\d+(\.\d*)?)|(\.\d+))([eE][+-]?\d+)?\s*$"
_INF_RE = r"^\s*[+-]?(inf|infinity)\s*$"
_INT_RE = r"^\s*[+-]?\d+\s*$"


def validate_dataset(df: DataFrame) -> tuple[bool, str]:
    """V1: at least one row and two columns (``isEmpty`` reads one row only)."""
    if len(df.columns) < 2:
        return False, "dataset needs at least two columns"
    if df.isEmpty():
        return False, "dataset is empty"
    return True, "ok"


def count_duplicates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """V2: rows repeating an earlier row (nulls compare equal)."""
    cols = list(cols or df.columns)
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
              .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")))


def drop_duplicates(df: DataFrame, key: str | None = None) -> DataFrame:
    """V3: one row per distinct content; with a ``key`` the smallest key is kept."""
    if key is None:
        return df.dropDuplicates()
    cols = [c for c in df.columns if c != key]
    return df.groupBy(*cols).agg(F.min(key).alias(key)).select(*df.columns)


def validate_labels(df: DataFrame, target: str, labels: Sequence) -> DataFrame:
    """V5: does any row carry one of the expected labels (compared as text)?"""
    return df.agg(F.max(F.col(target).cast("string").isin([str(x) for x in labels]).cast("int"))
                  .alias("_m")).select(F.coalesce(F.col("_m") == 1, F.lit(False)).alias("labels_present"))


def _castable(c: Column) -> Column:
    s = c.cast("string")
    return s.rlike(_NUMBER_RE) | F.lower(s).rlike(_INF_RE)


def infer_numeric(df: DataFrame, cols: Sequence[str] | None = None,
                  share: float = NUMERIC_SHARE) -> tuple[DataFrame, list[str]]:
    """V7: text columns whose castable share of non-null cells is >= ``share``
    become numbers (failing cells -> NULL); all decided in ONE aggregate.
    Integers stay BIGINT when every non-null cell is an integer literal."""
    text = [c for c in (cols or df.columns) if isinstance(df.schema[c].dataType, TEXT_TYPES)]
    if not text:
        return df, []
    aggs = []
    for c in text:
        aggs += [F.count(c).alias(f"{c}__nn"), F.count_if(_castable(F.col(c))).alias(f"{c}__ok"),
                 F.count_if(F.col(c).rlike(_INT_RE)).alias(f"{c}__int")]
    row = df.agg(*aggs).first()
    converted, as_int = [], set()
    for c in text:
        nn, ok, ints = row[f"{c}__nn"], row[f"{c}__ok"], row[f"{c}__int"]
        if ok > 0 and nn > 0 and ok / nn >= share:
            converted.append(c)
            if ints == nn:
                as_int.add(c)
    sel = []
    for c in df.columns:
        if c in converted:
            good = F.when(_castable(F.col(c)), F.trim(F.col(c)))
            sel.append((good.cast("bigint") if c in as_int else good.cast("double")).alias(c))
        else:
            sel.append(F.col(c))
    return df.select(*sel), converted


def basic_stats(df: DataFrame) -> DataFrame:
    """V8: row count and total missing cells, one aggregate."""
    miss = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("rows"), miss.cast("bigint").alias("missing_cells"))


def missing_profile(df: DataFrame) -> DataFrame:
    """V9: missing cells per column (long), one aggregate then unpivot."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("bigint").alias("missing"))
        for c in df.columns])).alias("kv")).select("kv.column", "kv.missing")


def audit_stats(df: DataFrame, target: str, sens: str, selected: Sequence[str] | None = None,
                original_features: int | None = None) -> DataFrame:
    """Long table (stat, group, value) with the report's statistic names:
    totals, column kinds, global positive rate and, per group (null group
    excluded), size and positive rate -- two aggregates."""
    n_num = len(numeric_columns(df))
    n_other = len(df.columns) - n_num
    n_sel = len(selected) if selected is not None else len(df.columns) - 1
    miss = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    y = F.col(target).cast("double")
    totals = df.agg(F.count(F.lit(1)).cast("double").alias("total"),
                    miss.cast("double").alias("missing"),
                    F.avg(y).alias("rate"))
    fixed_vals = [("Features Selected", n_sel), ("Numerical Features", n_num), ("Categorical Features", n_other)]
    if original_features is not None:
        fixed_vals.insert(0, ("Total Features", original_features))
    none = F.lit(None).cast("string")
    fixed = totals.select(F.explode(F.array(
        *[F.struct(F.lit(k).alias("stat"), none.alias("group"), F.col(c).alias("value"))
          for k, c in (("Total Samples", "total"), ("Missing Values", "missing"), ("Global Positive Rate", "rate"))],
        *[F.struct(F.lit(k).alias("stat"), none.alias("group"), F.lit(float(v)).alias("value"))
          for k, v in fixed_vals])).alias("kv"))
    per = (df.where(F.col(sens).isNotNull())
             .groupBy(F.col(sens).cast("string").alias("group"))
             .agg(F.count(F.lit(1)).cast("double").alias("size"), F.avg(y).alias("positive_rate")))

    def label(suffix):
        return F.concat(F.lit("Group '"), F.col("group"), F.lit(f"' {suffix}"))

    per_long = per.select(F.explode(F.array(
        F.struct(label("Size").alias("stat"), F.col("group"), F.col("size").alias("value")),
        F.struct(label("Pos. Rate").alias("stat"), F.col("group"),
                 F.col("positive_rate").alias("value")))).alias("kv"))
    return fixed.select("kv.*").unionByName(per_long.select("kv.*"))


def rename_groups(stats: DataFrame, mapping: DataFrame, group: str = "group") -> DataFrame:
    """Display names for group keys: exact text match first, then numeric
    match (0 == 0.0). ``mapping`` (key, name) is a small table."""
    m = mapping.select(F.col("key").cast("string").alias("_k"), F.col("name").alias("_name"))
    mn = mapping.select(F.col("key").cast("string").try_cast(T.DoubleType()).alias("_kn"),
                        F.col("name").alias("_name_n")).where(F.col("_kn").isNotNull())
    mn = mn.groupBy("_kn").agg(F.min("_name_n").alias("_name_n"))
    s = stats.withColumn("_g", F.col(group).cast("string"))
    # no broadcast hint: the lookup table's size is not known here; AQE
    # broadcasts it at runtime when it is small
    s = s.join(m, s["_g"] == m["_k"], "left")
    s = s.withColumn("_gn", F.col("_g").try_cast(T.DoubleType()))
    s = s.join(mn, s["_gn"] == mn["_kn"], "left")
    named = F.coalesce(F.col("_name"), F.col("_name_n"), F.col(group).cast("string"))
    return s.select(*[named.alias(group) if c == group else F.col(c) for c in stats.columns])


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Normalised class shares (nulls excluded from count and total)."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    # total over the small count table (one row per class)
    w = Window.partitionBy(F.lit(0))
    return counts.select(target, "n", (F.col("n").cast("double") / F.sum("n").over(w).cast("double"))
                         .alias("share"))


def value_mapping(before: DataFrame, after: DataFrame, col: str, key: str = "row_id") -> DataFrame:
    """Distinct (original, encoded) pairs of the same row."""
    b = before.select(key, F.col(col).alias("original"))
    a = after.select(key, F.col(col).alias("encoded"))
    return (b.join(a, key).where(F.col("original").isNotNull() & F.col("encoded").isNotNull())
              .select("original", "encoded").distinct())


def group_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column."""
    return df.select(col).distinct()


# ----------------------------------------------------------------- A1-A11

def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """A1: class counts."""
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (),
              limit: int | None = None, k: float = 1.5) -> DataFrame:
    """A2/A3: quartiles, whiskers (furthest points within k*IQR) and outlier
    counts per numeric column (all, or the first ``limit`` that a report shows)
    and ``by`` key, from an unpivoted (by, column, value) view."""
    cols = numeric_columns(df, cols)[:limit]
    keys = [*by, "column"]
    long = qn.long_values(df, cols, by)
    q = qn.exact_quantiles(long, keys, [0.25, 0.5, 0.75]) \
        .select(*keys, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    q = q.withColumn("lo_fence", F.col("q1") - F.lit(k) * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi_fence", F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1")))
    j = long.join(broadcast_if_small(q), keys)  # q: one row per (by, column)
    inside = (F.col("value") >= F.col("lo_fence")) & (F.col("value") <= F.col("hi_fence"))
    agg = j.groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    return agg


def correlation(df: DataFrame, cols: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """A4: pairwise-complete Pearson matrix (long), one aggregate over one triangle."""
    cols = numeric_columns(df, cols)[:limit]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}")
                    for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("col_a"), F.lit(y).alias("col_b"), F.col(f"{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs) for x, y in dict.fromkeys([(a, b), (b, a)])])).alias("kv")).select("kv.*")


def target_conditioned_counts(df: DataFrame, target: str, cats: Sequence[str] | None = None,
                              limit: int | None = None) -> DataFrame:
    """A5: (column, value, target) counts for all categorical columns, or the first ``limit``."""
    cats = categorical_columns(df, cats, exclude=[target])[:limit]
    long = df.select(F.col(target).alias("target"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cats])).alias("kv"))
    return long.groupBy("kv.column", "kv.value", "target").agg(F.count(F.lit(1)).alias("n"))


def compare_distribution(before: DataFrame, after: DataFrame, col: str) -> DataFrame:
    """Per-stage counts of a column's values."""
    u = (before.select(F.lit("Baseline").alias("stage"), F.col(col))
         .unionByName(after.select(F.lit("Mitigated").alias("stage"), F.col(col))))
    return u.groupBy("stage", col).agg(F.count(F.lit(1)).alias("n"))


def compare_sensitive_target(before: DataFrame, after: DataFrame, sens: str, target: str) -> DataFrame:
    """Per-stage (sensitive, target) counts."""
    u = (before.select(F.lit("Baseline").alias("stage"), sens, target)
         .unionByName(after.select(F.lit("Mitigated").alias("stage"), sens, target)))
    return u.groupBy("stage", sens, target).agg(F.count(F.lit(1)).alias("n"))


def selection_rates(before: DataFrame, after: DataFrame, sens: str, target: str) -> DataFrame:
    """P(Y=1 | group) per stage (non-numeric targets -> NULL) plus the
    baseline global rate as group NULL / stage 'Global'."""
    def num(df):
        return F.col(target).cast("string").try_cast(T.DoubleType())
    u = (before.select(F.lit("Baseline").alias("stage"), F.col(sens).alias("group"), num(before).alias("_y"))
         .unionByName(after.select(F.lit("Mitigated").alias("stage"), F.col(sens).alias("group"),
                                   num(after).alias("_y"))))
    per = u.groupBy("stage", "group").agg(F.avg("_y").alias("selection_rate"))
    glob = before.agg(F.avg(num(before)).alias("selection_rate")).select(
        F.lit("Global").alias("stage"), F.lit(None).cast(before.schema[sens].dataType).alias("group"),
        "selection_rate")
    return per.unionByName(glob)


def crosstab(df: DataFrame, sens: str, target: str, values: Sequence | None = None) -> DataFrame:
    """Sensitive x target contingency table (pivot, missing cells 0)."""
    g = df.where(F.col(sens).isNotNull() & F.col(target).isNotNull()).groupBy(sens)
    p = g.pivot(target, list(values)) if values is not None else g.pivot(target)
    out = p.agg(F.count(F.lit(1)))
    return out.fillna(0)


def positive_rate(df: DataFrame, sens: str, target: str) -> DataFrame:
    """Mean target per group (numeric coercion)."""
    return (df.groupBy(sens)
              .agg(F.avg(F.col(target).cast("string").try_cast(T.DoubleType())).alias("positive_rate")))


def score_density(df: DataFrame, score: str, sens: str, grid: int = 200,
                  bins: int = 2048, exact: bool = False) -> DataFrame:
    """A10: Gaussian KDE of a [0,1] score per group, each group normalised on
    its own, Scott bandwidth n^(-1/5) * std, on ``grid`` points of [0, 1].

    Default: rows are first reduced to a per-group histogram of ``bins``
    bins (one aggregate), so the grid x bins evaluation never touches data
    rows. ``exact=True`` evaluates every distinct score of a group, with its
    count, at every grid point instead (summed map-side per (group, point))."""
    s = F.col(score).cast("double")
    base = df.where(s.isNotNull() & F.col(sens).isNotNull())
    stats = base.groupBy(F.col(sens).alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp(s).alias("sd"))
    if exact:
        hist = base.groupBy(F.col(sens).alias("group"), s.alias("center")).agg(F.count(F.lit(1)).alias("cnt"))
    else:
        hist = base.groupBy(F.col(sens).alias("group"),
                            F.least(F.floor(s * bins), F.lit(bins - 1)).alias("bin")) \
            .agg(F.count(F.lit(1)).alias("cnt"), F.avg(s).alias("center"))
    h = hist.join(broadcast_if_small(stats), "group")  # stats: one row per group
    pts = F.sequence(F.lit(0), F.lit(grid - 1))
    bw = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    e = h.select("group", "cnt", "center", "n", bw.alias("bw"), F.explode(pts).alias("i"))
    x = F.col("i").cast("double") / F.lit(grid - 1)
    z = (x - F.col("center")) / F.col("bw")
    k = F.col("cnt") * F.exp(F.lit(-0.5) * z * z) / (F.col("bw") * F.lit((2 * 3.141592653589793) ** 0.5))
    return (e.where(F.col("bw") > 0).groupBy("group", "i")
             .agg((F.sum(k) / F.first("n")).alias("density"))
             .select("group", (F.col("i").cast("double") / F.lit(grid - 1)).alias("x"), "density"))
