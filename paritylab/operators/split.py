"""Reproducible stratified splits.

Row order inside a stratum is ``md5(seed|row_id)`` (stable under task retry
and repartitioning, and reproducible by the oracle). Per-stratum quotas follow
the largest-remainder allocation of a stratified shuffle split, computed in
exact integer arithmetic on the small stratum-count table; membership is then
``rank <= quota`` with the distributed rank of ``ranking.hash_rank``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritylab.functions.keys import key_string
from paritylab.operators.ranking import broadcast_if_small, bucket_bits, hash_dense_rank, hash_rank, range_rank
from paritylab.session import cut_lineage


def stratum_key(cols: Sequence[str]):
    if not cols:
        return F.lit("all")
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit("_"))
        parts.append(key_string(c))
    return F.concat(*parts)


def largest_remainder(counts: dict, n_draws: int) -> dict:
    """Allocate ``n_draws`` proportionally to ``counts``; leftover units go to
    the largest remainders (ties: smaller key first). Integer-exact."""
    total = sum(counts.values())
    if total == 0:
        return {k: 0 for k in counts}
    base = {k: (v * n_draws) // total for k, v in counts.items()}
    rem = {k: (v * n_draws) % total for k, v in counts.items()}
    left = n_draws - sum(base.values())
    for k in sorted(counts, key=lambda k: (-rem[k], k))[:left]:
        base[k] += 1
    return base


def allocate(counts: DataFrame, size: str, draws: int, out: str) -> DataFrame:
    """``largest_remainder`` on a table of strata: adds ``out``, the share of ``draws`` of each row (key ``_sk``, rows ``size``)."""
    total = counts.agg(F.coalesce(F.sum(size), F.lit(0)).alias("t")).first()["t"]
    if not total:
        return counts.withColumn(out, F.lit(0).cast("long"))
    product = f"cast({size} as decimal(19,0)) * cast({draws} as decimal(19,0))"
    base = counts.withColumns({"_base": F.expr(f"({product}) div cast({total} as decimal(19,0))"),
                               "_left": F.expr(f"({product}) % cast({total} as decimal(19,0))")})
    spare = draws - base.agg(F.sum("_base").alias("b")).first()["b"]
    ranked = range_rank(base, [], [F.col("_left").desc(), F.col("_sk")], "_place")
    return ranked.withColumn(out, F.col("_base") + (F.col("_place") <= F.lit(int(spare))).cast("long")).drop("_base", "_left", "_place")


def _strata(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict]:
    """(rows per stratum as a table, its number of strata, rows, smallest and largest stratum)."""
    counts = cut_lineage(df.groupBy(stratum_key(cols).alias("_sk")).agg(F.count(F.lit(1)).alias("_n")))
    return counts, _sizes(counts, "_n")


def _sizes(counts: DataFrame, size: str) -> dict:
    return counts.agg(F.count(F.lit(1)).alias("strata"), F.coalesce(F.sum(size), F.lit(0)).alias("rows"),
                      F.min(size).alias("least"), F.max(size).alias("most")).first().asDict()


def choose_strata(df: DataFrame, candidates: Sequence[Sequence[str]], test_size: float) -> tuple[list[str], DataFrame, dict]:
    """First candidate stratification that a stratified shuffle split accepts
    (every stratum >= 2 rows; both sides >= #strata); else no strata."""
    for cols in candidates:
        counts, sizes = _strata(df, cols)
        if _accepts(sizes, test_size):
            return list(cols), counts, sizes
    return [], *_strata(df, [])


def _accepts(sizes: dict, test_size: float) -> bool:
    n_test = math.ceil(test_size * sizes["rows"])
    return bool(sizes["strata"]) and sizes["least"] >= 2 and min(n_test, sizes["rows"] - n_test) >= sizes["strata"]


def stratified_split(df: DataFrame, strata: Sequence[str], test_size: float = 0.2, seed: int = 42,
                     key: str = "row_id", fallback: Sequence[Sequence[str]] | None = None,
                     out: str = "split", labels: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Adds ``out`` in {train, test}. ``fallback`` lists coarser
    stratifications tried when ``strata`` is rejected (then: unstratified)."""
    cols, counts, sizes = choose_strata(df, [list(strata), *[list(f) for f in (fallback or [])]], test_size)
    quotas = allocate(counts, "_n", sizes["rows"] - math.ceil(test_size * sizes["rows"]), "_q").select("_sk", "_q")
    keyed = df.withColumn("_sk", stratum_key(cols))
    # stratum sizes are known: just enough hash bits to cut the largest stratum
    # into segments of ~131k rows (a third of 100 TB -> 2**20+ segments)
    ranked = hash_rank(keyed, ["_sk"], seed, key, rank_col="_r", bits=bucket_bits(sizes["most"] or 0))
    res = ranked.join(broadcast_if_small(quotas), "_sk", "left")
    lab = F.when(F.col("_r") <= F.coalesce(F.col("_q"), F.lit(0)), F.lit(labels[0])).otherwise(F.lit(labels[1]))
    return res.withColumn(out, lab).drop("_sk", "_r", "_q", "_h")


def train_val_test(df: DataFrame, target: str, test_size: float = 0.2, val_size: float = 0.25,
                   seed: int = 42, key: str = "row_id") -> DataFrame:
    """test = test_size of all rows, then val = val_size of the rest,
    both stratified by the target (random fallback).

    One count pass and one distributed rank: both allocations are computed
    on the small stratum-count table (the second from the first's train
    quotas), then ``rank <= q_train`` is train, ``q_train < rank <= q_first``
    is validation and the rest is test. When the two splits would not use the
    same stratification, two chained splits are used instead."""
    cols, counts, sizes = choose_strata(df, [[target]], test_size)
    n1 = sizes["rows"] - math.ceil(test_size * sizes["rows"])
    first_q = allocate(counts, "_n", n1, "_q1")
    if cols and not _accepts(_sizes(first_q, "_q1"), val_size):
        first = stratified_split(df, [target], test_size, seed, key, fallback=[], out="_s1").persist()
        rest = first.where(F.col("_s1") == "train").drop("_s1")
        test = first.where(F.col("_s1") == "test").drop("_s1").withColumn("split", F.lit("test"))
        return stratified_split(rest, [target], val_size, f"{seed}v", key, fallback=[],
                                labels=("train", "val")).unionByName(test)
    quotas = allocate(first_q, "_q1", n1 - math.ceil(val_size * n1), "_q2").select("_sk", "_q1", "_q2")
    keyed = df.withColumn("_sk", stratum_key(cols))
    ranked = hash_rank(keyed, ["_sk"], seed, key, rank_col="_r", bits=bucket_bits(sizes["most"] or 0))
    res = ranked.join(broadcast_if_small(quotas), "_sk", "left")
    lab = (F.when(F.col("_r") <= F.col("_q2"), F.lit("train"))
            .when(F.col("_r") <= F.col("_q1"), F.lit("val")).otherwise(F.lit("test")))
    return res.withColumn("split", lab).drop("_sk", "_r", "_q1", "_q2", "_h")


def stratified_folds(df: DataFrame, strata: Sequence[str], k: int = 5, seed: int = 42,
                     key: str = "row_id", out: str = "fold", max_stratum_rows: int | None = None) -> DataFrame:
    """fold = (rank - 1) mod k inside each stratum, where the distinct keys are ranked: copies of a row (oversampling,
    counterfactuals) share a fold, and the fold sizes of a stratum differ by at most one key. ``max_stratum_rows`` (an upper
    bound, e.g. the row count) sizes the hash buckets; ranks are exact either way."""
    keyed = df.withColumn("_sk", stratum_key(list(strata)))
    bits = bucket_bits(max_stratum_rows) if max_stratum_rows is not None else None
    ranked = hash_dense_rank(keyed, ["_sk"], seed, key, rank_col="_r", **({"bits": bits} if bits is not None else {}))
    return ranked.withColumn(out, F.pmod(F.col("_r") - 1, F.lit(k)).cast("int")).drop("_sk", "_r", "_h")


def has_two_classes(df: DataFrame, target: str) -> bool:
    """Degenerate-run guard (reads at most two distinct labels)."""
    return df.where(F.col(target).isNotNull()).select(target).distinct().limit(2).count() == 2
