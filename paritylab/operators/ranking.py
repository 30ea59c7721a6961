"""Distributed ranking and running sums (K1).

``row_number() OVER (PARTITION BY stratum ORDER BY k)`` sends a whole stratum
to one task; with a stratum holding a third of the rows that task holds a
third of the data. Instead the order key is cut into order-preserving
buckets, rows are counted per (stratum, bucket) -- a small table -- whose
prefix sums give each bucket's starting offset; the exact rank is then the
offset plus a ``row_number`` inside the (stratum, bucket) segment, which is
only ~1/B of the stratum. The same two-level scheme gives global running sums
(ROC / PR curves) over a table ordered by score; there, and for ranks by value,
the buckets are range partitions of the whole order key, ties included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paritylab.functions.hashing import hash_bucket, hash_key
from paritylab.session import cut_lineage

# Bits of the 60-bit hash used as the bucket when stratum sizes are unknown:
# 2**16 segments per stratum.
HASH_BUCKET_BITS = 16
# Target rows per (stratum, bucket) window segment when stratum sizes are known.
SEGMENT_ROWS = 1 << 17


def bucket_bits(max_stratum_rows: int) -> int:
    """Fewest hash bits that keep the largest stratum's segments near
    ``SEGMENT_ROWS`` rows (0 for small strata, at most 24)."""
    bits = 0
    while bits < 24 and (max_stratum_rows >> bits) > SEGMENT_ROWS:
        bits += 1
    return bits


def _offsets(df: DataFrame, strata: Sequence[str], bucket: str) -> DataFrame:
    counts = df.groupBy(*strata, bucket).agg(F.count(F.lit(1)).alias("_bn"))
    w = (Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))).orderBy(bucket)
    return counts.select(*strata, bucket,
                         (F.sum("_bn").over(w.rowsBetween(Window.unboundedPreceding, -1))
                          ).alias("_off"),
                         F.sum("_bn").over(w.rowsBetween(Window.unboundedPreceding,
                                                         Window.unboundedFollowing)).alias("_stratum_n"))


def _join_offsets(big: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Equi-join of the rows with their (small) offset table.

    No broadcast hint: the offset table is at most (#strata x #buckets) rows;
    AQE measures it after its (cheap) aggregate and broadcasts it when it is
    below ``spark.sql.adaptive.autoBroadcastJoinThreshold``; otherwise the
    sort-merge join's shuffle on (strata, bucket) is exactly the partitioning
    the following window needs, so the data rows are shuffled once either way.
    """
    return big.join(small, list(keys), "inner")


def bucketed_rank(df: DataFrame, strata: Sequence[str], bucket: Column,
                  order: Sequence[Column], rank_col: str = "rank",
                  with_stratum_size: str | None = None) -> DataFrame:
    """Exact 1-based rank within ``strata`` by ``order``.

    ``bucket`` must be monotone non-decreasing in ``order`` (coarser order).
    """
    strata = list(strata)
    b = df.withColumn("_bkt", bucket)
    offs = _offsets(b, strata, "_bkt")
    offs = offs.fillna(0, subset=["_off"])
    joined = _join_offsets(b, offs, [*strata, "_bkt"])
    w = Window.partitionBy(*strata, "_bkt").orderBy(*order)
    out = joined.withColumn(rank_col, F.col("_off") + F.row_number().over(w))
    if with_stratum_size:
        out = out.withColumnRenamed("_stratum_n", with_stratum_size)
    return out.drop("_bkt", "_off", "_bn", "_stratum_n")


def hash_rank(df: DataFrame, strata: Sequence[str], seed, key: str = "row_id",
              rank_col: str = "rank", bits: int = HASH_BUCKET_BITS,
              with_stratum_size: str | None = None, hash_col: str = "_h") -> DataFrame:
    """Rank within strata in pseudo-random order ``md5(seed|key)`` (ties by key).

    The hash is uniform, so its top bits are a balanced, order-preserving
    bucket without any sampling pass.
    """
    h = df.withColumn(hash_col, hash_key(seed, key))
    out = bucketed_rank(h, strata, hash_bucket(F.col(hash_col), bits),
                        [F.col(hash_col), F.col(key)], rank_col, with_stratum_size)
    return out


def hash_dense_rank(df: DataFrame, strata: Sequence[str], seed, key: str = "row_id", rank_col: str = "rank",
                    bits: int = HASH_BUCKET_BITS) -> DataFrame:
    """As ``hash_rank``, but rows of one key share a rank and the next key has the next one. Rows of a key have one hash,
    so they stand in one bucket, and distinct hashes are counted per bucket."""
    strata = list(strata)
    b = df.withColumn("_h", hash_key(seed, key)).withColumn("_bkt", hash_bucket(F.col("_h"), bits))
    keys = b.select(*strata, "_bkt", "_h").distinct()
    offs = _offsets(keys, strata, "_bkt").fillna(0, subset=["_off"])
    w = Window.partitionBy(*strata, "_bkt").orderBy("_h")
    return _join_offsets(b, offs, [*strata, "_bkt"]).withColumn(rank_col, F.col("_off") + F.dense_rank().over(w)) \
        .drop("_bkt", "_off", "_bn", "_stratum_n")


def ordered_runs(df: DataFrame, by: Sequence[str], order: Sequence[Column], run: str) -> DataFrame:
    """Rows dealt into runs that follow ``(by, order)``, as many as the session has shuffle partitions.

    A run is a range partition of the whole key, so it is balanced whatever the size of a stratum and, when
    ``order`` ends in a unique key, whatever the ties. The runs are cut by a reliable checkpoint: the offsets
    counted per run and the rows ranked in it must come from the same division."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(parts, *[F.col(c) for c in by], *order).withColumn(run, F.spark_partition_id()))


def range_rank(df: DataFrame, strata: Sequence[str], order: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """Exact 1-based rank within ``strata`` by ``order`` (its last key unique)."""
    return bucketed_rank(ordered_runs(df, strata, order, "_run"), strata, F.col("_run"), order, rank_col).drop("_run")


def running_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str], by: Sequence[str] = (),
                 descending: bool = False, prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ``order_col`` order within ``by``.

    ``order_col`` must be unique within ``by`` (aggregate ties first). Ordered runs, run totals (one row per
    run and key) and a window inside each run."""
    by, cols = list(by), df.columns
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    d = ordered_runs(df, by, [order], "_run")
    totals = d.groupBy(*by, "_run").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    wt = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_run") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(*by, "_run", *[F.coalesce(F.sum(f"_t_{c}").over(wt), F.lit(0)).alias(f"_o_{c}") for c in sum_cols])
    w = Window.partitionBy(*by, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return _join_offsets(d, offs, [*by, "_run"]).select(
        *cols, *[(F.col(f"_o_{c}") + F.sum(c).over(w)).alias(f"{prefix}{c}") for c in sum_cols])


# Tables of per-group parameters (one row per group / audit key) joined back to
# data rows are broadcast when their checked size is at most this many rows and bytes.
MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 << 20


def broadcast_if_small(small: DataFrame, bound: int = MAX_BROADCAST_ROWS, most_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Broadcast a per-group parameter table after checking its size.

    Such tables are joined to data rows on a few distinct keys (a group, an
    audit key); a shuffle join would send every row of a hot group to one
    task, a broadcast join keeps the data rows where they are. The table is
    persisted (it is small) so the size check does not recompute it: rows, and bytes (16 a cell and the
    lengths of its texts). Above either bound it is left to the planner (AQE skew-join handling)."""
    small = small.persist()
    texts = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)) for c, kind in small.dtypes if kind in ("string", "binary")]
    row = small.agg(F.count(F.lit(1)).alias("n"), *[t.alias(f"b{i}") for i, t in enumerate(texts)]).first()
    size = 16 * row["n"] * len(small.columns) + sum(row[f"b{i}"] for i in range(len(texts)))
    return F.broadcast(small) if row["n"] <= bound and size <= most_bytes else small
