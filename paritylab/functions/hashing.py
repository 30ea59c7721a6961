"""Deterministic pseudo-random numbers from md5, identical in Spark and DuckDB.

``rand()`` depends on partitioning and is re-drawn on task retry; an md5 of
(seed, key) is stable under re-execution, repartitioning and executor loss,
and the oracle can reproduce it:
DuckDB ``CAST(('0x' || substr(md5(s), 1, 15)) AS BIGINT)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60  # 15 hex digits -> non-negative BIGINT


def _seed_string(seed, *cols) -> Column:
    parts = [F.lit(f"{seed}")]
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        parts += [F.lit("|"), F.coalesce(c.cast("string"), F.lit("nan"))]
    return F.concat(*parts)


def hash_key(seed, *cols) -> Column:
    """60-bit non-negative integer, uniform, from md5('seed|k1|k2...')."""
    # conv() of 15 hex digits is never NULL; the coalesce makes that visible to
    # the optimizer so joins on derived buckets add no IS NOT NULL re-evaluation
    h = F.conv(F.substring(F.md5(_seed_string(seed, *cols)), 1, 15), 16, 10).cast("bigint")
    return F.coalesce(h, F.lit(0).cast("bigint"))


def hash_unit(seed, *cols) -> Column:
    """Uniform double in [0, 1)."""
    return hash_key(seed, *cols).cast("double") / F.lit(float(2 ** HASH_BITS))


def hash_bucket(h: Column, bits: int) -> Column:
    """Order-preserving bucket of a 60-bit hash: its top ``bits`` bits."""
    if bits <= 0:
        return F.lit(0).cast("bigint")
    return F.shiftright(h, HASH_BITS - bits)
