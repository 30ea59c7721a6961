"""Helpers shared by the operators: table access, bounded Arrow slices, rolling hashes."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_MIN = -(1 << 63)
#: Multiplier of the polynomial hash (odd, so it has an inverse modulo 2**64) and mixing constants.
BASE = 0x9E3779B97F4A7C15
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def order_key(col: str = "doc_id") -> Column:
    """A never-null long that orders like ``col``; null sorts first."""
    return F.coalesce(F.col(col).cast("long"), F.lit(LONG_MIN))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder that the session names."""
    from paritylab.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lean(run):
    """Wrap a task's generator so that the worker gives freed memory back when the task ends: idle workers
    share the executor's memory with those of the next stage."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return wrapped


def add_columns(docs: DataFrame, text: str, fields: list[T.StructField], make, limit: int = 4 << 20) -> DataFrame:
    """``docs`` with ``fields``, whose arrays ``make`` computes from a slice of texts; columns of their names are
    replaced. Columns travel under positional names, so any name will do. A narrow pass."""
    new = {f.name.lower() for f in fields}
    names = [c for c in docs.columns if c.lower() not in new]
    base = docs.select(*[F.col(f"`{c}`").alias("text" if c == text else f"c{i}") for i, c in enumerate(names)])
    schema = T.StructType([*base.schema.fields, *(T.StructField(f"n{i}", f.dataType) for i, f in enumerate(fields))])

    def run(batches):
        for b in slices(batches, "text", limit):
            yield pa.RecordBatch.from_arrays([*b.columns, *make(texts_of(b))], names=schema.names)

    done = base.mapInArrow(lean(run), schema)
    return done.select(*[F.col(a).alias(n) for a, n in zip(base.columns, names)], *[F.col(f"n{i}").alias(f.name) for i, f in enumerate(fields)])


def share(spark: SparkSession, made):
    """A broadcast of an object of this subpackage, pickled by value like its functions; call the result for the object."""
    from pyspark import cloudpickle

    sent, opened = spark.sparkContext.broadcast(cloudpickle.dumps(made)), []

    def get():
        if not opened:
            import pickle
            opened.append(pickle.loads(sent.value))
        return opened[0]

    return get


def worker_store(owner: str) -> dict:
    """What a Python worker keeps from task to task for an operator (a loaded vocabulary, memos). Another
    operator's is dropped first, so that a worker holds one at a time."""
    store = sys.__dict__.setdefault("_paritylab_llm_store", {})
    for other in [k for k in store if k != owner]:
        del store[other]
    return store.setdefault(owner, {})


def slices(batches, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``limit`` bytes in each (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        lo = 0
        while lo < batch.num_rows:
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word (a bijection of 64-bit words)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX_A)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_B)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i < n, kept by the worker up to the longest yet."""
    kept = sys.__dict__.setdefault("_paritylab_llm_powers", {})
    have = kept.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(BASE, -1, 1 << 64)
        up, down = np.full(size, BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 1 << 21:
            kept["powers"] = have
    return have[0][:n], have[1][:n]


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums P of symbol * BASE**i; see ``range_hash``."""
    n = len(symbols)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(symbols * powers(n)[0], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end], equal for equal symbol runs wherever they stand."""
    down = powers(len(prefix))[1]
    return mix64((prefix[end] - prefix[start]) * down[start])


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of all k-grams, by prefix difference; 63 bits, so that 2**64-1 is free as a sentinel."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = prefix_hash(symbols)
    h = p[k:] - p[:n]
    h *= powers(len(p))[1][:n]
    return mix64(h) >> np.uint64(1)


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the minimum of every window of ``w`` values, the rightmost on ties.

    Windows are doubled: a window of 2s values takes the better of two of s values."""
    v, p, s = values, np.arange(len(values), dtype=np.int32), 1
    while s < w and len(v) > 0:
        step = min(s, w - s)
        a, b = v[:-step], v[step:]
        right = b <= a
        v = np.where(right, b, a)
        p = np.where(right, p[step:], p[:-step])
        s += step
    return p


def spread_symbols(values: np.ndarray) -> np.ndarray:
    """Small integers as well-spread 64-bit symbols."""
    return mix64(values.astype(np.uint64) + np.uint64(1))


SENTINEL = np.uint64(0xFFFFFFFFFFFFFFFF)
