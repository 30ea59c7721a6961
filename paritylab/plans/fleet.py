"""Many models fitted together on one table.

A cell is a training table (of a grid, or the only one); its models are the one on all rows and one for each
cross-validation fold left out. The rows of all cells stand in one checkpointed table; an iteration is one pass in
which every task adds up what all models that are still open need from its rows (gradients, Hessians, histograms). The
sums of one key meet in one task; for many partitions they meet in two steps, and where every cell stands whole in one partition they
need not be shuffled at all. Trees of models of two million rows at most grow in one task a model, without passes. Only sums of bounded size, or the splits
found from them, reach the driver: nothing there grows with the rows. The rows stand in blocks of an Arrow batch at most, packed column by column.

Rows are dealt into folds by the distinct keys, so copies of a row share a fold. Without a key, or with a null one, the row's content
is its key. Rows without a label are left out. Features are z-scored per cell (a constant one is 0) and rows brought to length 1.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritylab.functions.hashing import hash_key
from paritylab.operators.ranking import bucket_bits, hash_dense_rank
from paritylab.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Folds of the calibration inside a training table.
INNER = 5
#: Rows that a task adds up at least, partitions above which sums meet in two steps, and the slices of a cell up to which one
#: task may hold a model's binned rows (two million rows at most).
TASK_ROWS, TWO_STEPS, UNIT_SLICES = 200_000, 64, 10
#: The columns of blocks: rows of one cell, packed column by column (features and bins feature by feature, scores model by model).
BLOCK_FORMS = {"y": np.float64, "x": np.float64, "bins": np.uint8, "fold": np.int32, "inner": np.int32, "tie": np.int64, "out": np.bool_, "f": np.float64}
MATRICES = ("x", "bins", "f")


@dataclass
class Cell:
    """A training table: its features with their mean and spread, and its rows by (fold, inner fold, label)."""

    features: list[str]
    mean: np.ndarray
    spread: np.ndarray
    counts: dict = field(default_factory=dict)

    def rows(self, label: float | None = None, keep: Callable = lambda fold, inner: True) -> int:
        return sum(n for (f, i, y), n in self.counts.items() if keep(f, i) and (label is None or y == label))


@dataclass
class Fleet:
    blocks: DataFrame
    cells: dict[int, Cell]
    folds: int
    parts: int
    whole: bool  # whether every cell's rows stand in one partition
    units: bool = False  # whether a task may hold the binned rows of any one model

    def models(self, cell: int) -> list[int]:
        """The folds that can be left out, then ``folds`` for the model on all rows. Either all folds or none: a fold that is empty
        or leaves a single class rules out cross-validation."""
        c = self.cells[cell]
        good = all(c.rows(keep=lambda f, i: f == m) and all(c.rows(y, lambda f, i: f != m) for y in (0.0, 1.0)) for m in range(self.folds))
        return [*(range(self.folds) if good else []), self.folds]

    @property
    def rows(self) -> DataFrame:
        """The rows one by one, x packed."""
        def run(batches) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for cell, c in columns_of(b):
                    x = pa.array([row.tobytes() for row in np.ascontiguousarray(c["x"])], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), cell, np.int32)), pa.array(c["y"]), x, *[pa.array(c[k]) for k in ("fold", "inner", "tie")]],
                                                     names=["cell", "y", "x", "fold", "inner", "tie"])

        return self.blocks.mapInArrow(run, "cell int, y double, x binary, fold int, inner int, tie bigint")

    def release(self) -> None:
        self.blocks.unpersist()


def _training_rows(cell: int, df: DataFrame, features: Sequence[str], target: str, key: str) -> DataFrame:
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in features]).cast("array<double>")
    y = F.col(target).cast("double")
    content = F.concat(F.lit("row-"), F.xxhash64(x, y).cast("string"))
    own = F.coalesce(F.col(key).cast("string"), content) if key in df.columns else content
    return df.where(F.col(target).isNotNull()).select(F.lit(cell).alias("cell"), y.alias("y"), x.alias("x"), own.alias("key"))


def build(tables: Sequence[tuple[int, DataFrame, Sequence[str]]], target: str, key: str = "row_id", seed: int = 42, folds: int = 5,
          task_rows: int = TASK_ROWS) -> Fleet:
    """The fleet of training tables (number, rows, features). Labels are 0 and 1."""
    every = reduce(DataFrame.unionByName, [_training_rows(i, df, fs, target, key) for i, df, fs in tables])
    every = cut_lineage(every)
    sizes = {r["cell"]: r["n"] for r in every.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.col("_place") - 1
    ranked = hash_dense_rank(every, ["cell", "y"], seed, "key", "_place", bucket_bits(max(sizes.values(), default=0)))
    fold = F.pmod(place, F.lit(folds)) if folds else F.lit(-1)
    dealt = cut_lineage(ranked.select("cell", "y", "x", fold.cast("int").alias("fold"), F.pmod(F.floor(place / max(folds, 1)), F.lit(INNER)).cast("int").alias("inner"),
                                      hash_key(f"{seed}|row", "key").alias("tie")))
    stats: dict = {}
    for r in dealt.select("cell", F.posexplode("x").alias("i", "v")).groupBy("cell", "i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect():
        stats[r["cell"], r["i"]] = (r["m"] or 0.0, r["s"] or 0.0)
    cells = {i: Cell(list(fs), *(np.array([stats.get((i, j), (0.0, 0.0))[k] for j in range(len(fs))]) for k in (0, 1))) for i, _, fs in tables}
    for r in dealt.groupBy("cell", "fold", "inner", "y").agg(F.count(F.lit(1)).alias("n")).collect():
        cells[r["cell"]].counts[r["fold"], r["inner"], r["y"]] = r["n"]
    slices = {i: max(1, -(-sizes.get(i, 0) // task_rows)) for i in cells}
    placed, parts = deal(dealt, slices)
    return Fleet(_blocked(placed, {i: (c.mean, c.spread) for i, c in cells.items()}).persist(), cells, folds, parts, max(slices.values()) == 1,
                 max(slices.values()) <= UNIT_SLICES)


def deal(rows: DataFrame, slices: dict[int, int]) -> tuple[DataFrame, int]:
    """(``rows`` with each cell in so many partitions, the number of partitions): slices in turn, by the row's tie."""
    total = sum(slices.values())
    parts = min(total, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total - len(slices)))
    first = dict(zip(slices, np.cumsum([0, *slices.values()]).tolist()))
    count, start = (F.create_map(*[F.lit(v) for kv in d.items() for v in kv]) for d in (slices, first))
    slot = start[F.col("cell")] + F.pmod(F.col("tie"), count[F.col("cell")])
    return rows.repartitionById(parts, F.pmod(slot, F.lit(parts)).cast("int")).sortWithinPartitions("cell"), parts


def scaled(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """z-scores (0 for a constant feature), rows brought to length 1."""
    z = np.where(spread > 0, (x - mean) / np.where(spread > 0, spread, 1.0), 0.0)
    size = np.sqrt((z * z).sum(1, keepdims=True))
    return z / np.where(size > 0, size, 1.0)


def block(cell: int, n: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row with the packed columns of ``n`` rows."""
    data = [pa.array([np.ascontiguousarray(v.T if v.ndim == 2 else v).tobytes()], pa.binary()) for v in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([n], pa.int32()), *data], names=["cell", "n", *columns])


def _blocked(placed: DataFrame, scales: dict) -> DataFrame:
    """The rows, where they stand, with scaled features, as blocks: a run of one cell in an Arrow batch each."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column("cell").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(cells, prepend=cells[:1] - 1, append=cells[-1:] + 1)) if len(cells) else []
            for lo, hi in zip(edges[:-1], edges[1:]):
                cell, part = int(cells[lo]), b.slice(lo, hi - lo)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(hi - lo, -1)
                own = {c: part.column(c).to_numpy(zero_copy_only=False).astype(BLOCK_FORMS[c]) for c in ("y", "fold", "inner", "tie")}
                yield block(cell, hi - lo, {"y": own.pop("y"), "x": scaled(x, *scales[cell]), **own})

    return placed.mapInArrow(run, "cell int, n int, y binary, x binary, fold binary, inner binary, tie binary")


def columns_of(batch: pa.RecordBatch) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(cell, arrays of its rows) for each block."""
    sizes, names = batch.column("n").to_pylist(), [c for c in batch.schema.names if c not in ("cell", "n")]
    for i, (cell, n) in enumerate(zip(batch.column("cell").to_pylist(), sizes)):
        out = {c: np.frombuffer(batch.column(c)[i].as_buffer(), BLOCK_FORMS[c]) for c in names}
        yield cell, {c: v.reshape(-1, n).T if c in MATRICES else v for c, v in out.items()}


def joined(some: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The columns of several blocks as one."""
    return {c: np.concatenate([x[c].T for x in some], 1).T if c in MATRICES else np.concatenate([x[c] for x in some]) for c in some[0]}


def taken(columns: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {c: np.take(v.T, rows, 1).T if c in MATRICES else v[rows] for c, v in columns.items()}


def add(sums: dict[int, np.ndarray], key: int, values: np.ndarray) -> None:
    if key in sums:
        sums[key] += values
    else:
        sums[key] = values.astype(np.float64)


def summed(fleet: Fleet, names: Sequence[str], local: Callable, finish: Callable | None = None, rows: DataFrame | None = None,
           together: bool = False) -> dict[int, np.ndarray]:
    """One pass over the fleet's blocks (or ``rows``, which stand alike): ``local(sums, cell, columns)`` adds arrays under keys that are
    those of one cell, the arrays of a key are added, and ``finish(key, array)`` of each comes back. ``together``: a task's rows of a cell
    (TASK_ROWS or so) come as one."""
    rows, parts = rows if rows is not None else fleet.blocks, fleet.parts

    fleet_whole = fleet.whole  # not the fleet itself, which does not travel

    def collect(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        found: Iterable = (block for b in batches for block in columns_of(b))
        if together:
            found = ((cell, joined([c for _, c in some])) for cell, some in groupby(found, lambda block: block[0]))
        for cell, columns in found:
            local(sums, cell, columns)
        if fleet_whole and finish is not None:
            sums = {k: finish(k, v) for k, v in sums.items()}
        yield from packed(sums)

    def merge(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for key, data in zip(b.column("key").to_pylist(), b.column("data")):
                add(sums, key, np.frombuffer(data.as_buffer(), np.float64))
        yield from packed(sums)

    def close(batches) -> Iterator[pa.RecordBatch]:
        for b in merge(batches):
            done = {k: finish(k, np.frombuffer(v.as_buffer(), np.float64)) for k, v in zip(b.column("key").to_pylist(), b.column("data"))}
            yield from packed(done)

    out = rows.select("cell", "n", *names).mapInArrow(collect, "key bigint, data binary")
    if not fleet_whole:
        if parts > TWO_STEPS:
            step = int(parts ** 0.5)
            out = out.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(step))).repartition(step, "key", "_salt").drop("_salt").mapInArrow(merge, "key bigint, data binary")
        out = out.repartition("key").mapInArrow(close if finish is not None else merge, "key bigint, data binary")
    return {r["key"]: np.frombuffer(r["data"], np.float64) for r in out.collect()}


def packed(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, v in sums.items():  # one row a batch: arrays may be large
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.ascontiguousarray(v, np.float64).tobytes()], pa.binary())], names=["key", "data"])


def fold_accuracy(fleet: Fleet, names: Sequence[str], predict: Callable) -> dict[int, tuple[float, float]]:
    """Mean and population spread of the accuracy on the folds left out; (0, 0) for a cell without cross-validation.

    ``predict(cell, columns, fold)`` gives the classes of the fold's rows by the model that leaves it out."""
    use = {c for c in fleet.cells if len(fleet.models(c)) > 1}
    folds = fleet.folds

    def local(sums, cell, c):
        if cell in use:
            own = [np.flatnonzero(c["fold"] == m) for m in range(folds)]
            right = [(predict(cell, some := taken(c, at), m) == some["y"]).sum() if len(at) else 0 for m, at in enumerate(own)]
            add(sums, cell, np.array([*right, *map(len, own)]))

    got = summed(fleet, [*dict.fromkeys(["y", "fold", *names])], local, together=True) if use else {}
    out = {c: (0.0, 0.0) for c in fleet.cells}
    for cell, data in got.items():
        share = data[:folds] / data[folds:]
        out[cell] = (float(share.mean()), float(share.std()))
    return out

