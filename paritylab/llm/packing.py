"""Token-id output: best-fit-decreasing packing into rows of fixed length.

Documents are tokenized, ended by a separator, and cut losslessly into full rows and a remainder.
Remainders are gathered into pools; a pool is sorted by falling length and each remainder goes to
the open row with the least room that still takes it. That row is found by descending a segment
tree over capacities (leaf c counts the open rows with room c).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritylab.llm.common import lean, slices, texts_of, worker_store

ROW = 2048
#: Tokens gathered before a pool is packed: bounds a task's memory, and the loss is below one row in 500.
POOL = 1 << 20
SCHEMA = ("pack_id bigint, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, "
          "doc_ids array<bigint>, doc_offsets array<bigint>")


class CapacityTree:
    """Open rows by room: which is the least room of at least ``need``?"""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) of the best fit."""
        i, count = need + self.size, self.count
        while not count[i]:  # up to the first subtree on the right that holds a row
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of the items of each row. Sizes are 1 to ``capacity``; ties keep the input's order."""
    tree, rows = CapacityTree(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        got = tree.take(sizes[i])
        if got is None:
            rows.append([i])
            room, row = capacity, len(rows) - 1
        else:
            room, row = got
            rows[row].append(i)
        if room > sizes[i]:
            tree.add(room - sizes[i], row)
    return rows


def position_ids(cu_seqlens: list[int], length: int) -> np.ndarray:
    """Positions that restart with each segment (and with the padding)."""
    at = np.arange(length)
    starts = np.asarray(cu_seqlens)
    return at - starts[np.searchsorted(starts, at, side="right") - 1]


def _ranks(path: str) -> dict[bytes, int]:
    import base64
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pack_documents(docs: DataFrame, rank_file: str, pattern: str, separator: int, row: int = ROW, pool: int = POOL,
                   text: str = "text") -> DataFrame:
    """Packed rows: ``input_ids`` (``row`` little-endian ids, 16 bits if the vocabulary allows, else 32,
    padded with the separator), ``cu_seqlens`` (0 to n_tokens), ``position_resets``, and per segment its
    document and its token offset there.

    Null texts are empty; every document has its separator, so none vanishes. Documents with null or equal
    doc_ids are packed like others. An empty table gives no rows. Narrow: every task packs what it reads,
    in pools of bounded size."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        store = worker_store("packing")
        if ("ranks", rank_file) not in store:
            store["ranks", rank_file] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(rank_file), special_tokens={})
        coder = store["ranks", rank_file]
        kind = "<u2" if max(coder.max_token_value, separator) < 1 << 16 else "<u4"
        task, made = TaskContext.get().partitionId() << 40, 0
        rest: list[tuple[int | None, int, np.ndarray]] = []
        held = 0

        def rows(groups):
            nonlocal made
            out = []
            for segs in groups:
                cu = [0, *np.cumsum([len(s[2]) for s in segs]).tolist()]
                ids = np.full(row, separator, kind)
                ids[:cu[-1]] = np.concatenate([s[2] for s in segs])
                out.append((task + made, cu[-1], ids.tobytes(), cu, cu[:-1] if cu[-1] == row else cu,
                            [s[0] for s in segs], [s[1] for s in segs]))
                made += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), KINDS)], names=NAMES)

        for b in slices(batches, text):
            full = []
            for doc, t in zip(b.column("doc_id").to_pylist(), texts_of(b, text)):
                ids = np.array([*coder.encode_ordinary(t), separator], kind)
                whole = len(ids) // row * row
                full.extend([(doc, lo, ids[lo:lo + row])] for lo in range(0, whole, row))
                if whole < len(ids):
                    rest.append((doc, whole, ids[whole:]))
                    held += len(ids) - whole
            if full:
                yield rows(full)
            if held >= pool:
                yield rows([[rest[i] for i in g] for g in best_fit_decreasing([len(s[2]) for s in rest], row)])
                rest, held = [], 0
        if rest:
            yield rows([[rest[i] for i in g] for g in best_fit_decreasing([len(s[2]) for s in rest], row)])

    return docs.selectExpr("cast(doc_id as bigint) AS doc_id", f"`{text}`").mapInArrow(lean(run), SCHEMA)


NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
KINDS = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed matrix as Parquet: a row is one fixed-length binary row of the matrix with its offsets."""
    packed.write.mode("errorifexists").parquet(path)


def unpack_documents(spark: SparkSession, path: str, id_bytes: int = 2) -> DataFrame:
    """doc_id and ids (binary, separator included) of every packed document, for unique doc_ids."""
    seg = F.expr("transform(sequence(1, size(doc_ids)), i -> struct(doc_ids[i - 1] AS doc_id, doc_offsets[i - 1] AS at, "
                 f"substring(input_ids, cu_seqlens[i - 1] * {id_bytes} + 1, (cu_seqlens[i] - cu_seqlens[i - 1]) * {id_bytes}) AS ids))")
    return (spark.read.parquet(path).select(F.explode(seg).alias("s")).groupBy("s.doc_id")
            .agg(F.expr("aggregate(array_sort(collect_list(struct(s.at AS at, s.ids AS ids))), cast('' AS binary), (a, x) -> concat(a, x.ids))").alias("ids")))
