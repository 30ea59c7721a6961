"""Alignment of two tokenizers over the same bytes.

A byte-level BPE (A) reads a space and the text, a sentencepiece BPE (B) the text, to which it adds the space itself. Both
give token ends, byte offsets. Of the two lists of ends the shorter drives: each of its ends gallops into the longer one
(steps 1, 2, 4 ... until it is passed, then binary search between the last two). Ends that both have cut the tokens into
groups; the difference of the ranks of a token's two ends is the range of tokens that it overlaps.

Neither vocabulary joins across a single space between two characters that are no white space: A's pre-tokenizer starts anew there
and B has no piece with a space behind another character (checked). Texts are cut there, and a task aligns each distinct unit once.

Counts of linked id pairs need the whole corpus, and a pair may stand in every document. So a task sums them up for
each block of its rows before they are shuffled: a pair has one row a block. Each block then gets back the
counts of its own pairs, and its documents, kept as unit numbers, sum them. The highest count of each B id is one number
an entry of the vocabulary, which bounds the only broadcast.

Null, empty and unalignable texts (whose token bytes differ from space and text, as where U+2581 stands in it) have no tokens.
Equal rows give equal rows; an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritylab.llm.common import cut_lineage, lean, partitions, sha256_hex, slices, texts_of, worker_store

SPACE = "▁"
UNITS = re.compile(r"(?<=\S) (?=\S)")
#: A block ends when its distinct units reach one of these bounds (units, links and bytes of their group strings).
BLOCK_UNITS, BLOCK_LINKS, BLOCK_BYTES = 400_000, 4_000_000, 48 << 20
#: Kinds of rows, in the order in which a block is read.
PAIRS, LINKS, DOC = 0, 1, 2
ROW = ("place int, block int, kind int, pair struct<i: int, a: int, b: int, n: bigint>, links binary, doc_id bigint, n_a bigint, n_b bigint, "
       "n_groups bigint, n_links bigint, groups string, groups_sha256 string, units binary")
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def byte_of_symbol() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, the others, in order, from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """A: a byte-level tokenizer file. Special tokens inside texts are plain text."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(tokenizer_file)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.lib.encode_special_tokens = True
        symbols = byte_of_symbol()
        self.bytes = [b""] * (max(self.lib.get_vocab().values()) + 1)
        for token, i in self.lib.get_vocab().items():
            self.bytes[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.lib.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]


class Pieces:
    """B: a sentencepiece model with byte fallback, which adds a space before the text."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bytes = []
        for i in range(self.lib.get_piece_size()):
            piece = self.lib.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.lib.is_byte(i) else piece.replace(SPACE, " ").encode())
            if not (self.lib.is_byte(i) or self.lib.is_control(i)) and re.search(f"[^{SPACE}]{SPACE}", piece):
                raise ValueError(f"the vocabulary has a piece that runs across a space: {piece!r}")

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.lib.encode(units, num_threads=1)


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 ... (size[0] of them), then start[1] ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def gallop(needles: np.ndarray, lo: np.ndarray, ends: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rank of each needle: the first place in ends[lo:hi], which ascends, that is not below it; it is known to be below hi."""
    step = np.ones(len(needles), np.int64)
    at, todo = lo.copy(), np.arange(len(needles))
    while len(todo):  # at is a place whose predecessors are below the needle
        probe = at[todo] + step[todo] - 1
        over = np.minimum(probe, hi[todo] - 1)
        below = ends[over] < needles[todo]
        todo, over = todo[below], over[below]
        at[todo] = over + 1
        step[todo] *= 2
    last = np.minimum(at + step - 1, hi - 1)
    first = at
    while True:
        open_ = np.flatnonzero(first < last)
        if not len(open_):
            return first
        mid = (first[open_] + last[open_]) // 2
        below = ends[mid] < needles[open_]
        first[open_] = np.where(below, mid + 1, first[open_])
        last[open_] = np.where(below, last[open_], mid)


def flat(ids: list[list[int]], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, tokens of each unit, byte length of each token)"""
    count = np.fromiter(map(len, ids), np.int64, len(ids))
    out = np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum()))
    return out, count, sizes[out]


def overlaps(a_count: np.ndarray, a_ends: np.ndarray, b_count: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of units whose tokens cover the same bytes: (unit, A token, B token) of every overlapping pair, by unit, A and B.

    Ends are byte offsets in all units laid end to end. In each unit the side with fewer tokens gallops into the other."""
    a_from, b_from = np.cumsum(a_count) - a_count, np.cumsum(b_count) - b_count
    found = []
    for drive_a in (True, False):
        mine = np.flatnonzero((a_count <= b_count) if drive_a else (a_count > b_count))
        s_from, s_count, s_ends, l_from, l_count, l_ends = ((a_from, a_count, a_ends, b_from, b_count, b_ends) if drive_a
                                                            else (b_from, b_count, b_ends, a_from, a_count, a_ends))
        if not len(mine):
            continue
        s, unit = ragged(s_from[mine], s_count[mine]), np.repeat(mine, s_count[mine])
        last = gallop(s_ends[s], l_from[unit], l_ends, l_from[unit] + l_count[unit])
        shared = l_ends[last] == s_ends[s]
        first = np.empty_like(last)  # the token in which this one begins: behind a shared end, or where the one before ended
        first[1:] = last[:-1] + shared[:-1]
        opens = s == s_from[unit]
        first[opens] = l_from[unit[opens]]
        n = last - first + 1
        short, long = np.repeat(s, n), ragged(first, n)
        found.append((np.repeat(unit, n), *((short, long) if drive_a else (long, short))))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    unit, a, b = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((b, a))
    return unit[order], a[order], b[order]


class Aligner:
    """Distinct units of a block with their tokens, groups and links."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        if len(b.bytes) > 1 << 20:
            raise ValueError("a vocabulary of over 2**20 pieces")
        self.a_size, self.b_size = (np.array([len(x) for x in side.bytes], np.int64) for side in (a, b))
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.groups: list[str] = []
        self.stats: list[np.ndarray] = []  # n_a, n_b, n_groups, n_links, whether it aligns
        self.links: list[tuple[np.ndarray, np.ndarray]] = []  # (unit, pair number) of every link
        self.pair: dict[int, int] = {}
        self.n_links = self.n_bytes = 0

    def full(self) -> bool:
        return len(self.row) >= BLOCK_UNITS or self.n_links >= BLOCK_LINKS or self.n_bytes >= BLOCK_BYTES

    def learn(self, texts: list[list[str]]) -> None:
        fresh = list({u for own in texts for u in own}.difference(self.row))
        for lo in range(0, len(fresh), 8192):
            self._learn(fresh[lo:lo + 8192])

    def _learn(self, units: list[str]) -> None:
        a_ids, b_ids = self.a.encode(units), self.b.encode(units)
        fits = np.array([b"".join(map(self.a.bytes.__getitem__, x)) == (want := b" " + u.encode("utf-8", "surrogatepass")) == b"".join(map(self.b.bytes.__getitem__, y))
                         for u, x, y in zip(units, a_ids, b_ids)])
        a_ids, b_ids = ([x if f else [] for x, f in zip(ids, fits)] for ids in (a_ids, b_ids))
        a, a_count, a_len = flat(a_ids, self.a_size)
        b, b_count, b_len = flat(b_ids, self.b_size)
        a_ends, b_ends = np.cumsum(a_len), np.cumsum(b_len)
        unit, at, bt = overlaps(a_count, a_ends, b_count, b_ends)
        base = len(self.row)
        # A group ends where both have an end: the last link of an A token that ends with its B token.
        closes = a_ends[at] == b_ends[bt]
        groups = np.bincount(unit[closes], minlength=len(units))
        self.stats.append(np.stack([a_count, b_count, groups, np.bincount(unit, minlength=len(units)), fits.astype(np.int64)], 1))
        self._write_groups(units, a_ids, b_ids, unit[closes], at[closes] + 1, bt[closes] + 1, a_count, b_count)
        keys, inverse = np.unique(a[at] << 20 | b[bt], return_inverse=True)
        number = np.array([self.pair.setdefault(k, len(self.pair)) for k in keys.tolist()], np.int64)
        self.links.append((unit + base, number[inverse] if len(number) else number))
        self.n_links += len(unit)
        for u in units:
            self.row[u] = len(self.row)

    def _write_groups(self, units, a_ids, b_ids, unit, a_end, b_end, a_count, b_count) -> None:
        a_end, b_end = (a_end - (np.cumsum(a_count) - a_count)[unit]).tolist(), (b_end - (np.cumsum(b_count) - b_count)[unit]).tolist()
        cut = np.searchsorted(unit, np.arange(len(units) + 1)).tolist()
        for i, (x, y) in enumerate(zip(a_ids, b_ids)):
            out, la, lb = [], 0, 0
            for ha, hb in zip(a_end[cut[i]:cut[i + 1]], b_end[cut[i]:cut[i + 1]]):
                out.append(",".join(map(str, x[la:ha])) + "|" + ",".join(map(str, y[lb:hb])))
                la, lb = ha, hb
            self.groups.append(";".join(out))
            self.n_bytes += len(self.groups[-1])


def rows_of(kind: int, n: int, place: int, block: int, schema: pa.Schema, **columns) -> pa.RecordBatch:
    """``n`` rows of one kind; columns that are not given are null."""
    columns |= {"place": np.full(n, place), "block": np.full(n, block), "kind": np.full(n, kind)}
    made = [pa.nulls(n, f.type) if f.name not in columns else columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type)
            for f in schema]
    return pa.RecordBatch.from_arrays(made, schema=schema)


def aligned_blocks(docs: DataFrame, tokenizer_file: str, model_file: str, text: str, with_groups: bool) -> DataFrame:
    """A row of each document (DOC), of each block's links (LINKS: unit and pair number, packed) and of each pair of
    a block with its count there (PAIRS). A narrow pass; memory is bounded by a block and an Arrow slice."""
    fields = [("place", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()),
              ("pair", pa.struct([("i", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])), ("links", pa.binary()),
              *((c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("groups_sha256", pa.string()), ("units", pa.binary())]

    def run(batches) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        store = worker_store("alignment")
        if (tokenizer_file, model_file) not in store:
            store[tokenizer_file, model_file] = (ByteLevel(tokenizer_file), Pieces(model_file))
        made, place, schema = Aligner(*store[tokenizer_file, model_file]), TaskContext.get().partitionId(), pa.schema(fields)
        block, used = 0, np.zeros(0, np.int64)

        def close() -> Iterator[pa.RecordBatch]:
            if not len(used):
                return
            unit, number = (np.concatenate(x) for x in zip(*made.links))
            order = np.argsort(unit, kind="stable")
            packed = np.stack([unit[order], number[order]]).astype("<i4").tobytes()
            yield rows_of(LINKS, 1, place, block, schema, links=[packed])
            n = np.bincount(number, weights=used[unit], minlength=len(made.pair)).astype(np.int64)
            keys = np.fromiter(made.pair, np.int64, len(made.pair))
            for lo in range(0, len(keys), 1 << 16):
                k = keys[lo:lo + (1 << 16)]
                pair = pa.StructArray.from_arrays([pa.array(np.arange(lo, lo + len(k)), pa.int32()), pa.array(k >> 20, pa.int32()),
                                                   pa.array(k & 0xFFFFF, pa.int32()), pa.array(n[lo:lo + len(k)])], ["i", "a", "b", "n"])
                yield rows_of(PAIRS, len(k), place, block, schema, pair=pair)

        for b in slices(batches, "text", 1 << 20):
            texts = texts_of(b)
            cut = [UNITS.split(t) if t else [] for t in texts]
            made.learn(cut)
            stats, seen = np.concatenate(made.stats) if made.stats else np.zeros((0, 5), np.int64), made.row
            made.stats = [stats]
            units = [np.fromiter(map(seen.__getitem__, own), np.int64, len(own)) for own in cut]
            fits = [bool(stats[u, 4].all()) for u in units]
            units = [u if f else u[:0] for u, f in zip(units, fits)]
            size = np.array([len(u) for u in units])
            every = np.concatenate(units)
            if len(used) < len(stats):
                used = np.concatenate([used, np.zeros(len(stats) - len(used), np.int64)])
            used += np.bincount(every, minlength=len(used))
            sums = np.zeros((len(every) + 1, 4), np.int64)
            np.cumsum(stats[every, :4], axis=0, out=sums[1:])
            ends = np.cumsum(size)
            sums = sums[ends] - sums[ends - size]
            groups = [";".join(map(made.groups.__getitem__, u.tolist())) for u in units]
            yield rows_of(DOC, b.num_rows, place, block, schema, doc_id=b.column("doc_id"), n_a=sums[:, 0], n_b=sums[:, 1], n_groups=sums[:, 2],
                          n_links=sums[:, 3], groups_sha256=[sha256_hex(g.encode()) if g else "" for g in groups],
                          units=[u.astype("<i4").tobytes() for u in units], **({"groups": groups} if with_groups else {}))
            if made.full():
                yield from close()
                made.clear()
                block, used = block + 1, np.zeros(0, np.int64)
        yield from close()

    ids = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    return docs.select(ids.alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(lean(run), ROW)


def align(docs: DataFrame, tokenizer_file: str, model_file: str, text: str = "text", with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document (and groups, on request).

    ``groups`` lists ids as ``a1,a2|b1;a3|b2,b3``. ``count_sum`` adds up, over a document's links, how many links of the whole table
    hold the same two ids; a link is among ``n_best`` if no other A id is linked to its B id more often."""
    parts = partitions(docs.sparkSession)
    rows = cut_lineage(aligned_blocks(docs, tokenizer_file, model_file, text, with_groups))
    pairs = rows.where(F.col("kind") == PAIRS).select("place", "block", "pair.*")
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    top = counts.groupBy("b").agg(F.max("count").alias("top"))  # one row an entry of B's vocabulary at most
    known = counts.join(F.broadcast(top), "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))
    back = pairs.join(known, ["a", "b"]).select("place", "block", F.lit(PAIRS).alias("kind"), "i", "count", "best")
    kept = ["links", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "units"]
    both = back.unionByName(rows.where(F.col("kind") > PAIRS).select("place", "block", "kind", *kept), allowMissingColumns=True)
    schema = RESULT + ", groups string" * with_groups
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches) -> Iterator[pa.RecordBatch]:
        worker_store("alignment-sums")
        now, got, count, best = None, [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            keys = [b.column(c).to_numpy(zero_copy_only=False) for c in ("place", "block", "kind")]
            new = np.ones(b.num_rows, bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            edges = np.append(np.flatnonzero(new), b.num_rows)
            for lo, hi in zip(edges[:-1], edges[1:]):
                some, (place, block, kind) = b.slice(lo, hi - lo), (int(k[lo]) for k in keys)
                if now != (place, block):
                    now, got = (place, block), []
                if kind == PAIRS:
                    got.append([some.column(c).to_numpy(zero_copy_only=False) for c in ("i", "count", "best")])
                elif kind == LINKS:  # all pairs of the block have been read: sums of each unit
                    unit, number = np.frombuffer(some.column("links")[0].as_py(), "<i4").reshape(2, -1)
                    value = np.zeros((int(number.max(initial=-1)) + 1, 2), np.int64)
                    for i, n, top_ in got:
                        value[i, 0], value[i, 1] = n, top_
                    n_units = int(unit.max(initial=-1)) + 1
                    edge = np.searchsorted(unit, np.arange(n_units + 1))
                    total = np.zeros((len(number) + 1, 2), np.int64)
                    np.cumsum(value[number], axis=0, out=total[1:])
                    count, best = (total[edge[1:], c] - total[edge[:-1], c] for c in (0, 1))
                    got = []
                else:
                    units = [np.frombuffer(u, "<i4") for u in some.column("units").to_pylist()]
                    # Units of a document all align; a unit number beyond the table has no links.
                    sums = [(int(best[u].sum()), int(count[u].sum())) for u in units]
                    extra = {"n_best": pa.array([s[0] for s in sums], pa.int64()), "count_sum": pa.array([s[1] for s in sums], pa.int64())}
                    yield pa.RecordBatch.from_arrays([extra[c] if c in extra else some.column(c) for c in names], names=names)

    dealt = both.repartitionById(parts, F.pmod(F.col("place"), F.lit(parts)).cast("int")).sortWithinPartitions("place", "block", "kind")
    return dealt.mapInArrow(lean(run), schema)
