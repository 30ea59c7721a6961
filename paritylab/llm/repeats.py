"""Exact substring dedup: every byte inside a ``MIN``-byte string that starts earlier too is removed.

1. Anchors. In every window of MIN bytes the K-gram with the least hash (rightmost on ties) is chosen, so
   equal windows choose the same place. An anchor carries its gram's hash and the hash of its context, the
   bytes up to MIN - K on either side (clipped at the document): all windows that contain the gram.
2. Anchors meet by gram hash, as packed numpy columns. Anchors of one context are one repeat; the earliest
   stands for them. Only where a gram has several contexts their bytes are needed.
3. Those contexts are laid out as one text with an enhanced suffix array (sorted suffixes and their
   common-prefix lengths). A stack scan of the common prefixes gives the interval tree; an interval of
   depth MIN or more whose occurrences have different left neighbours is a maximal repeat, reported with
   all its occurrences. An interval with a single left neighbour is part of a longer repeat one byte to the
   left, and so are all intervals below it.
4. All occurrences but the earliest are removed; their union per document is cut out.

Repeats longer than a context come as overlapping pieces, which the union joins. "Earlier" is a smaller
doc_id (null smallest; equal ids ordered by a hash of the text), then a smaller start.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritylab.llm.common import (LONG_MIN, fresh, gram_hashes, lean, mix64, order_key, partitions, prefix_hash,
                                  range_hash, slices, spread_symbols, window_minima, worker_store)

MIN = 100
K = 32
PIECE = 1 << 19
#: Contexts laid out in one suffix array; grams of over HUGE contexts are hot: their windows meet in joins instead.
BATCH = 4096
HUGE = 10_000
#: Bytes of suffixes that are sorted at a time.
SUFFIX_BYTES = 16 << 20
#: Bound of the windows that are sent to all tasks; beyond, they are spread over this many keys each.
SENT, SALTS = 100_000, 64
#: Marks, in ASK rows, contexts that occur more than once and those of a hot gram, above their length and the gram's place.
MANY, HOT = 1 << 16, 1 << 17
LOW48 = np.uint64((1 << 48) - 1)
DUPLICATED = np.uint32(1 << 31)
FIRST, LATER, ASK = 1, 0, 2
FOUND = "kind int, grp bigint, _rd bigint, _rt int, at bigint, len int"
NAMES = [f.split()[0] for f in FOUND.split(", ")]
#: An occurrence of a repeat ``name``: ``shift`` bytes into the first occurrence of the context ``cid``.
REPEATS = "name bigint, cid bigint, shift int, _rd bigint, _rt int, at bigint, len int"


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def anchors(data: np.ndarray, offsets: np.ndarray, least: int = MIN, k: int = K) -> tuple[np.ndarray, ...]:
    """(position, document index, gram hash, context hash, context start, context end), positions ascending.

    Long inputs go in pieces that overlap by a context, which gives the same anchors."""
    w, side, n = least - k + 1, least - k, len(data)
    symbols = spread_symbols(np.arange(256))
    opens = np.zeros(n + 1, np.int32)  # starts of whole windows
    size = np.diff(offsets)
    has = size >= least
    np.add.at(opens, offsets[:-1][has], 1)
    np.add.at(opens, offsets[1:][has] - least + 1, -1)
    inside = np.cumsum(opens[:-1]) > 0
    parts, last = [], -1
    for p0 in range(0, max(0, n - least + 1), PIECE):
        p1 = min(n - least + 1, p0 + PIECE)
        a, b = max(0, p0 - side), min(n, p1 + least + side)
        p = prefix_hash(symbols[data[a:b]])
        grams = gram_hashes(symbols[data[p0:min(n, p1 + least - 1)]], k)
        chosen = window_minima(grams, w)[:p1 - p0][inside[p0:p1]].astype(np.int64)
        if not len(chosen):
            continue
        chosen = chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
        pos = chosen + p0
        if pos[0] == last:
            pos, chosen = pos[1:], chosen[1:]
        if not len(pos):
            continue
        last = pos[-1]
        doc = np.searchsorted(offsets, pos, side="right") - 1
        lo, hi = np.maximum(offsets[doc], pos - side), np.minimum(offsets[doc + 1], pos + k + side)
        context = mix64(range_hash(p, lo - a, hi - a) + (pos - lo).astype(np.uint64))
        parts.append((pos, doc, grams[chosen] & LOW48, context, lo, hi))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*parts))


def six(values: np.ndarray) -> bytes:
    """48-bit values, six bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(n, 6)
    return out.reshape(-1).view("<u8")


def pack(h, ctx, doc, pos, left, length, d, t) -> bytes:
    """Anchors as one packed block: per anchor 22 bytes (a slice has under 2**16 documents of MIN bytes), and the ids of the documents they stand in."""
    used, doc = np.unique(doc, return_inverse=True)
    return b"".join([np.array([len(h), len(used)], "<i8").tobytes(), six(h), ctx.astype("<u8").tobytes(), doc.astype("<u2").tobytes(), pos.astype("<u4").tobytes(),
                     left.astype(np.uint8).tobytes(), length.astype(np.uint8).tobytes(), d[used].astype("<i8").tobytes(), t[used].astype("<i4").tobytes()])


def unpack(block: bytes) -> tuple[np.ndarray, ...]:
    n, m = np.frombuffer(block, "<i8", 2)
    at, out = 16, []
    for width in (6, 8, 2, 4, 1, 1):
        out.append(block[at:at + width * n])
        at += width * n
    doc = np.frombuffer(out[2], "<u2")
    d, t = np.frombuffer(block, "<i8", m, at), np.frombuffer(block, "<i4", m, at + 8 * m)
    return (from_six(out[0], n), np.frombuffer(out[1], "<u8"), d[doc], t[doc], np.frombuffer(out[3], "<u4"),
            np.frombuffer(out[4], np.uint8), np.frombuffer(out[5], np.uint8))


def context_name(h: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """The id of a context, from the hashes of its gram and of its bytes."""
    return mix64(h ^ mix64(ctx))


def found_batch(kind, grp, d, t, at, length) -> pa.RecordBatch:
    n = len(d)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.broadcast_to(np.asarray(kind, np.int32), n)), pa.array(grp.astype(np.int64)), pa.array(d.astype(np.int64)),
         pa.array(t.astype(np.int32)), pa.array(at.astype(np.int64)), pa.array(length.astype(np.int32))],
        names=["kind", "grp", "_rd", "_rt", "at", "len"])


def _first_of_runs(*keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def anchor_blocks(docs: DataFrame, text: str, parts: int, least: int, groups: bool) -> DataFrame:
    """(part, block, kind ...): packed anchors for each part, one of every context per slice, and the
    occurrences that the slice already knows to be later ones."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        worker_store("repeats")
        for b in slices(batches, text, PIECE):
            data, offsets = byte_column(b.column(text))
            d, t = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_rd", "_rt"))
            rank = np.empty(len(d), np.int64)
            order = np.lexsort((t, d))
            rank[order] = np.cumsum(_first_of_runs(d[order], t[order]))  # equal rows are one document
            pos, doc, h, ctx, lo, hi = anchors(data, offsets, least)
            if not len(pos):
                continue
            rel = pos - offsets[doc]
            order = np.lexsort((rel, rank[doc], ctx, h))
            pos, doc, h, ctx, lo, hi, rel = (x[order] for x in (pos, doc, h, ctx, lo, hi, rel))
            first = _first_of_runs(h, ctx)
            lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
            later = ~first & ((rank[doc] != rank[doc[lead]]) | (rel != rel[lead]))
            many = np.zeros(len(h), bool)
            many[lead[later]] = True
            left, length = pos - lo, hi - lo
            if later.any():
                grp, who, at, size = context_name(h[later], ctx[later]), doc[later], lo[later] - offsets[doc[later]], length[later]
                if not groups:  # only their union is wanted
                    who, at, end = joined_spans(who, at, at + size)
                    grp, size = np.zeros(len(who), np.int64), end - at
                own = d[who]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((mix64(own.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)), pa.nulls(len(own), pa.binary()),
                     *found_batch(LATER, grp, own, t[who], at, size).columns],
                    names=["part", "block", "kind", "grp", "_rd", "_rt", "at", "len"])
            pos, doc, h, ctx, rel, left, length, many = (x[first] for x in (pos, doc, h, ctx, rel, left, length, many))
            part = (mix64(h) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True])
            made = []
            for x, y in zip(cuts[:-1], cuts[1:]):
                i = order[x:y]
                made.append((int(part[i[0]]), pack(h[i], ctx[i], doc[i], rel[i].astype(np.uint32) | np.where(many[i], DUPLICATED, np.uint32(0)),
                                                   left[i], length[i], d, t)))
            n = len(made)
            none = found_batch(LATER, *(np.zeros(n, np.int64) for _ in range(5)))
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary()), *none.columns],
                                             names=["part", "block", "kind", "grp", "_rd", "_rt", "at", "len"])

    return docs.select(text, "_rd", "_rt").mapInArrow(lean(run), "part int, block binary, " + FOUND)


def meet(blocks: DataFrame, parts: int, firsts: bool) -> DataFrame:
    """Anchors of a part by gram: later occurrences of a context, and the contexts whose bytes are asked for.

    A task holds the packed anchors of its part, about the part's share of the input divided by 60."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        worker_store("repeats")
        got = []
        for b in batches:
            packed = b.column("block").is_valid()
            got += [unpack(x) for x in b.column("block").filter(packed).to_pylist()]
            known = b.filter(pc.invert(packed))
            if known.num_rows:  # later occurrences that a slice has found
                yield known.select(NAMES)
        if not got:
            return
        h, ctx, d, t, pos, left, length = (np.concatenate(c) for c in zip(*got))
        order = np.lexsort((pos & ~DUPLICATED, t, d, ctx, h))
        h, ctx, d, t, pos, left, length = (x[order] for x in (h, ctx, d, t, pos, left, length))
        many, pos = pos >= DUPLICATED, (pos & ~DUPLICATED).astype(np.int64)
        first = _first_of_runs(h, ctx)
        lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        later = ~first & ((d != d[lead]) | (t != t[lead]) | (pos != pos[lead]))
        at, grp = pos - left, context_name(h, ctx)
        if later.any():
            yield found_batch(LATER, grp[later], d[later], t[later], at[later], length[later])
        group = np.cumsum(_first_of_runs(h)) - 1
        contexts = np.bincount(group, weights=first)[group]
        if firsts:  # a gram's only context is a repeat as it is
            many[lead[later]] = True
            many = np.bincount(lead, weights=many, minlength=len(h)) > 0
            f = first & many & (contexts == 1)
            yield found_batch(FIRST, grp[f], d[f], t[f], at[f], length[f])
        ask = first & (contexts > 1)
        if ask.any():  # a context is named by its start, its length, the gram's place in it and whether the gram is hot
            yield found_batch(ASK, h[ask], d[ask], t[ask], at[ask], length[ask] + 256 * left[ask].astype(np.int64) + MANY * many[ask] + HOT * (contexts[ask] > HUGE))

    return blocks.repartitionById(parts, F.col("part")).mapInArrow(lean(run), FOUND)


class SuffixArray:
    """Enhanced suffix array of contexts laid out one after another, over the suffixes that can open an interval
    of depth ``least`` whose left neighbours differ.

    Suffixes are first classed by a hash of their first ``least`` bytes. A class of one has no such interval; in
    a class with one left neighbour every interval has one left neighbour. The rest is sorted byte by byte."""

    def __init__(self, contexts: list[bytes], least: int):
        size = np.array([len(c) for c in contexts])
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(contexts), np.uint8)
        places = np.maximum(size - least + 1, 0)
        owner = np.repeat(np.arange(len(size)), places)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(places) - places, places)
        at = start[owner] + offset
        p = prefix_hash(spread_symbols(np.arange(256))[data])
        window = range_hash(p, at, at + least)
        # What stands left of each suffix; a context's first byte may have anything there.
        left = np.where(offset > 0, data[np.maximum(at - 1, 0)].astype(np.int64), -1 - owner)
        order = np.argsort(window, kind="stable")
        cut = np.flatnonzero(_first_of_runs(window[order])) if len(order) else np.zeros(0, np.int64)
        if len(cut):
            ordered = left[order]
            mixed = np.minimum.reduceat(ordered, cut) != np.maximum.reduceat(ordered, cut)
            order = order[np.repeat(mixed, np.diff(np.append(cut, len(order))))]
        owner, offset, at, window = owner[order], offset[order], at[order], window[order]
        self.context, self.offset, self.common = self._sorted(data, size, owner, offset, at, window, least)
        self.left = np.where(self.offset > 0, data[np.maximum(start[self.context] + self.offset - 1, 0)].astype(np.int64), -1 - self.context)

    @staticmethod
    def _sorted(data, size, owner, offset, at, window, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes sorted byte by byte (contexts and offsets) and their common-prefix lengths. Classes follow one another and
        share no interval of depth ``least``, so some are laid out at a time: SUFFIX_BYTES of suffixes, one class at least."""
        room = size[owner] - offset
        width = -(-int(room.max(initial=8)) // 8) * 8
        padded = np.concatenate([data, np.full(width, 255, np.uint8)])
        edges = np.append(np.flatnonzero(_first_of_runs(window)) if len(window) else np.zeros(0, np.int64), len(window))
        done, common, lo = [], [], 0
        while lo < len(window):
            hi = int(edges[max(np.searchsorted(edges, lo + SUFFIX_BYTES // width, "right") - 1, np.searchsorted(edges, lo, "right"))])
            rows = np.lib.stride_tricks.sliding_window_view(padded, width)[at[lo:hi]]
            rows[np.arange(width) >= room[lo:hi, None]] = 255  # ends a context: UTF-8 never has it, and it sorts last
            order = np.lexsort(rows.view(">u8").T[::-1])
            rows, left = rows[order], room[lo:hi][order]
            differs = rows[1:] != rows[:-1]
            same = np.where(differs.any(1), differs.argmax(1), width)
            done.append(lo + order)
            common += [np.minimum(np.minimum(same, left[1:]), left[:-1]), np.zeros(1, same.dtype)]
            lo = hi
        order = np.concatenate(done) if done else np.zeros(0, np.int64)
        return owner[order], offset[order], np.concatenate(common)[:-1] if common else np.zeros(0, np.int64)

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(length, first, last) of the intervals of depth ``least`` or more with different left neighbours."""
        high = np.concatenate([[False], self.common >= least, [False]])
        edge = np.diff(high.astype(np.int8))
        for lo, hi in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            left = self.left[lo:hi + 1]
            if (left == left[0]).all():  # then so it is in every interval below
                continue
            yield from ((n, lo + a, lo + b) for n, a, b in stack_scan(self.common[lo:hi].tolist(), left.tolist()))


def stack_scan(common: list[int], left: list[int]) -> list[tuple[int, int, int]]:
    """Intervals (depth, first, last) of a common-prefix array whose left neighbours differ.

    The stack holds open intervals as [depth, first, left neighbour, or None once two differ]."""
    out, stack = [], []
    for i in range(len(left)):
        depth, lb, state = (common[i] if i < len(common) else -1), i, left[i]
        while stack and stack[-1][0] > depth:
            d, lb, s = stack.pop()
            state = s if s == state else None
            if state is None:
                out.append((d, lb, i))
        if stack and stack[-1][0] == depth:
            if stack[-1][2] != state:
                stack[-1][2] = None
        elif depth >= 0:
            stack.append([depth, lb, state])
    return out


def context_rows(docs: DataFrame, asks: DataFrame, text: str) -> DataFrame:
    """(grp, _rd, _rt, at, gram, context) of the contexts that are asked for; ``gram`` is the gram's place and, above 8 bits, the marks."""
    wanted = (asks.groupBy(F.col("_rd").alias("_ad"), F.col("_rt").alias("_at"))
              .agg(F.collect_list(F.struct("at", (F.col("len") % 256).alias("len"), F.floor(F.col("len") / 256).cast("int").alias("gram"), "grp")).alias("_asks")))

    def run(batches) -> Iterator[pa.RecordBatch]:
        worker_store("repeats")
        for b in slices(batches, text):
            rows = []
            for raw, d, t, asked in zip(b.column(text).cast(pa.binary()).to_pylist(), b.column("_rd").to_pylist(), b.column("_rt").to_pylist(),
                                        b.column("_asks").to_pylist()):
                rows += [(a["grp"], d, t, a["at"], a["gram"], raw[a["at"]:a["at"] + a["len"]]) for a in asked]
            for lo in range(0, len(rows), 1 << 15):
                cols = zip(*rows[lo:lo + (1 << 15)])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))],
                                                 names=["grp", "_rd", "_rt", "at", "gram", "context"])

    return docs.join(wanted, (F.col("_rd") == F.col("_ad")) & (F.col("_rt") == F.col("_at"))).mapInArrow(lean(run), "grp bigint, _rd bigint, _rt int, at bigint, gram int, context binary")


def context_ids(grp: np.ndarray, gram: np.ndarray, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The ids by which ``meet`` and the slices name contexts, from their bytes."""
    p = prefix_hash(spread_symbols(np.arange(256))[data])
    ctx = mix64(range_hash(p, begin[:-1], begin[1:]) + gram.astype(np.uint64))
    return context_name(grp.astype(np.uint64), ctx).astype(np.int64)


def chosen_grams(string: bytes, least: int) -> np.ndarray:
    """Places of the grams that the windows of a string choose: wherever the string stands, these are anchors."""
    return np.unique(window_minima(gram_hashes(spread_symbols(np.arange(256))[np.frombuffer(string, np.uint8)], K), least - K + 1))


def named_repeats(h: np.ndarray, length) -> np.ndarray:
    """The id of a repeat, from the hash of its bytes."""
    return (mix64(h + np.asarray(length).astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def repeats_of(rows: list[tuple], least: int, groups: bool) -> pa.RecordBatch | None:
    """Later occurrences of the maximal repeats among contexts (grp, d, t, at, place of the gram, bytes); or, for
    ``groups``, all occurrences in these contexts as REPEATS.

    Then a context that occurs more than once is laid out twice, and a repeat is told by the contexts whose gram it
    chooses itself: those are all that hold it. Where it does not, another gram tells it."""
    rows = sorted(set(rows), key=lambda r: r[:4])
    if groups:
        rows += [r for r in rows if r[4] & MANY >> 8]
    sa = SuffixArray([r[5] for r in rows], least)
    d, t, at, gram = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3, 4))
    if groups:
        size = np.array([len(r[5]) for r in rows])
        cid = context_ids(np.array([r[0] for r in rows], np.int64), gram & 255, np.frombuffer(b"".join(r[5] for r in rows), np.uint8), np.r_[0, np.cumsum(size)])
    out = []
    for length, lo, hi in sa.maximal_repeats(least):
        c, shift = sa.context[lo:hi + 1], sa.offset[lo:hi + 1]
        if groups:
            string = rows[c[0]][5][shift[0]:shift[0] + length]
            own = np.isin((gram[c] & 255) - shift, chosen_grams(string, least))
            c, shift = c[own], shift[own]
            if not (gram[c] & MANY >> 8).any() and len(set(zip(d[c].tolist(), t[c].tolist(), (at[c] + shift).tolist()))) < 2:
                continue  # one place, seen in two contexts
            p = prefix_hash(spread_symbols(np.arange(256))[np.frombuffer(string, np.uint8)])
            name = named_repeats(range_hash(p, np.array([0]), np.array([length])), length)[0]
            out.append((np.full(len(c), name), cid[c], shift, d[c], t[c], at[c] + shift, np.full(len(c), length)))
            continue
        start = at[c] + shift
        order = np.lexsort((start, t[c], d[c]))
        c, start = c[order], start[order]
        new = _first_of_runs(d[c], t[c], start)  # one place may be seen in two contexts
        c, start = c[new][1:], start[new][1:]
        if len(c):
            out.append((np.full(len(c), LATER), np.zeros(len(c), np.int64), d[c], t[c], start, np.full(len(c), length)))
    if not out:
        return None
    columns = [np.concatenate(x) for x in zip(*out)]
    return repeat_batch(*columns) if groups else found_batch(*columns)


def repeat_batch(name, cid, shift, d, t, at, length) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x).cast(k) for x, k in zip((name, cid, shift, d, t, at, length), kinds)],
                                      names=[f.split()[0] for f in REPEATS.split(", ")])


PLACE = "struct<_rd: bigint, _rt: int, start: bigint>"
WINDOWS = "grp bigint, wh bigint, _rd bigint, _rt int, at bigint, start bigint, name bigint, cid bigint, many boolean"
COUNTED = f"grp bigint, wh bigint, n bigint, f {PLACE}, l {PLACE}, many boolean"


def hot_windows(contexts: DataFrame, least: int, combined: bool) -> DataFrame:
    """The windows of hot contexts that choose the context's gram, ``wh`` a hash of the window, as WINDOWS (``many``:
    the context occurs more than once); or, ``combined``, each window of a slice once, with the count and the first
    and last place, as COUNTED."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        worker_store("repeats")
        symbols = spread_symbols(np.arange(256))
        for b in slices((x.filter(pc.greater_equal(x.column("gram"), HOT >> 8)) for x in batches), "context", 1 << 19):
            data, begin = byte_column(b.column("context"))
            if len(data) < least:
                continue
            grp, d, t, at, gram = (b.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "_rd", "_rt", "at", "gram"))
            places = np.maximum(np.diff(begin) - least + 1, 0)
            c = np.repeat(np.arange(len(places)), places)
            offset = np.arange(len(c)) - np.repeat(np.cumsum(places) - places, places)
            chosen = window_minima(gram_hashes(symbols[data], K), least - K + 1)
            own = chosen[begin[c] + offset] == begin[c] + (gram[c] & 255)
            c, offset = c[own], offset[own]
            h = range_hash(prefix_hash(symbols[data]), begin[c] + offset, begin[c] + offset + least)
            wh, start, many = h.view(np.int64), at[c] + offset, (gram[c] & MANY >> 8) > 0
            if not combined:
                cid = context_ids(grp, gram & 255, data, begin)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (grp[c], wh, d[c], t[c], at[c], start, named_repeats(h, least), cid[c], many)],
                                                 names=[f.split()[0] for f in WINDOWS.split(", ")])
                continue
            order = np.lexsort((start, t[c], d[c], wh, grp[c]))
            c, wh, start, many = c[order], wh[order], start[order], many[order]
            first = np.flatnonzero(_first_of_runs(grp[c], wh)) if len(c) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(c))[:len(first)] - 1
            place = [pa.StructArray.from_arrays([pa.array(x) for x in (d[c][i], t[c][i], start[i])], ["_rd", "_rt", "start"]) for i in (first, last)]
            many = np.maximum.reduceat(many, first) if len(first) else many
            yield pa.RecordBatch.from_arrays([pa.array(grp[c][first]), pa.array(wh[first]), pa.array(last - first + 1), *place, pa.array(many)],
                                             names=["grp", "wh", "n", "f", "l", "many"])

    return contexts.mapInArrow(lean(run), COUNTED if combined else WINDOWS)


def hot_repeats(contexts: DataFrame, least: int, groups: bool, hot: int) -> DataFrame:
    """The windows of hot contexts that occur in several places (for ``groups``, also by copies of a context), with
    the earliest place ``f`` among these contexts.

    Windows are counted by hash with partial sums in every task. Those that occur over BATCH times are at most the windows of the
    ``hot`` contexts divided by BATCH: where that is below SENT they are sent to all tasks; beyond, each is repeated for SALTS keys,
    over which its places are spread. So no task gets a window whole."""
    known = (hot_windows(contexts, least, True).groupBy("grp", "wh")
             .agg(F.sum("n").alias("n"), F.min("f").alias("f"), F.max("l").alias("l"), F.max("many").alias("many"))
             .where((F.col("f") < F.col("l")) | (F.col("many") & F.lit(groups))).select(F.col("grp").alias("_g"), F.col("wh").alias("_w"), "n", "f"))
    same = (F.col("grp") == F.col("_g")) & (F.col("wh") == F.col("_w"))
    windows, frequent = hot_windows(contexts, least, False), known.where(F.col("n") > BATCH)
    if hot * (least - K + 1) // BATCH < SENT:
        marked = windows.join(F.broadcast(frequent), same, "left")
    else:
        spread = frequent.withColumn("_ks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = windows.withColumn("_salt", F.pmod(F.xxhash64("_rd", "_rt", "start"), F.lit(SALTS))).join(
            spread, same & (F.col("_salt") == F.col("_ks")), "left").drop("_salt", "_ks")
    rest = marked.where(F.col("f").isNull()).drop("_g", "_w", "n", "f").join(known.where(F.col("n") <= BATCH), same)
    return marked.where(F.col("f").isNotNull()).unionByName(rest).drop("_g", "_w", "n")


def hot_spans(contexts: DataFrame, least: int, hot: int) -> DataFrame:
    """Later windows of hot contexts. Those of one context all contain its gram, so their union is one run."""
    later = hot_repeats(contexts, least, False, hot).where(F.struct("_rd", "_rt", "start") != F.col("f"))
    runs = later.groupBy("_rd", "_rt", "at").agg(F.min("start").alias("a"), F.max("start").alias("b"))
    return runs.select(F.lit(LATER).alias("kind"), F.lit(0).cast("long").alias("grp"), "_rd", "_rt", F.col("a").alias("at"),
                       (F.col("b") - F.col("a") + least).cast("int").alias("len"))


def hot_groups(contexts: DataFrame, least: int, hot: int) -> DataFrame:
    """Windows of hot contexts that occur in several places, each a repeat, as REPEATS. A window is told by the gram
    that it chooses, so these contexts are all that hold it."""
    return hot_repeats(contexts, least, True, hot).select("name", "cid", (F.col("start") - F.col("at")).cast("int").alias("shift"), "_rd", "_rt",
                                                     F.col("start").alias("at"), F.lit(least).alias("len"))


def compare_contexts(contexts: DataFrame, least: int, groups: bool) -> DataFrame:
    """Repeats among the contexts of every gram that is not hot, as ``repeats_of`` tells them."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        worker_store("repeats")
        rows: list[tuple] = []
        group: list[tuple] = []

        def close():
            nonlocal rows, group
            if len(group) > 1:
                rows += group
            group = []
            if len(rows) >= BATCH:
                if (got := repeats_of(rows, least, groups)) is not None:
                    yield got
                rows = []

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.filter(pc.less(b.column("gram"), HOT >> 8)).columns)):
                if group and group[-1][0] != r[0]:
                    yield from close()
                group.append(r)
        if group:
            yield from close()
        if rows and (got := repeats_of(rows, least, groups)) is not None:
            yield got

    return contexts.sortWithinPartitions("grp").mapInArrow(lean(run), REPEATS if groups else FOUND)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: compressed, and safe from lost executors."""
    from paritylab.session import ensure_checkpoint_dir

    path = f"{ensure_checkpoint_dir(df.sparkSession)}/repeats-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dealt(docs: DataFrame, text: str, parts: int) -> tuple[DataFrame, DataFrame]:
    """(documents where they are, the same dealt by id), with columns c0, c1 ... for those of ``docs``, so that no
    name clashes, ``text`` without nulls, and ``_rd``, ``_rt`` that order documents."""
    cols = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias("text") if c == text else F.col(f"`{c}`").alias(f"c{i}")
            for i, c in enumerate(docs.columns)]
    ids = {"_rd": order_key() if "doc_id" in docs.columns else F.lit(0).cast("long"),
           "_rt": F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).bitwiseAND(0x7FFFFFFF).cast("int")}
    keyed = docs.select(*cols, *[c.alias(n) for n, c in ids.items()])
    return keyed, keyed.repartition(parts, "_rd", "_rt")


def met_contexts(found: DataFrame, dealt: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(contexts asked for, how many of them are of a hot gram). Contexts of a gram meet, but those of a hot one stay apart. The
    marks are read in tasks, not by filters, so that all readers share one exchange."""
    asks = found.where(F.col("kind") == ASK)
    hot = asks.where(F.col("len") >= HOT).count()
    salt = [F.when(F.col("gram") >= HOT >> 8, F.xxhash64("_rd", "_rt", "at")).otherwise(F.lit(0))] if hot else []
    return context_rows(dealt, asks, "text").repartition(parts, "grp", *salt), hot


def later_spans(keyed: DataFrame, dealt: DataFrame, least: int = MIN) -> DataFrame:
    """(kind, grp, _rd, _rt, at, len): spans that cover all later occurrences."""
    parts = partitions(keyed.sparkSession)
    found = written(meet(anchor_blocks(keyed, "text", parts, least, False), parts, False))
    contexts, hot = met_contexts(found, dealt, parts)
    more = compare_contexts(contexts, least, False)
    if hot:
        more = more.unionByName(hot_spans(contexts, least, hot))
    return found.where(F.col("kind") == LATER).unionByName(more)


def repeat_groups(docs: DataFrame, least: int = MIN, text: str = "text") -> DataFrame:
    """group_id, doc_id, start, length (bytes), earliest: repeats of ``least`` bytes or more, each with all its occurrences.

    A repeat that no context holds whole comes in overlapping pieces, each a group; around a gram of over HUGE contexts
    the pieces are the windows of ``least`` bytes that occur more than once.
    Repeats are sought among one of each context and then carried to the context's other occurrences."""
    parts = partitions(docs.sparkSession)
    keyed, dealt = _dealt(docs, text, parts)
    found = written(meet(anchor_blocks(keyed, "text", parts, least, True), parts, True))
    contexts, hot = met_contexts(found, dealt, parts)
    told = (found.where(F.col("kind") == FIRST).select(F.col("grp").alias("name"), F.col("grp").alias("cid"), F.lit(0).alias("shift"), "_rd", "_rt", "at", "len")
            .unionByName(compare_contexts(contexts, least, True)))
    if hot:
        told = told.unionByName(hot_groups(contexts, least, hot))
    told = written(told)
    others = found.where(F.col("kind") == LATER).select(F.col("grp").alias("cid"), "_rd", "_rt", F.col("at").alias("from"))
    carried = others.join(told.select("name", "cid", "shift", "len"), "cid").select("name", "_rd", "_rt", (F.col("from") + F.col("shift")).alias("at"), "len")
    every = written(told.select("name", "_rd", "_rt", "at", "len").unionByName(carried).distinct())
    first = every.groupBy("name").agg(F.min(F.struct("_rd", "_rt", "at")).alias("f")).select("name", "f.*", F.lit(True).alias("earliest"))
    return every.join(first, ["name", "_rd", "_rt", "at"], "left").select(
        F.col("name").alias("group_id"), F.nullif(F.col("_rd"), F.lit(LONG_MIN)).alias("doc_id"), F.col("at").alias("start"),
        F.col("len").alias("length"), F.coalesce("earliest", F.lit(False)).alias("earliest"))


def joined_spans(row: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (row, start, end) joined where they touch or overlap, in order. Rows and bytes are below 2**31 and 2**32."""
    order = np.lexsort((at, row))
    row, at, end = row[order], at[order], end[order]
    reach = np.maximum.accumulate((row.astype(np.int64) << 32) + end) if len(row) else row
    new = np.ones(len(row), bool)
    new[1:] = ((row[1:].astype(np.int64) << 32) + at[1:]) > reach[:-1]
    new[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], at[first], (reach[last] - (row[first].astype(np.int64) << 32) if len(first) else end)


def merged_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The joined spans of each row of a column of lists (at, len)."""
    row = pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    at, size = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "len"))
    return joined_spans(row, at, at + size)


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def remove_repeats(docs: DataFrame, least: int = MIN, text: str = "text", into: tuple[str, str] = ("removed", "kept"),
                   as_text: bool = False) -> DataFrame:
    """``docs`` with ``into``: maximal spans (start, end) of removed bytes of the UTF-8 text, and the other bytes
    (or, ``as_text``, their characters; those that lose a byte go whole).

    Null texts are empty. Rows equal in doc_id and text are one document: neither is earlier than the other.
    Columns of these names are replaced; an empty table gives no rows. Texts are shuffled once, by doc_id."""
    parts = partitions(docs.sparkSession)
    names = [c for c in docs.columns if c not in into]
    docs = docs.select(*[f"`{c}`" for c in names])
    keyed, dealt = _dealt(docs, text, parts)
    spans = (later_spans(keyed, dealt, least)
             .groupBy(F.col("_rd").alias("_sd"), F.col("_rt").alias("_st")).agg(F.collect_list(F.struct("at", "len")).alias("_spans")))
    own = keyed.columns[:len(names)]
    schema = T.StructType([*keyed.schema.fields[:len(names)],
                           T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
                           T.StructField("kept", T.StringType() if as_text else T.BinaryType())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        worker_store("repeats")
        for b in slices(batches, "text"):
            row, at, end = merged_spans(b.column("_spans"))
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            kept = []
            for raw, lo, hi in zip(b.column("text").cast(pa.binary()).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                left = without(raw, list(zip(at[lo:hi].tolist(), end[lo:hi].tolist()))) if hi > lo else raw
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
            removed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(at), pa.array(end)], ["start", "end"]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), removed, pa.array(kept, pa.string() if as_text else pa.binary())],
                                             names=[*own, "removed", "kept"])

    done = dealt.join(spans, (F.col("_rd") == F.col("_sd")) & (F.col("_rt") == F.col("_st")), "left").mapInArrow(lean(run), schema)
    return done.select(*[F.col(c).alias(n) for c, n in zip(own, names)], F.col("removed").alias(into[0]), F.col("kept").alias(into[1]))


def removal_report(docs: DataFrame, least: int = MIN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    done = remove_repeats(docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text"), least)
    cut = F.expr("aggregate(removed, 0L, (a, x) -> a + x.end - x.start)")
    return done.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), cut.alias("n_removed"),
                       F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def cut_repeats(docs: DataFrame, least: int = MIN) -> DataFrame:
    """``docs`` with later occurrences cut out of ``text`` (characters that lose a byte go whole) and ``n_chars``
    brought up to date where there is such a column. Documents of which nothing is left go; all others stay."""
    removed, new = fresh(docs, "removed"), fresh(docs, "kept")
    done = remove_repeats(docs, least, into=(removed, new), as_text=True)
    done = done.where((F.size(removed) == 0) | (F.length(new) > 0))
    return done.select(*[F.col(new).alias(c) if c == "text" else F.when(F.size(removed) > 0, F.length(new)).otherwise(F.col("n_chars"))
                         .cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])
