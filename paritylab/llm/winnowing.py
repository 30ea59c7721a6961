"""Document fingerprints by winnowing: rolling k-gram hashes, the minimum of every window of ``w``
grams (rightmost on ties), kept with its position.

Guarantee: two texts that share a run of ``w + k - 1`` code points share at least one selected
(hash, position inside the run). A text with fewer than ``w`` grams is one window; a text with
fewer than ``k`` code points is one gram; an empty (or null) text has no selection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritylab.llm.common import (SENTINEL, add_columns, code_points, gram_hashes, lean, order_key, partitions, sha256_hex,
                                  slices, spread_symbols, window_minima)

#: A common run of 15 code points is found, so a text of 30 or more meets its edited text, which has its first half.
K = 8
W = 8
CHUNK = 1 << 21


def _long_text(codes: np.ndarray, k: int, w: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Selections of one text, in overlapping pieces: windows are local, so pieces agree with the whole."""
    hashes, positions = [], []
    reach = w + k - 2
    for lo in range(0, max(1, len(codes) - reach), chunk):
        piece = codes[lo:lo + chunk + reach]
        grams = gram_hashes(spread_symbols(piece), k)
        chosen = window_minima(grams, min(w, len(grams)))
        chosen = chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
        if positions and positions[-1][-1] == chosen[0] + lo:
            chosen = chosen[1:]
        if len(chosen):
            hashes.append(grams[chosen])
            positions.append(chosen.astype(np.int64) + lo)
    return np.concatenate(hashes), np.concatenate(positions)


def winnow(texts: list[str], k: int = K, w: int = W, chunk: int = CHUNK) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) of the selected grams of each text, in order of position."""
    out: list = [None] * len(texts)
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    group, size = [], 0

    def flush():
        nonlocal group, size
        if group:
            for i, got in zip((i for i, _ in group), _winnow_joined([c for _, c in group], k, w)):
                out[i] = got
        group, size = [], 0

    for i, text in enumerate(texts):
        codes = code_points(text)
        if len(codes) == 0:
            out[i] = none
        elif len(codes) < k:
            out[i] = (gram_hashes(spread_symbols(codes), len(codes)), np.zeros(1, np.int64))
        elif len(codes) > chunk:
            out[i] = _long_text(codes, k, w, chunk)
        else:
            group.append((i, codes))
            size += len(codes)
            if size > chunk:
                flush()
    flush()
    return out


def _winnow_joined(texts: list[np.ndarray], k: int, w: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Many texts of k code points or more at once: joined with gaps whose grams can never be chosen."""
    n = np.array([len(t) for t in texts])
    start = np.concatenate([[0], np.cumsum(n + w)])[:-1]
    joined = np.zeros(int(start[-1] + n[-1] + w), np.uint32)
    for s, t in zip(start, texts):
        joined[s:s + len(t)] = t
    grams = gram_hashes(spread_symbols(joined), k)
    room = np.full(len(joined), SENTINEL)  # a gram of the gap, or one that runs into it
    room[:len(grams)] = grams
    inside = np.zeros(len(joined) + 1, np.int8)
    inside[start] += 1
    inside[start + n - k + 1] -= 1
    room[np.cumsum(inside[:-1]) == 0] = SENTINEL
    opens = np.zeros(len(joined) + 1, np.int8)  # starts of windows that belong to a text
    opens[start] += 1
    opens[start + np.maximum(n - k + 1 - w, 0) + 1] -= 1
    chosen = window_minima(room, w)
    chosen = chosen[np.cumsum(opens[:-1])[:len(chosen)] > 0]
    chosen = chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
    cuts = np.searchsorted(chosen, np.append(start, len(joined)))
    return [(room[chosen[a:b]], chosen[a:b].astype(np.int64) - s) for a, b, s in zip(cuts[:-1], cuts[1:], start)]


def fingerprint(hashes: np.ndarray) -> str:
    """The selected hashes in order of position, 8 hex digits (the top 32 of 63 bits) each."""
    return (hashes >> np.uint64(31)).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two selections as sets of hashes; two empty selections are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    either = len(a) + len(b) - both
    return both / either if either else 1.0


def fingerprint_documents(docs: DataFrame, k: int = K, w: int = W, text: str = "text") -> DataFrame:
    """``docs`` with ``winnow_hashes`` and ``winnow_positions`` (code points); columns of these names are replaced.

    No shuffle: a narrow pass in Arrow batches."""
    def make(texts: list[str]) -> list[pa.Array]:
        got = winnow(texts, k, w)
        return [pa.array([h.astype(np.int64) for h, _ in got], pa.list_(pa.int64())), pa.array([p for _, p in got], pa.list_(pa.int64()))]

    longs = T.ArrayType(T.LongType())
    return add_columns(docs, text, [T.StructField("winnow_hashes", longs), T.StructField("winnow_positions", longs)], make)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, copy, d, doc_id, text) dealt into runs of ascending doc_id and sorted, each run ended
    by a copy of the first row of the next run, so that every row's successor stands behind it.

    Cut points are doc_ids that occur (ranks within 1e-4), one per shuffle partition. One shuffle."""
    parts = partitions(docs.sparkSession)
    keyed = docs.select("doc_id", "text", order_key().alias("d"))
    ranks = [i / parts for i in range(1, parts)]
    least, at = keyed.agg(F.min("d"), F.percentile_approx("d", ranks or [0.5], max(10000, 20 * parts))).first()
    cuts = np.array(sorted({least, *(at or [])} - {None}), np.int64)
    m = len(cuts)

    @F.udf(T.ArrayType(T.IntegerType()), useArrow=True)
    def targets(d):
        own = int(np.searchsorted(cuts, d, side="right")) - 1
        return [own, m + (own - 1) % m] if cuts[own] == d else [own]

    dealt = (keyed.select("doc_id", "text", "d", F.explode(targets("d")).alias("to"))
             .select((F.col("to") % max(m, 1)).alias("bucket"), (F.col("to") >= m).alias("copy"), "d", "doc_id", "text"))
    return dealt.repartitionById(max(m, 1), F.col("bucket")).sortWithinPartitions("bucket", "copy", "d", "text")


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, " \
         "near_edited double, near_next double, n_selected int, n_edited_selected int"


def edited_neighbours(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Every document's fingerprint beside that of its edited text (the last half replaced by the next
    document's beginning) and its likeness to both.

    Null texts are empty. Null doc_ids sort first; equal doc_ids are ordered by text. After the last
    document comes the first; a single document follows itself. An empty table gives an empty result."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        ids: list = []
        texts: list[str] = []
        closed: list[bool] = []  # rows that only lend their text
        buckets: list = []
        size = 0

        def flush(last: bool):
            nonlocal ids, texts, closed, buckets, size
            own = winnow(texts, k, w)
            take = [i for i in range(len(texts) - 1) if not closed[i] and buckets[i] == buckets[i + 1]]
            edited = [edited_text(texts[i], texts[i + 1]) for i in take]
            prints = winnow(edited, k, w)
            rows = []
            for i, e, (eh, _) in zip(take, edited, prints):
                h, after = own[i][0], own[i + 1][0]
                rows.append((ids[i], len(texts[i]), sha256_hex(e.encode("utf-8", "surrogatepass")), fingerprint(h), fingerprint(eh),
                             likeness(h, eh), likeness(h, after), len(h), len(eh)))
            ids, texts, closed, buckets = ([x[-1:] for x in (ids, texts, closed, buckets)] if not last else ([], [], [], []))
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names=names) if rows else None

        for b in slices(batches):
            col = b.to_pydict()
            for i in range(b.num_rows):
                ids.append(col["doc_id"][i])
                texts.append(col["text"][i] or "")
                closed.append(col["copy"][i])
                buckets.append(col["bucket"][i])
                size += len(texts[-1])
                if size > CHUNK:
                    if (got := flush(False)) is not None:
                        yield got
        if texts and (got := flush(True)) is not None:
            yield got

    return with_next(docs).mapInArrow(lean(run), SCHEMA)


KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
