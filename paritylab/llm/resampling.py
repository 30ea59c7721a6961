"""Importance resampling of documents towards a target corpus, by hashed word features.

1. Words come from an untrained regex split (the tokenizers library's ``Split`` with ``removed`` and ``invert``) over the
   text with A-Z lowered, with the offsets of each. A feature is a window of up to ``longest`` consecutive offset pairs:
   the text between the first start and the last end where single spaces part the words, else the words joined by spaces.
2. A feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``. The buckets of every document are written once
   (two bytes a feature) and read three times: for the histogram of the corpus, for the weights and for the ranks.
3. A bucket's gain is 1000 times the log ratio of its smoothed shares in the target and in the corpus, floored. Only the two
   histograms, one number a bucket, reach the driver; the gains travel back as one array of that size.
4. A document's weight is the floored mean gain of its features. Gumbel noise from a hash of its id makes the highest scores a
   draw without replacement. Ranks follow from range partitions of the whole order, so no task sorts the corpus.

Null and empty texts have no features: weight 0. A null id is hashed as an empty string and orders first. Rows that repeat an id share its noise;
on equal scores the smaller id is first, then the smaller hash of the text. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paritylab.llm.common import cut_lineage, lean, order_key, share, slices, texts_of, worker_store
from paritylab.operators.ranking import range_rank

#: Everything but controls, space, punctuation and capitals of ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Distinct words whose bucket a worker remembers; the memo starts anew when it is full.
MEMO = 500_000


def splitter(pattern: str = WORDS):
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(pattern), "removed", invert=True)


def lowered(text: str) -> str:
    """``text`` with A-Z lowered, other letters as they are."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def features(text: str, words: list[tuple[str, tuple[int, int]]], longest: int) -> Iterator[str]:
    """Windows of 1 to ``longest`` offset pairs, as strings."""
    yield from (w for w, _ in words)
    if longest < 2:
        return
    start, end = (np.array([o[i] for _, o in words] + [0], np.int64)[:len(words)] for i in (0, 1))
    gap = np.zeros(len(words), np.int64)  # joints so far that are anything but one space
    gap[1:] = [b - a != 1 or text[a] != " " for a, b in zip(end[:-1].tolist(), start[1:].tolist())]
    gap = np.cumsum(gap)
    for n in range(2, longest + 1):
        for i in range(len(words) - n + 1):
            j = i + n - 1
            yield text[start[i]:end[j]] if gap[i] == gap[j] else " ".join(w for w, _ in words[i:j + 1])


class Bucketer:
    """Buckets of a text's features."""

    def __init__(self, buckets: int, longest: int, pattern: str = WORDS):
        self.split, self.buckets, self.longest = splitter(pattern), buckets, longest
        self.kind = "<u2" if buckets <= 1 << 16 else "<u4"
        self.memo: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        """(words, bucket of every feature)"""
        text = lowered(text)
        words = self.split.pre_tokenize_str(text)
        memo, out = self.memo, []
        for f in features(text, words, self.longest):
            b = memo.get(f)
            if b is None:
                if len(memo) >= MEMO:
                    memo.clear()
                b = memo[f] = zlib.crc32(f.encode("utf-8", "surrogatepass")) % self.buckets
            out.append(b)
        return len(words), np.array(out, self.kind)


def bucketed(docs: DataFrame, buckets: int, longest: int, text: str = "text") -> DataFrame:
    """(doc_id, tie, n_words, n_features, buckets) of every row; ``buckets`` is a packed array. A narrow pass."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        store = worker_store("resampling")
        if (buckets, longest) not in store:
            store[buckets, longest] = Bucketer(buckets, longest)
        make = store[buckets, longest]
        for b in slices(batches, "text", 2 << 20):
            got = [make(t) if t else (0, np.zeros(0, make.kind)) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("tie"), pa.array([n for n, _ in got], pa.int64()), pa.array([len(x) for _, x in got], pa.int64()),
                 pa.array([x.tobytes() for _, x in got], pa.binary())], names=["doc_id", "tie", "n_words", "n_features", "buckets"])

    ids = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    base = docs.select(ids.alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("tie"), F.col(f"`{text}`").alias("text"))
    return base.mapInArrow(lean(run), "doc_id bigint, tie bigint, n_words bigint, n_features bigint, buckets binary")


def unpacked(column: pa.Array, kind: str) -> np.ndarray:
    """All buckets of a column of packed arrays, one after another."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(kind) if data is not None else np.zeros(0, kind)


def histogram(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features of each bucket over all rows of ``bucketed``: tasks send partial sums, one row a bucket at most."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(unpacked(b.column("buckets"), kind), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("buckets").mapInArrow(lean(run), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def log_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed shares, by bucket."""
    k = float(len(corpus))
    ratio = (target + 1.0) * (float(corpus.sum()) + k) / ((corpus + 1.0) * (float(target.sum()) + k))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weighed(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, tie, n_words, n_features, weight): floored mean gain of the features; none: 0."""
    kind, sent = "<u2" if len(gains) <= 1 << 16 else "<u4", share(rows.sparkSession, gains)

    def run(batches) -> Iterator[pa.RecordBatch]:
        gain = sent()
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("n_features").to_numpy(zero_copy_only=False)
            sums = np.concatenate([[0], np.cumsum(gain[unpacked(b.column("buckets"), kind)])])
            ends = np.cumsum(n)
            total = sums[ends] - sums[ends - n]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "tie", "n_words", "n_features")),
                                              pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))],
                                             names=["doc_id", "tie", "n_words", "n_features", "weight"])

    return rows.mapInArrow(lean(run), "doc_id bigint, tie bigint, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int) -> Column:
    """Floored thousandths of Gumbel noise, from the first 8 hex digits of sha256(``seed:doc_id``)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, seed: int = 2024, percent: int = 10,
             least_words: int = 20, text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``.

    Of the N rows with at least ``least_words`` words the floor(percent * N / 100) highest scores are drawn; ``rank`` is 1, 2, 3...
    in that order, null for the others. ``target`` has a column ``text``."""
    rows = cut_lineage(bucketed(docs, buckets, longest, text))
    gains = log_gains(histogram(rows, buckets), histogram(bucketed(target, buckets, longest), buckets))
    drawn = percent * rows.where(F.col("n_words") >= least_words).count() // 100
    scored = weighed(rows, gains).select("doc_id", "tie", "n_features", "weight", (F.col("weight") + noise(seed)).alias("score"),
                                         (F.col("n_words") < least_words).cast("int").alias("short"))
    ranked = range_rank(scored, [], [F.col("short"), F.col("score").desc(), order_key(), F.col("tie")], "place")
    return ranked.select("doc_id", "n_features", "weight", "score",
                         F.when(F.col("place") <= drawn, F.col("place")).cast("long").alias("rank"))
