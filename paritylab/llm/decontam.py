"""Benchmark decontamination: which documents contain a test item?

Containment = distinct word shingles of the item that the document has, over those of the item; an item
is found at ``THRESHOLD`` or more. Words are runs of ASCII letters and digits and of all other non-ASCII
characters, in lower case; an item of fewer words than ``SHINGLE`` is one shingle, its whole sequence.

Search: an item's MinHash sketch is its ``n - need + 1`` smallest shingle hashes, where ``need`` is the
least number of shared shingles. A document that has ``need`` of the ``n`` shingles misses at most
``n - need``, so it has one of the sketch: none is overlooked, however long the document. Documents are
partitioned by size (powers of two of their shingles); a partition is searched only for items whose
``need`` its largest document can meet. Candidates are then verified on the words themselves.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritylab.llm.common import (add_columns, fresh, gram_hashes, lean, order_key, prefix_hash, range_hash,
                                  share, slices, spread_symbols, texts_of, worker_store)

SHINGLE = 5
THRESHOLD = 0.8
#: Characters of all items together up to which they are sent to every task; beyond, the search is a join.
MAX_SENT = 32 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
IS_WORD = np.zeros(256, bool)
IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
LEAKS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("containment", T.DoubleType()),
                                  T.StructField("n_shared", T.IntegerType()), T.StructField("n_item", T.IntegerType())]))


def lowered(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def shingle_set(text: str, size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    words = WORD.findall(lowered(text))
    if not words:
        return set()
    size = min(size, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def need_of(n: int, threshold: float) -> int:
    return max(1, math.ceil(n * threshold - 1e-9))


class Words:
    """The words of many texts as one array of hashes, with the text that each stands in."""

    def __init__(self, texts: list[str]):
        raw = [lowered(t) for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        starts = np.cumsum([0, *(len(r) + 1 for r in raw)])
        is_word = IS_WORD[data]
        edge = np.diff(np.concatenate([[0], is_word.view(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.hash = range_hash(prefix_hash(spread_symbols(np.arange(256))[data]), first, last)
        self.text = np.searchsorted(starts, first, side="right") - 1
        self.count = np.bincount(self.text, minlength=len(texts))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of all runs of ``size`` words inside a text."""
        h = gram_hashes(self.hash, size)
        same = self.text[:len(h)] == self.text[size - 1:size - 1 + len(h)]
        return h[same], self.text[:len(h)][same]


class ItemIndex:
    """Sketches of the items by shingle length (5, or fewer words if the item has fewer)."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, threshold: float):
        self.shingle = shingle
        self.items = [(i, shingle_set(t or "", shingle)) for i, t in items]
        self.need = np.array([need_of(len(s), threshold) for _, s in self.items] or [1])
        words = Words([t or "" for _, t in items]) if items else None
        self.probes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in range(1, shingle + 1) if words else ():
            h, who = words.shingles(size)
            mine = np.flatnonzero(words.count == size if size < shingle else words.count >= size)
            keep = np.isin(who, mine)
            rows = []
            order = np.lexsort((h[keep], who[keep]))
            h, who = h[keep][order], who[keep][order]
            cuts = np.searchsorted(who, np.append(mine, len(words.count)))
            for m, a, b in zip(mine, cuts[:-1], cuts[1:]):
                own = np.unique(h[a:b])
                rows.extend((x, m) for x in own[:len(own) - need_of(len(own), threshold) + 1].tolist())
            if rows:
                rows.sort()
                probe = np.array([r[0] for r in rows], np.uint64)
                bits = np.zeros(1 << 20, bool)
                bits[(probe & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
                self.probes[size] = (probe, np.array([r[1] for r in rows]), bits)

    def candidates(self, texts: list[str]) -> set[tuple[int, int]]:
        """(text, item) pairs that share a shingle of the item's sketch, in size partitions that can hold the item."""
        words, found = Words(texts), set()
        for size, (probe, item, bits) in self.probes.items():
            h, who = words.shingles(size)
            maybe = bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
            h, who = h[maybe], who[maybe]
            lo, hi = np.searchsorted(probe, h, "left"), np.searchsorted(probe, h, "right")
            n = hi - lo
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who, what = np.repeat(who, n), item[at]
            room = np.maximum(words.count[who] - size + 1, 1)
            largest = 1 << (np.floor(np.log2(room)).astype(np.int64) + 1)  # above every size of the partition
            fits = self.need[what] < largest
            found.update(zip(who[fits].tolist(), what[fits].tolist()))
        return found

    def leaks(self, texts: list[str]) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in texts]
        sets: dict[tuple[int, int], set] = {}
        for t, m in sorted(self.candidates(texts)):
            item, wanted = self.items[m]
            size = len(next(iter(wanted)))
            if (t, size) not in sets:
                sets = {k: v for k, v in sets.items() if k[0] == t}
                ws = WORD.findall(lowered(texts[t]))
                sets[t, size] = {tuple(ws[i:i + size]) for i in range(len(ws) - size + 1)}
            both = len(wanted & sets[t, size])
            if both >= self.need[m]:
                out[t].append({"item_id": item, "containment": both / len(wanted), "n_shared": both, "n_item": len(wanted)})
        return out


def find_leaks(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD,
               max_sent: int = MAX_SENT, text: str = "text", into: str = "leaks") -> DataFrame:
    """``docs`` with ``into``: the items (item_id, text) that each document contains; a column of that name is replaced.

    Null and wordless texts and items match nothing. Repeated rows are judged one by one; no row is lost
    or doubled. If the items' characters are measured at ``max_sent`` or fewer they go to every task and the
    documents are not shuffled; else documents and items meet in joins on the hashes of the sketches, with the same result."""
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > max_sent:
        return _find_by_join(docs.drop(into), items, shingle, threshold, text, into)
    index = ItemIndex([(r[0], r[1]) for r in items.select(F.col("item_id").cast("long"), "text").collect()], shingle, threshold)
    shared = share(docs.sparkSession, index)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("containment", pa.float64()), ("n_shared", pa.int32()), ("n_item", pa.int32())]))

    def make(texts: list[str]) -> list[pa.Array]:
        worker_store("decontam")
        return [pa.array(shared().leaks(texts), kind)]

    return add_columns(docs, text, [T.StructField(into, LEAKS)], make, 3 << 19)


def _hashes(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc, size, largest, hash): distinct shingle hashes of every text in these sizes; ``largest`` is above the number
    of shingles of every text in its size partition."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            keys = b.column("doc").to_numpy(zero_copy_only=False)
            words = Words(texts_of(b))
            for size in sizes:
                h, who = words.shingles(size)
                pairs = np.unique(np.stack([who.astype(np.uint64), h], 1), axis=0)
                if len(pairs):
                    who = pairs[:, 0].astype(np.int64)
                    largest = 1 << (np.floor(np.log2(words.count[who] - size + 1)).astype(np.int64) + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[who]), pa.array(np.full(len(who), size), pa.int32()), pa.array(largest),
                                                      pa.array(pairs[:, 1].view(np.int64))], names=["doc", "size", "largest", "hash"])

    return texts.mapInArrow(lean(run), "doc bigint, size int, largest bigint, hash bigint")


def _sketches(items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(item, size, need, hash): the sketch of every item, under the length of its shingles."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            keys, words, rows = b.column("item").to_pylist(), Words(texts_of(b)), []
            for size in range(1, shingle + 1):
                h, who = words.shingles(size)
                mine = np.flatnonzero(words.count == size if size < shingle else words.count >= size)
                for m, lo, hi in zip(mine.tolist(), np.searchsorted(who, mine, "left").tolist(), np.searchsorted(who, mine, "right").tolist()):
                    own = np.unique(h[lo:hi])
                    need = need_of(len(own), threshold)
                    rows += [(keys[m], size, need, x) for x in own[:len(own) - need + 1].view(np.int64).tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                                 names=["item", "size", "need", "hash"])

    return items.mapInArrow(lean(run), "item bigint, size int, need bigint, hash bigint")


#: Rows over which the candidates of one document are dealt; its text goes with each.
SLOTS = 16


def _find_by_join(docs: DataFrame, items: DataFrame, shingle: int, threshold: float, text: str, into: str) -> DataFrame:
    """The same search where the items are too many to send: sketch rows and document shingles meet by hash within
    size partitions, and candidates are verified on the words of both texts.

    Documents are keyed by (doc_id, hash of the text), items by a hash of id and text; a repeated item row is told
    as often as it stands there."""
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.xxhash64(order_key("doc_id"), F.col("doc_id").isNull(), own)
    d = docs.select(key.alias("doc"), own.alias("text")).dropDuplicates(["doc"])
    i = (items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
         .groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
         .withColumn("item", F.xxhash64(order_key("item_id"), F.col("item_id").isNull(), F.col("text"))))
    sketch = _sketches(i.select("item", "text"), shingle, threshold)
    sizes = sorted(r[0] for r in sketch.select("size").distinct().collect())
    pairs = (_hashes(d, sizes).join(sketch, ["size", "hash"]).where(F.col("need") < F.col("largest")).select("doc", "item").distinct())
    tried = (pairs.join(i, "item").groupBy("doc", F.pmod("item", F.lit(SLOTS)).alias("slot"))
             .agg(F.collect_list(F.struct("item_id", "copies", F.col("text").alias("words"))).alias("tried")))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            out = []
            for t, some in zip(texts_of(b), b.column("tried").to_pylist()):
                ws, sets, found = WORD.findall(lowered(t)), {}, []
                for item in some:
                    wanted = shingle_set(item["words"], shingle)
                    size = len(next(iter(wanted)))
                    if size not in sets:
                        sets[size] = {tuple(ws[k:k + size]) for k in range(len(ws) - size + 1)}
                    both = len(wanted & sets[size])
                    if both >= need_of(len(wanted), threshold):
                        found += [(item["item_id"], both / len(wanted), both, len(wanted))] * item["copies"]
                out.append([dict(zip(("item_id", "containment", "n_shared", "n_item"), x)) for x in found])
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("containment", pa.float64()), ("n_shared", pa.int32()), ("n_item", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(out, kind)], names=["doc", "leaks"])

    found = d.join(tried, "doc").select("doc", "text", "tried").mapInArrow(lean(run), T.StructType([T.StructField("doc", T.LongType()), T.StructField("leaks", LEAKS)]))
    leaks = found.groupBy("doc").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    mine, doc, got = fresh(docs, "_key"), fresh(docs, "_doc"), fresh(docs, "_leaks")
    return (docs.withColumn(mine, key).join(leaks.select(F.col("doc").alias(doc), F.col("leaks").alias(got)), F.col(mine) == F.col(doc), "left")
            .select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(got), F.array().cast(LEAKS)).alias(into)))


def leak_pairs(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, containment, n_shared, n_item: one row for each item that a document contains."""
    return (find_leaks(docs.selectExpr("cast(doc_id as bigint) AS doc_id", "text"), items, **options)
            .select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that contain no item, with their columns."""
    found = fresh(docs, "leaks")
    return find_leaks(docs, items, into=found, **options).where(F.size(found) == 0).select(*[f"`{c}`" for c in docs.columns])
