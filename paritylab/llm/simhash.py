"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked at few differing bits.

Pairs are found with pivot distance tables: every fingerprint's Hamming distances to ``PIVOTS``
reference fingerprints are computed first; by the triangle inequality a pair whose distances to any
one reference differ by more than the limit cannot link, so pairs are discarded by their maximum
coordinate difference and only the survivors are compared bit by bit.

Which fingerprints meet at all is decided exactly and without all pairs: 64 bits are cut into blocks;
two fingerprints that differ in at most ``limit`` bits agree in all but ``limit`` blocks, so each is
dealt to one key per choice of agreeing blocks. (Pivot distances alone make no such key: for spread
64-bit fingerprints a reference keeps 57 % of all pairs.) A task keeps a spanning forest of the links
it finds, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritylab.llm.common import add_columns, cut_lineage, fresh, lean, partitions, worker_store

SHINGLE = 4
LIMIT = 4
SEED = 42
PIVOTS = 24
#: Members of a key that are compared in one go; larger keys are split by their other bits first.
RUN = 512
LAST = (1 << 63) - 1


def simhash(text: str, shingle: int = SHINGLE) -> int:
    """Bit b is 1 if it is set in over half of the shingles' XXH64 values; 0 for a text without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and blanks of ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    digest, last = xxhash.xxh64_intdigest, ends[shingle - 1:] or ends[-1:]
    total, ones = len(last), np.zeros(64, np.int64)
    for lo in range(0, total, 1 << 15):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[lo:lo + (1 << 15)], last[lo:lo + (1 << 15)])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > total).tolist())


def fingerprint_documents(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", into: str = "simhash") -> DataFrame:
    """``docs`` with ``into`` (a long holding the 64 bits); a column of that name is replaced. Null texts are empty."""
    def make(texts: list[str]) -> list[pa.Array]:
        worker_store("simhash")
        return [pa.array(np.array([simhash(t, shingle) for t in texts], np.uint64).astype(np.int64))]

    return add_columns(docs, text, [T.StructField(into, T.LongType())], make)


def block_masks(limit: int, blocks: int) -> list[int]:
    """One mask for every choice of ``blocks - limit`` blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    ones = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(ones, blocks - limit)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class PivotTable:
    """Distances to the references, the discard by maximum coordinate difference, and the last check."""

    def __init__(self, limit: int, pivots: int = PIVOTS):
        self.limit = limit
        self.refs = np.random.default_rng(64).integers(0, 1 << 64, pivots, dtype=np.uint64)

    def distances(self, prints: np.ndarray) -> np.ndarray:
        return np.bitwise_count(prints[:, None] ^ self.refs[None, :]).astype(np.int8)

    def verified(self, prints: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs (i, j) those that link; ``rows``: the table of ``prints``."""
        for lo in range(0, rows.shape[1], 6):  # few references discard most pairs
            keep = np.abs(rows[i, lo:lo + 6] - rows[j, lo:lo + 6]).max(1) <= self.limit
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(prints[i] ^ prints[j]) <= self.limit
        return i[keep], j[keep]


def find_links(table: PivotTable, prints: np.ndarray, free: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among distinct fingerprints that agree in all bits but ``free``. A large set is split again by
    the free bits: cut into limit + 1 parts, linked fingerprints agree in one part at least."""
    n, parts = len(prints), table.limit + 1
    if n > RUN and len(free) >= 2 * parts:
        for k in range(parts):
            own = free[k * len(free) // parts:(k + 1) * len(free) // parts]
            key = prints & np.uint64(sum(1 << b for b in own))
            order = np.argsort(key, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0, True])
            rest = [b for b in free if b not in own]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a > 1:
                    yield from find_links(table, prints[order[a:b]], rest)
        return
    order = np.argsort(table.distances(prints)[:, 0], kind="stable")
    prints = prints[order]
    rows = table.distances(prints)
    ends = np.searchsorted(rows[:, 0], rows[:, 0] + table.limit, side="right")
    for lo in range(0, n, RUN):
        at = np.arange(lo, min(n, lo + RUN))
        more = ends[at] - at - 1
        i = np.repeat(at, more)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more) - more, more)
        i, j = table.verified(prints, rows, i, j)
        yield prints[i], prints[j]


class Forest:
    """Union-find over fingerprints; gives one edge for each member but the least of its tree."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent
        while p.setdefault(x, x) != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.parent) if (r := self.root(x)) != x]


def link_forest(prints: DataFrame, limit: int = LIMIT, blocks: int = 6) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints (column ``simhash``) like their links do."""
    masks = block_masks(limit, blocks)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("simhash").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks)])
    dealt = prints.select("simhash", F.posexplode(keys).alias("choice", "key"))
    free = [[b for b in range(64) if not m >> b & 1] for m in masks]
    parts = partitions(prints.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        worker_store("simhash")
        table, forest = PivotTable(limit), Forest()

        def add(a: np.ndarray, b: np.ndarray):
            for x, y in zip(a.astype(np.int64).tolist(), b.astype(np.int64).tolist()):
                forest.link(x, y)

        def process(key: np.ndarray, choice: np.ndarray, fp: np.ndarray):
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            size = np.diff(cuts)
            for c in np.flatnonzero(size > 32):
                for a, b in find_links(table, fp[cuts[c]:cuts[c + 1]], free[choice[cuts[c]]]):
                    add(a, b)
            small = np.repeat((size > 1) & (size <= 32), size)
            key, fp = key[small], fp[small]
            rows = table.distances(fp)
            for step in range(1, 32):
                i = np.flatnonzero(key[:-step] == key[step:]) if len(key) > step else np.zeros(0, int)
                if not len(i):
                    break
                i, j = table.verified(fp, rows, i, i + step)
                add(fp[i], fp[j])

        kept: list[list[np.ndarray]] = [[], [], []]
        for b in batches:
            cols = [b.column(n).to_numpy(zero_copy_only=False) for n in ("key", "choice", "simhash")]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on in the next batch
            if last or (kept[0] and kept[0][0][0] != cols[0][0]):
                cut = last if last else 0
                whole = [np.concatenate([*k, c[:cut]]) for k, c in zip(kept, cols)]
                if len(whole[0]):
                    process(whole[0], whole[1], whole[2].astype(np.uint64))
                kept = [[c[cut:]] for c in cols]
            else:
                for k, c in zip(kept, cols):
                    k.append(c)
        if kept[0]:
            whole = [np.concatenate(k) for k in kept]
            process(whole[0], whole[1], whole[2].astype(np.uint64))
        edges = forest.edges()
        for lo in range(0, len(edges), 1 << 16):
            u, v = zip(*edges[lo:lo + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return (dealt.repartition(parts, "key").sortWithinPartitions("key", "simhash")
            .mapInArrow(lean(run), "u bigint, v bigint"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of every node that has an edge.

    Alternating large-star and small-star steps (Kiveris et al., 2014); a node's neighbours are never
    gathered, only their minimum. Every round is cut by a reliable checkpoint."""
    e = cut_lineage(edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct())
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return e.selectExpr("u AS node", "v AS root")
        seen = state
        both = e.unionAll(e.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").selectExpr("v AS u", "m AS v").unionAll(least.selectExpr("u", "m AS v"))
        e = cut_lineage(small.where("u <> v").distinct())


def near_duplicates(prints: DataFrame, limit: int = LIMIT, blocks: int = 6) -> DataFrame:
    """(simhash, component_id, first_id, first_simhash) of every distinct fingerprint of ``prints`` (doc_id, simhash).

    component_id is the smallest doc_id reachable; null ids sort last, so it is null only where all are.
    (first_id, first_simhash) name the row of the component that stays: its smallest doc_id (null as the
    largest long) and, for equal ids, the smallest fingerprint. Copies meet as one fingerprint before any
    pair is formed. The block count grows with the number of fingerprints so that keys stay small: the plan
    changes, the links do not."""
    classes = cut_lineage(prints.groupBy("simhash").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("least")))
    n = classes.count()
    while 64 * (1 << round(64 / blocks * (blocks - limit))) < n and blocks < 9:
        blocks += 1
    roots = components(link_forest(classes.select("simhash"), limit, blocks))
    labelled = (classes.join(roots, classes.simhash == roots.node, "left")
                .select("simhash", "least", F.coalesce("root", "simhash").alias("root")))
    first = labelled.groupBy("root").agg(F.min(F.struct("least", "simhash")).alias("f"))
    return (labelled.join(first, "root")
            .select("simhash", F.nullif(F.col("f.least"), F.lit(LAST)).alias("component_id"),
                    F.col("f.least").alias("first_id"), F.col("f.simhash").alias("first_simhash")))


def document_components(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row. An empty table gives no rows."""
    prints = cut_lineage(fingerprint_documents(docs.select("doc_id", "text"), shingle).select("doc_id", "simhash"))
    groups = near_duplicates(prints, limit).select("simhash", "component_id")
    return prints.join(groups, "simhash").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """One document of each component stays, with all its columns: the one with the smallest doc_id.

    Of rows with the same doc_id and fingerprint one stays."""
    least, mark, parts = fresh(docs, "_least"), fresh(docs, "simhash"), partitions(docs.sparkSession)
    marked = fingerprint_documents(docs, shingle, into=mark).withColumn(least, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
    ids = fingerprint_documents(docs.select("doc_id", "text"), shingle).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "simhash")
    stay = near_duplicates(cut_lineage(ids), limit).select(F.col("first_id").alias(least), F.col("first_simhash").alias(mark)).distinct()
    return (marked.repartition(parts, least, mark).join(stay, [least, mark], "left_semi")
            .dropDuplicates([least, mark]).select(*[f"`{c}`" for c in docs.columns]))
