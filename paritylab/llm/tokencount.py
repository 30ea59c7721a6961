"""Token counts of a sentencepiece BPE vocabulary by rank-synchronous array merging.

Texts are cut where no vocabulary piece reaches across; the pre-tokens that a worker has not met
yet are held as ragged numpy arrays, grouped by length, and in every round each of them takes its
own lowest-rank pair (leftmost on ties) at the same time. What survives is counted: one token for
a piece, one per UTF-8 byte for a character outside the vocabulary.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paritylab.llm.common import lean, slices, texts_of, worker_store

SPACE = "▁"
#: Longer runs take their pairs one after another from a heap, in the same order: a round
#: costs the run's length, so rounds over one long run would cost its square.
LONG_RUN = 96
#: Distinct pre-tokens that a worker remembers; the memo starts anew when it is full.
MEMO = 400_000
NO_PAIR = np.int32(2 ** 31 - 1)


class PairTable:
    """Vocabulary pieces, and for every pair of symbols that joins to a piece its rank and the piece."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        scores, ids = {}, {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                scores[sp.id_to_piece(i)] = sp.get_score(i)
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        for piece in scores:
            ids[piece] = len(ids)
        self.n_pieces = len(ids)
        for ch in sorted({c for p in scores for c in p}):  # characters that occur in pieces only
            ids.setdefault(ch, len(ids))
        found = []
        for piece, score in scores.items():
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                if a is not None and b is not None:
                    found.append((a << 20 | b, order[score], ids[piece]))
        found.sort()
        self.key = np.array([f[0] for f in found] or [-1], np.int64)
        self.rank = np.array([f[1] for f in found] or [NO_PAIR], np.int32)
        self.joined = np.array([f[2] for f in found] or [0], np.int32)
        self.chars = {p: i for p, i in ids.items() if len(p) == 1}
        self.bigrams = {p[i:i + 2] for p in scores for i in range(len(p) - 1)}
        if any(b[0] != SPACE and b[1] == SPACE for b in self.bigrams):
            raise ValueError("the vocabulary has pieces that run across a space")
        # Spaces belong to the word behind them; a line break that is in no piece stands alone.
        self.units = re.compile(" *[^ ]+| +" if "\n" in self.chars else " *[^ \n]+| +|\n")
        self.cost = np.ones(len(ids), np.int32)  # tokens of a symbol that survives
        for ch, i in self.chars.items():
            if i >= self.n_pieces:
                self.cost[i] = len(ch.encode())
        top = max(map(ord, self.chars), default=0) + 1
        self.symbol = np.full(top, -1, np.int32)
        for ch, i in self.chars.items():
            self.symbol[ord(ch)] = i

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair (NO_PAIR if it joins to nothing)."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (a >= 0) & (b >= 0), self.rank[at], NO_PAIR)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.joined[np.searchsorted(self.key, a.astype(np.int64) << 20 | b)]

    def runs(self, unit: str) -> list[str]:
        """Cut a unit wherever its two neighbouring characters stand together in no piece."""
        out, lo = [], 0
        for i in range(1, len(unit)):
            if unit[i - 1:i + 1] not in self.bigrams:
                out.append(unit[lo:i])
                lo = i
        out.append(unit[lo:])
        return out


def merge_rounds(table: PairTable, symbols: np.ndarray) -> np.ndarray:
    """``symbols``: sequences of one length as rows. Tokens that are left of each row."""
    n, length = symbols.shape
    out = np.zeros(n, np.int64)
    row, s = np.arange(n), symbols.copy()
    alive = np.full(n, length)
    rank = table.look(s[:, :-1], s[:, 1:]) if length > 1 else np.zeros((n, 0), np.int32)
    while len(row):
        best = rank.argmin(1) if rank.shape[1] else np.zeros(len(row), int)
        ends = (rank[np.arange(len(row)), best] == NO_PAIR) if rank.shape[1] else np.ones(len(row), bool)
        if ends.any():
            left = np.where(s[ends] >= 0, table.cost[np.maximum(s[ends], 0)], -1 - s[ends])
            live = np.arange(s.shape[1])[None, :] < alive[ends][:, None]
            out[row[ends]] = (left * live).sum(1)
            go = ~ends
            row, s, rank, best, alive = row[go], s[go], rank[go], best[go], alive[go]
            if not len(row):
                break
        at = np.arange(len(row))
        width = s.shape[1]
        s[at, best] = table.join(s[at, best], s[at, best + 1])
        cols = np.arange(width - 1)[None, :]
        shift = cols > best[:, None]
        s = np.where(shift, s[:, 1:], s[:, :-1])
        alive = alive - 1
        # Pairs right of the merge move one place; the pairs beside it are looked up anew.
        rank = np.where(cols[:, :-1] >= best[:, None], rank[:, 1:], rank[:, :-1])
        has_left, has_right = best > 0, best < alive - 1
        i, b = at[has_left], best[has_left]
        rank[i, b - 1] = table.look(s[i, b - 1], s[i, b])
        i, b = at[has_right], best[has_right]
        rank[i, b] = table.look(s[i, b], s[i, b + 1])
        i, b = at[~has_right], best[~has_right]
        inner = b < rank.shape[1]
        rank[i[inner], b[inner]] = NO_PAIR
    return out


def merge_heap(table: PairTable, symbols: np.ndarray) -> int:
    """The same merges for one long run, from a heap of (rank, position)."""
    s = symbols.tolist()
    n = len(s)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    first = table.look(symbols[:-1], symbols[1:])
    heap = [(int(first[i]), i, s[i], s[i + 1]) for i in np.flatnonzero(first != NO_PAIR)]
    heapq.heapify(heap)
    dead = bytearray(n)
    memo: dict = {}

    def pair(a, b):
        if (a, b) not in memo:
            x, y = np.array([a], np.int32), np.array([b], np.int32)
            r = int(table.look(x, y)[0])
            memo[a, b] = (r, int(table.join(x, y)[0]) if r != NO_PAIR else -1)
        return memo[a, b]

    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if dead[i] or s[i] != a or j >= n or s[j] != b:
            continue
        s[i] = pair(a, b)[1]
        dead[j] = 1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0 and (x := pair(s[before[i]], s[i]))[0] != NO_PAIR:
            heapq.heappush(heap, (x[0], before[i], s[before[i]], s[i]))
        if after[i] < n and (x := pair(s[i], s[after[i]]))[0] != NO_PAIR:
            heapq.heappush(heap, (x[0], i, s[i], s[after[i]]))
    return sum(int(table.cost[x]) if x >= 0 else -1 - x for x, d in zip(s, dead) if not d)


def count_units(table: PairTable, units: list[str]) -> np.ndarray:
    """Tokens of each unit (spaces already escaped)."""
    runs, owner = [], []
    for i, u in enumerate(units):
        parts = table.runs(u)
        runs.extend(parts)
        owner.extend([i] * len(parts))
    if not runs:
        return np.zeros(len(units), np.int64)
    size = np.array([len(r) for r in runs])
    codes = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), "<u4")
    known = codes < len(table.symbol)
    flat = np.where(known, table.symbol[np.where(known, codes, 0)], -1).astype(np.int32)
    foreign = flat < 0  # such a character counts its UTF-8 bytes, held as -1 - bytes
    c = codes[foreign]
    flat[foreign] = -1 - (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)).astype(np.int32)
    start = np.concatenate([[0], np.cumsum(size)])
    counts = np.zeros(len(runs), np.int64)
    for length in np.unique(size):
        mine = np.flatnonzero(size == length)
        if length > LONG_RUN:
            for i in mine:
                counts[i] = merge_heap(table, flat[start[i]:start[i + 1]])
            continue
        for lo in range(0, len(mine), 1 << 15):
            some = mine[lo:lo + (1 << 15)]
            counts[some] = merge_rounds(table, flat[start[some][:, None] + np.arange(length)[None, :]])
    return np.bincount(np.array(owner), weights=counts, minlength=len(units)).astype(np.int64)


def count_tokens(table: PairTable, memo: dict[str, int], texts: list[str]) -> list[int]:
    """Tokens of each text, as the library counts them without begin and end tokens."""
    units = [table.units.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
    fresh = list({u for us in units for u in us}.difference(memo))
    if len(memo) + len(fresh) > MEMO:
        memo.clear()
        fresh = list({u for us in units for u in us})
    memo.update(zip(fresh, count_units(table, [u.replace(" ", SPACE) for u in fresh]).tolist()))
    return [sum(map(memo.__getitem__, us)) for us in units]


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every document. Null texts are empty.

    ``model_file`` is a sentencepiece BPE model with byte fallback, identity normalization and a leading
    space, present on every executor. A narrow pass: no shuffle, memory bounded by the Arrow slice."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        store = worker_store("counts")
        if ("pairs", model_file) not in store:
            store["pairs", model_file] = PairTable(model_file)
        table, memo = store["pairs", model_file], store.setdefault(("memo", model_file), {})
        for b in slices(batches, text):
            texts = texts_of(b, text)
            tokens = count_tokens(table, memo, texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                 pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return (docs.selectExpr("cast(doc_id as bigint) AS doc_id", f"`{text}`")
            .mapInArrow(lean(run), "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"))
