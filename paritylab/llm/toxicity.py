"""Toxicity: averaged subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams (with word marks) and of itself, all
hashed into one table, so an unseen misspelling shares most vectors with the word it stems from. A
window of ``WINDOW`` words is the mean of its words and goes through a linear softmax over two
classes. A document is as toxic as its most toxic window, in training too: after some rounds on
random windows each round takes every document's currently strongest window.

As the classifier is linear, a fitted model is one number for each n-gram bucket, and a bias.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritylab.llm.common import SENTINEL, add_columns, gram_hashes, sha256_hex, spread_symbols, worker_store

BUCKETS = 1 << 17
DIM = 12
GRAMS = (3, 4, 5)
WINDOW = 5
#: Rounds over the sample, or as many as make STEPS updates if that is more; the first eighth on random windows.
ROUNDS = 16
STEPS = 900
BATCH = 128
THRESHOLD = 0.7
#: Bound of the labelled sample: rows of each class, those with the smallest hash of doc_id.
MAX_TOXIC, MAX_CLEAN = 2000, 4000
MEMO = 300_000
MARKS = ".,;:!?\"'()[]{}<>|*%&#$@~`^_=+-/\\«»“”„‘’…–—¡¿"


def words_of(text: str) -> list[str]:
    return text.split()


def normal(word: str) -> str:
    return "\x02" + word.lower().strip(MARKS) + "\x03"


def subwords(words: list[str], block: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, start of each word's buckets) of normalized words: n-grams of the sizes GRAMS, and the word itself."""
    parts = [_subwords(words[lo:lo + block]) for lo in range(0, len(words), block)]
    base = np.cumsum([0, *(len(b) for b, _ in parts)])
    return np.concatenate([b for b, _ in parts]), np.concatenate([s + x for (_, s), x in zip(parts, base)])


def _subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    marked = [normal(w) for w in words]
    size = np.array([len(w) for w in marked])
    start = np.cumsum(size) - size
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(words)), size)
    room = size[owner] - (np.arange(len(codes)) - start[owner])  # characters to the word's end
    symbols = spread_symbols(codes)
    who, what = [np.arange(len(words))], []
    whole = np.empty(len(words), np.uint64)
    for n in np.unique(size):
        pick = np.flatnonzero(size == n)
        grams = gram_hashes(symbols, int(n))
        whole[pick] = grams[start[pick]] ^ (SENTINEL >> np.uint64(3))
    what.append(whole)
    for n in GRAMS:
        ok = np.flatnonzero(room >= n)
        grams = gram_hashes(symbols, n)
        who.append(owner[ok])
        what.append(grams[ok])
    owner, bucket = np.concatenate(who), (np.concatenate(what) % np.uint64(BUCKETS)).astype(np.int32)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.searchsorted(owner[order], np.arange(len(words)))


def word_scores(table: np.ndarray, bucket: np.ndarray, start: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Mean of the words' bucket numbers, a block of words at a time."""
    ends = np.append(start, len(bucket))
    out = [np.add.reduceat(table[bucket[ends[lo]:ends[hi]]], start[lo:hi] - ends[lo]) / np.diff(ends[lo:hi + 1])
           for lo in range(0, len(start), block) for hi in [min(len(start), lo + block)]]
    return np.concatenate(out)


def window_logits(scores: np.ndarray) -> np.ndarray:
    """Mean word score of every window; a short text is one window."""
    if len(scores) <= WINDOW:
        return np.array([scores.mean()]) if len(scores) else np.zeros(1)
    c = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    return (c[WINDOW:] - c[:-WINDOW]) / WINDOW


def fit(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """(number of each bucket, bias): logit of class 1 against class 0. Without both classes the bias is the prior."""
    y = np.array(labels, np.float64)
    rng = np.random.default_rng(seed)
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), prior
    index: dict[str, int] = {}
    flat, lens = [], []
    for t in texts:
        ws = words_of(t)
        flat.append(np.array([index.setdefault(w, len(index)) for w in ws], np.int32))
        lens.append(len(ws))
    flat, lens = np.concatenate(flat), np.array(lens)
    if not len(flat):
        return np.zeros(BUCKETS, np.float32), prior
    first = np.cumsum(lens) - lens
    bucket, start = subwords(list(index))
    count = np.diff(np.append(start, len(bucket)))
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight = rng.normal(0, 0.3, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_table, g_weight, g_bias = np.full(BUCKETS, 1e-6, np.float32), np.full((2, DIM), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    has = np.flatnonzero(lens)
    rounds = max(ROUNDS, STEPS * BATCH // max(1, 2 * len(has)))
    for turn in range(rounds):
        if turn < rounds // 8:
            doc = np.repeat(has, 8)
            at = (rng.random(len(doc)) * np.maximum(lens[doc] - WINDOW + 1, 1)).astype(np.int64)
        else:
            score = word_scores(table @ (weight[1] - weight[0]), bucket, start)
            top = np.array([int(np.argmax(window_logits(score[flat[first[d]:first[d] + lens[d]]]))) for d in has])
            clean = has[y[has] == 0]
            more = (rng.random(len(clean)) * np.maximum(lens[clean] - WINDOW + 1, 1)).astype(np.int64)
            doc, at = np.concatenate([has, clean]), np.concatenate([top, more])
        order = rng.permutation(len(doc))
        for lo in range(0, len(order), BATCH):
            d, a = doc[order[lo:lo + BATCH]], at[order[lo:lo + BATCH]]
            n = np.minimum(lens[d], WINDOW)
            row = np.repeat(np.arange(len(d)), n)
            word = flat[np.repeat(first[d] + a, n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]
            share = 1.0 / n[row] / count[word]
            c = count[word]
            own = np.repeat(np.arange(len(word)), c)
            b = bucket[np.repeat(start[word], c) + np.arange(len(own)) - np.repeat(np.cumsum(c) - c, c)]
            s, r = share[own].astype(np.float32), row[own]
            x = np.zeros((len(d), DIM), np.float32)
            np.add.at(x, r, table[b] * s[:, None])
            z = x @ weight.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(d)), y[d].astype(int)] -= 1
            p /= len(d)
            dx = p @ weight
            dw, db = p.T @ x, p.sum(0)
            uniq, inv = np.unique(b, return_inverse=True)
            g = np.zeros((len(uniq), DIM), np.float32)
            np.add.at(g, inv, dx[r] * s[:, None])
            g_table[uniq] += (g * g).mean(1)
            table[uniq] -= 0.3 * g / np.sqrt(g_table[uniq])[:, None]
            g_weight += dw * dw
            weight -= 0.1 * dw / np.sqrt(g_weight)
            g_bias += db * db
            bias -= 0.1 * db / np.sqrt(g_bias)
    return table @ (weight[1] - weight[0]), float(bias[1] - bias[0])


def score_texts(model: tuple[np.ndarray, float], memo: dict[str, float], texts: list[str]) -> np.ndarray:
    table, bias = model
    tokens = [words_of(t) for t in texts]
    fresh = list({w for ws in tokens for w in ws}.difference(memo))
    if len(memo) + len(fresh) > MEMO:
        memo.clear()
        fresh = list({w for ws in tokens for w in ws})
    if fresh:
        bucket, start = subwords(fresh)
        memo.update(zip(fresh, word_scores(table, bucket, start).tolist()))
    logits = [window_logits(np.fromiter(map(memo.__getitem__, ws), np.float64, len(ws))).max() for ws in tokens]
    return 1.0 / (1.0 + np.exp(-np.clip(np.array(logits) + bias, -50, 50)))


def remainder(col: str = "doc_id") -> Column:
    return F.crc32(F.col(col).cast("string")) % 3


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[np.ndarray, float]:
    """Fit on labelled documents outside the held-out third; at most ``max_toxic`` and ``max_clean`` label rows,
    those of smallest hash, so the sample is the same wherever it is drawn. Rows with a null id, label or text
    teach nothing. A doc_id with several labels counts as toxic if one says so; of several texts the least is taken,
    so no more than these rows reach the driver."""
    rows = (labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(remainder() != 1)
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id")))
    some = (rows.where("toxic = 1").orderBy("h", "doc_id").limit(max_toxic)
            .unionAll(rows.where("toxic = 0").orderBy("h", "doc_id").limit(max_clean)))
    text = docs.where("text IS NOT NULL").select("doc_id", "text")
    got = (text.join(F.broadcast(some), "doc_id")  # at most max_toxic + max_clean rows of two numbers
           .groupBy("h", "doc_id", "toxic").agg(F.min("text").alias("text")).collect())
    got.sort(key=lambda r: (r["h"], r["doc_id"]))
    return fit([r["text"] for r in got], [r["toxic"] for r in got])


def score_documents(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with ``into`` (0 to 1); a column of that name is replaced. Null texts are empty, and an empty
    text has the score of the bias alone. A narrow pass in bounded slices."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats, whatever the input
    tag = sha256_hex(model[0].tobytes() + str(model[1]).encode())

    def make(texts: list[str]) -> list[pa.Array]:
        store = worker_store("toxicity")
        if store.get("model") != tag:
            store["model"], store["memo"] = tag, {}
        return [pa.array(score_texts(shared.value, store["memo"], texts), pa.float64())]

    return add_columns(docs, text, [T.StructField(into, T.DoubleType())], make, 2 << 20)
