"""Importance resampling against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from tests.llm.odd import ROWS, empty, odd, plain

from paritylab.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RNG = random.Random(12)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def feats(text, longest):
    words = WORD.findall(lower(text))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def by_hand(docs, target, buckets, longest, percent, least):
    def count(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in feats(t, longest)[1])

    s, t = count(x for _, x in docs), count(target)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = {}
    for i, text in docs:
        n, f = feats(text, longest)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n]
    long = sorted((i for i in out if out[i][3] >= least), key=lambda i: (-out[i][2], i))
    ranks = {i: r + 1 for r, i in enumerate(long[:percent * len(long) // 100])}
    return {i: (v[0], v[1], v[2], ranks.get(i)) for i, v in out.items()}


def corpus():
    words = ["Alpha", "beta", "GAMMA", "délta", "Éa", "日本", "x9", "42", "ǅ", "İi", "ſ", "don't", "a_b", "\x00z", "end."]
    gaps = [" ", " ", "  ", "\n", ", ", "-", "\t"]
    docs = [(i * 7 % 211 - 20, "".join(RNG.choice(words) + RNG.choice(gaps) for _ in range(RNG.randint(0, 60)))) for i in range(200)]
    return docs + [(5000, ""), (5001, None), (5002, "..."), (5003, "word " * 5000)]


def test_resampling_equals_brute_force(spark):
    docs, target = corpus(), ["alpha beta délta", "42 42 日本 x9", "", None]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    for buckets, longest, percent, least in ((10_000, 1, 10, 20), (97, 3, 50, 1), (70_000, 2, 100, 0)):
        got = resampling.resample(plain(spark, docs), bench, buckets, longest, 2024, percent, least).collect()
        assert {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in got} == by_hand(docs, target, buckets, longest, percent, least)


def test_offsets_hold_the_words():
    text = resampling.lowered("Àb Cd,e\x00F é9日")
    got = resampling.splitter().pre_tokenize_str(text)
    assert [text[a:b] for _, (a, b) in got] == [w for w, _ in got] == WORD.findall(lower("Àb Cd,e\x00F é9日"))


def test_equal_scores_go_by_id_and_repeats_have_ranks_of_their_own(spark):
    docs = [(3, "one two three four")] * 4 + [(None, "one two three four")] + [(2, "one two three four")]
    bench = spark.createDataFrame([("one",)], "text string")
    got = resampling.resample(plain(spark, docs), bench, percent=100, least_words=1).collect()
    assert sorted(r.rank for r in got) == [1, 2, 3, 4, 5, 6] and len({r.score for r in got if r.doc_id == 3}) == 1


def test_odd_and_empty_tables(spark):
    bench = spark.createDataFrame([("alpha",)], "text string")
    assert len(resampling.resample(odd(spark), bench).collect()) == len(ROWS)
    assert resampling.resample(empty(spark), bench).collect() == []
    none = bench.limit(0)
    got = resampling.resample(plain(spark, [(1, "alpha"), (2, None)]), none, percent=100, least_words=0).collect()
    assert sorted(r.rank for r in got) == [1, 2]


def test_gains_of_equal_corpora_are_zero():
    counts = np.array([3, 0, 7])
    assert resampling.log_gains(counts, counts).tolist() == [0, 0, 0]
