"""Alignment of two tokenizers against a brute-force alignment by the libraries, text by text."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tests.llm.odd import empty, odd, plain
from tokenizers import Tokenizer

from paritylab.llm import alignment

A_FILE, B_FILE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "  ", "a", "hello world", "  two  blanks ", "tabs\tand\nlines \n x", "it's we'll <|endoftext|> </s> <s>", "日本語 テキスト", "▁ marked", "x▁y z", "a b c d",
         "\x00 nul \x1c x", "naïve café — “quotes” …", "😀😀 👩‍👩‍👧 z", "1234567890 12 3 4,567.89", "word " * 300, "ab" * 3000, "ſtrange K", "é é é", "trailing ", "\n\nstart", "a  b   c",
         "ــ عربى", "𝔘𝔫𝔦 \U0010ffff", "\x85x \x85 y"]


def by_hand(texts):
    a, b = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    a.encode_special_tokens = True
    symbols, tokens = alignment.byte_of_symbol(), {i: t for t, i in a.get_vocab().items()}
    links, rows = [], []
    for t in texts:
        x = a.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        y = b.encode(t) if t else []
        xs = [bytes(symbols[c] for c in tokens[i]) for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if not t or b"".join(xs) != (" " + t).encode() or b"".join(ys) != (" " + t).encode():
            links.append([])
            rows.append((0, 0, 0, ""))
            continue
        xe, ye = np.cumsum([len(v) for v in xs]).tolist(), np.cumsum([len(v) for v in ys]).tolist()
        own, j0 = [], 0
        for i, end in enumerate(xe):
            begin = xe[i - 1] if i else 0
            while ye[j0] <= begin:
                j0 += 1
            j = j0
            while j < len(ye) and (ye[j - 1] if j else 0) < end:
                own.append((x[i], y[j]))
                j += 1
        links.append(own)
        cuts, groups, i0, k0 = sorted(set(xe) & set(ye)), [], 0, 0
        for c in cuts:
            i1, k1 = xe.index(c, i0) + 1, ye.index(c, k0) + 1
            groups.append(",".join(map(str, x[i0:i1])) + "|" + ",".join(map(str, y[k0:k1])))
            i0, k0 = i1, k1
        rows.append((len(x), len(y), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(p for own in links for p in own)
    top = Counter()
    for (_, b_id), n in count.items():
        top[b_id] = max(top[b_id], n)
    return [(na, nb, ng, len(own), sum(count[p] == top[p[1]] for p in own), sum(count[p] for p in own), sha)
            for (na, nb, ng, sha), own in zip(rows, links)]


def check(spark, texts):
    docs = plain(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in alignment.align(docs, A_FILE, B_FILE).collect()}
    want = by_hand(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w, (i, texts[i])


def test_alignment_equals_brute_force(spark):
    rng = random.Random(5)
    invented = ["".join(rng.choice("abcdeéß \n\t.,'-▂日0123  ") for _ in range(rng.randint(1, 400))) for _ in range(150)]
    check(spark, TEXTS + invented + TEXTS[5:12])


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_UNITS", 3)
    check(spark, TEXTS * 3)


def test_gallop_is_a_left_search():
    rng = np.random.default_rng(1)
    for _ in range(50):
        ends = np.unique(rng.integers(0, 1000, rng.integers(1, 200)))
        needles = np.sort(rng.integers(0, ends[-1] + 1, 50))
        n = len(needles)
        assert (alignment.gallop(needles, np.zeros(n, np.int64), ends, np.full(n, len(ends))) == np.searchsorted(ends, needles)).all()


def test_groups_come_on_request_and_odd_tables_pass(spark):
    rows = alignment.align(odd(spark), A_FILE, B_FILE, with_groups=True).collect()
    assert len(rows) == odd(spark).count()
    for r in rows:
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
        assert (r.n_groups == 0) == (r.groups == "")
    assert alignment.align(empty(spark), A_FILE, B_FILE).collect() == []


def test_a_vocabulary_across_spaces_is_refused(monkeypatch):
    class Fake:
        is_byte = is_control = staticmethod(lambda i: False)
        get_piece_size = staticmethod(lambda: 1)
        id_to_piece = staticmethod(lambda i: "a▁b")
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", lambda model_file: Fake)
    with pytest.raises(ValueError):
        alignment.Pieces("x")
