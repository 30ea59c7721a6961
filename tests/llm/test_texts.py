"""Fingerprints, token counts, BPE, packing and toxicity against the libraries and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tests.llm.odd import ROWS, empty, odd, plain

from paritylab.llm import chunkbpe, packing, tokencount, toxicity, winnowing
from paritylab.llm.common import code_points, gram_hashes, spread_symbols

RNG = random.Random(4)
NOISE = ["".join(RNG.choice("ab 'srevd1\n é́Σ▁日   THE I'm<s>") for _ in range(RNG.randint(0, 250))) for _ in range(400)]
NOISE += ["", " ", "\n", "a" * 700, "the" * 300, "<|endoftext|>x<|startoftext|>", " " * 90 + "a", "ab" * 400, "<unk></s>", "\x00"]


def chosen_by_hand(text, k, w):
    if not text:
        return []
    if len(text) < k:
        return [0]
    h = gram_hashes(spread_symbols(code_points(text)), k).tolist()
    out = set()
    for i in range(max(1, len(h) - w + 1)):
        window = h[i:i + w]
        out.add(i + max(j for j, x in enumerate(window) if x == min(window)))
    return sorted(out)


@pytest.mark.parametrize("chunk", [1 << 21, 120])
def test_winnowing_chooses_the_rightmost_minimum_of_every_window(chunk):
    texts = ["".join(RNG.choice("ab") for _ in range(RNG.randint(0, 300))) for _ in range(150)] + ["a" * 200, "", "x"]
    for text, (hashes, positions) in zip(texts, winnowing.winnow(texts, 5, 8, chunk)):
        assert positions.tolist() == chosen_by_hand(text, 5, 8)
        assert len(hashes) == len(positions)


def test_short_texts_share_a_selection_with_their_edited_text(spark):
    rows = [(i, "".join(RNG.choice("abcdefgh ") for _ in range(30 + i))) for i in range(70)]
    assert all(r.near_edited > 0 for r in winnowing.edited_neighbours(plain(spark, rows)).collect())


def test_winnowing_guarantee():
    shared = "".join(RNG.choice("abcdefgh ") for _ in range(winnowing.K + winnowing.W - 1))
    for n in range(20):
        a, b = (RNG.choice("xyz") * RNG.randint(0, 90) + shared + RNG.choice("uvw") * RNG.randint(0, 90) for _ in range(2))
        (ha, _), (hb, _) = winnowing.winnow([a, b])
        assert set(ha.tolist()) & set(hb.tolist())


def edited_by_hand(rows):
    docs = sorted(((i if i is not None else -(1 << 63), t or "", i) for i, t in rows), key=lambda r: (r[0], r[1].encode()))
    out = []
    for (_, text, i), (_, after, _) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        p, e, n = (winnowing.winnow([x])[0][0] for x in (text, edited, after))
        same = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if len(x) or len(y) else 1.0
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), winnowing.fingerprint(p), winnowing.fingerprint(e),
                    same(p.tolist(), e.tolist()), same(p.tolist(), n.tolist())))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [ROWS, [(1, "only one text")], [(i * 3, f"text number {i} " * (i % 7)) for i in range(200)]])
def test_edited_neighbours(spark, rows):
    got = winnowing.edited_neighbours(plain(spark, rows)).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == edited_by_hand(rows)


def test_fingerprint_operator_keeps_columns(spark):
    got = winnowing.fingerprint_documents(odd(spark))
    assert set(odd(spark).columns) <= set(got.columns)
    assert got.count() == len(ROWS)
    assert winnowing.edited_neighbours(empty(spark)).count() == 0


def test_token_counts_are_those_of_the_library(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib, table = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.PairTable(path)
    want = [len(x) for x in lib.encode(NOISE)]
    assert tokencount.count_tokens(table, {}, NOISE) == want
    long = [t for t in NOISE if len(t) > 20]
    runs = [r for t in long for u in table.units.findall(" " + t) for r in table.runs(u.replace(" ", "▁")) if len(r) > 1]
    for r in runs[:200]:  # both ways of merging agree
        s = np.array([table.symbol[ord(c)] if ord(c) < len(table.symbol) and table.symbol[ord(c)] >= 0 else -1 - len(c.encode()) for c in r], np.int32)
        assert tokencount.merge_rounds(table, s[None, :])[0] == tokencount.merge_heap(table, s)
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.token_counts(odd(spark), path, limit=9).collect()}
    assert got == {(i, len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 9) for i, t in ROWS}
    assert tokencount.token_counts(empty(spark), path).count() == 0


@pytest.mark.parametrize(("span", "mean"), [(4, 7), (48, 1024)])
def test_chunked_encoding_is_exact(span, mean):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, coder = Tokenizer.from_file(path), chunkbpe.ChunkEncoder(path, span, mean)
    texts = NOISE + ["".join(RNG.choice(NOISE) for _ in range(40)) for _ in range(10)]
    for _ in range(2):  # the second time from the memo
        for text, (ids, shown, _, _) in zip(texts, coder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
            assert shown == coder.decode(ids) == lib.decode(lib.encode(text, add_special_tokens=False).ids, skip_special_tokens=False)


def test_chunk_cuts_depend_on_content_alone():
    shared = "".join(RNG.choice("abcdefgh ") for _ in range(3000))
    cuts = []
    for lead in ("", "something else "):
        text = lead + shared
        cuts.append({text[c - 30:c] for c in chunkbpe.chunk_ends(text, 16, 64)[:-1] if c - 30 >= len(lead)})
    assert cuts[0] == cuts[1] and len(cuts[0]) > 10


def test_encode_documents(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want = set()
    for i, t in ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {tuple(r)[:4] for r in chunkbpe.encode_documents(odd(spark), path).collect()} == want
    assert chunkbpe.encode_documents(empty(spark), path).count() == 0


def test_best_fit_decreasing():
    for capacity in (1, 7, 64):
        sizes = [RNG.randint(1, capacity) for _ in range(500)]
        rows = packing.best_fit_decreasing(sizes, capacity)
        assert sorted(i for r in rows for i in r) == list(range(500))
        open_rows = []  # by hand: the fullest row that still takes the item
        for s in sorted(sizes, reverse=True):
            fit = [r for r in open_rows if r >= s]
            if fit:
                open_rows.remove(min(fit))
            open_rows.append((min(fit) if fit else capacity) - s)
        assert sorted(capacity - sum(sizes[i] for i in r) for r in rows) == sorted(open_rows)


def test_packing_is_lossless(spark, tmp_path):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=packing._ranks(path), special_tokens={})
    rows = [(n, t) for n, (_, t) in enumerate(ROWS)]
    packed = packing.pack_documents(plain(spark, rows), path, public_tokenizers.PATTERN, 50256, row=256, pool=2000)
    packing.write_packed(packed, str(tmp_path / "packed"))
    got = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in packing.unpack_documents(spark, str(tmp_path / "packed")).collect()}
    assert got == {i: [*coder.encode_ordinary(t or ""), 50256] for i, t in rows}
    for r in spark.read.parquet(str(tmp_path / "packed")).collect():
        assert len(r.input_ids) == 512 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 256
        positions = packing.position_ids(r.cu_seqlens, 256)
        assert np.flatnonzero(positions == 0).tolist() == r.position_resets
    assert packing.pack_documents(empty(spark), path, public_tokenizers.PATTERN, 50256).count() == 0
    assert packing.pack_documents(odd(spark), path, public_tokenizers.PATTERN, 50256).count() > 0


def toxic_table(spark, n=360):
    words = ["lorem", "ipsum", "dolor", "amet", "tempor", "magna", "aliqua", "veniam", "nostrud", "labore", "culpa", "minim"]
    bad = ["scoundrel", "dimwit", "blockhead"]
    r = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        text = [r.choice(words) + r.choice(["", "s", "um"]) for _ in range(r.randint(5, 60))]
        for _ in range(2 if toxic else 0):
            w = r.choice(bad)
            at = r.randrange(len(w))  # a misspelling
            text.insert(r.randrange(len(text)), w[:at] + r.choice("xz1") + w[at + 1:] if i % 3 else w)
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return plain(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), labels


def test_toxicity_on_held_out_misspellings(spark):
    docs, labels, truth = toxic_table(spark)
    model = toxicity.train(docs, labels)
    score = {r.doc_id: r.toxicity for r in toxicity.score_documents(docs, model).collect()}
    held = [i for i, _, _ in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [(score[i] >= toxicity.THRESHOLD) == bool(truth[i][2]) for i in held]
    assert np.mean(right) > 0.9
    shuffled = labels.select("doc_id", "quality", (1 - labels.toxic).alias("toxic")).where(toxicity.remainder() == 1).unionAll(labels.where(toxicity.remainder() != 1))
    assert toxicity.train(docs, shuffled)[1] == model[1]  # held-out labels teach nothing


def test_toxicity_of_odd_rows(spark):
    docs, labels, _ = toxic_table(spark, 40)
    model = toxicity.train(docs, labels)
    got = toxicity.score_documents(odd(spark), model)
    assert got.columns == [c for c in odd(spark).columns if c != "toxicity"] + ["toxicity"]
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(0 <= r.toxicity <= 1 for r in rows)
    assert len({r.toxicity for r in rows if not (r.text or "").strip()}) == 1
    none = toxicity.train(docs, spark.createDataFrame([], labels.schema))
    assert none[1] == 0.0 and toxicity.score_documents(empty(spark), none).count() == 0
    odd_labels = spark.createDataFrame([(None, 1, 1), (3, 1, None), (99999, 1, 1), (3, 0, 7)], labels.schema)
    assert toxicity.train(docs, odd_labels)[1] == 0.0


def test_one_text_of_a_repeated_doc_id_reaches_the_driver(spark, monkeypatch):
    taught = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: taught.extend(zip(texts, labels)))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = [(i, f"text {i} {n:03d}") for i in ids for n in range(300 if i == ids[0] else 1)]
    toxicity.train(plain(spark, docs), spark.createDataFrame([(i, i % 2) for i in ids], "doc_id bigint, toxic int"))
    assert sorted(taught) == sorted((f"text {i} 000", i % 2) for i in ids)
