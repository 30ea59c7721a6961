"""Repeats, SimHash, licences, decontamination and WARC against brute force."""

import hashlib
import random
from base64 import b32encode

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tests.llm.odd import ROWS, empty, odd, plain

from paritylab.llm import decontam, licenses, repeats, simhash, warc

RNG = random.Random(9)


def invent(n, alphabet="abcdé "):
    return "".join(RNG.choice(alphabet) for _ in range(n))


# --- exact substring dedup ---------------------------------------------------

def passages():
    base, docs = [invent(400) for _ in range(6)], []
    for i in range(150):
        text = ""
        for _ in range(RNG.randint(0, 4)):
            p, a = RNG.choice(base), RNG.randint(0, 300)
            text += p[a:a + RNG.randint(20, 300)] + RNG.choice(["", invent(RNG.randint(0, 30)), "a" * RNG.randint(0, 250), "ab" * RNG.randint(0, 90)])
        docs.append((i * 8 % 151 - 5, text))
    return docs + [(1000 + i, base[0]) for i in range(4)] + [(2000, ""), (2001, None), (2002, "x" * 99), (2003, "x" * 100), (2004, "x" * 101)]


def cut_by_hand(docs, least=100):
    seen, out = set(), {}
    for i, text in sorted(docs):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - least + 1):
            if raw[s:s + least] in seen:
                gone[s:s + least] = True
            seen.add(raw[s:s + least])
        edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[i] = (len(raw), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("huge", "piece"), [(10_000, 1 << 20), (15, 1 << 20), (10_000, 300)])
def test_removal_equals_brute_force(spark, monkeypatch, huge, piece):
    monkeypatch.setattr(repeats, "HUGE", huge)
    monkeypatch.setattr(repeats, "PIECE", piece)
    docs = passages()
    assert {r[0]: tuple(r)[1:] for r in repeats.removal_report(plain(spark, docs)).collect()} == cut_by_hand(docs)


@pytest.mark.parametrize(("huge", "batch"), [(10_000, 4096), (15, 10)])
def test_small_slices_of_suffixes_and_salted_windows_give_the_same(spark, monkeypatch, huge, batch):
    monkeypatch.setattr(repeats, "HUGE", huge)
    monkeypatch.setattr(repeats, "BATCH", batch)
    monkeypatch.setattr(repeats, "SUFFIX_BYTES", 3000)
    monkeypatch.setattr(repeats, "SENT", 0)
    docs = passages()
    assert {r[0]: tuple(r)[1:] for r in repeats.removal_report(plain(spark, docs)).collect()} == cut_by_hand(docs)


def test_rows_without_an_id_and_of_one_id_go_by_their_texts(spark):
    texts = list({t for _, t in passages() if t})
    for number in (None, 7):
        table = plain(spark, [(number, t) for t in texts])
        order = [r.text for r in table.orderBy(F.xxhash64("text").bitwiseAND(0x7FFFFFFF)).collect()]
        got = sorted(tuple(r)[1:] for r in repeats.removal_report(table).collect())
        assert got == sorted(cut_by_hand(list(enumerate(order))).values())


def test_repeat_groups_hold_all_occurrences(spark):
    docs = dict(passages())
    groups: dict = {}
    for r in repeats.repeat_groups(plain(spark, list(docs.items()))).collect():
        groups.setdefault((r.group_id, r.length), []).append(r)
    assert len(groups) > 20
    for (_, length), rows in groups.items():
        strings = {(docs[r.doc_id] or "").encode()[r.start:r.start + length] for r in rows}
        assert len(strings) == 1 and len(rows) > 1
        assert [r for r in rows if r.earliest] == [min(rows, key=lambda r: (r.doc_id, r.start))]


def places_by_hand(docs, string):
    out = set()
    for i, text in docs.items():
        raw, at = (text or "").encode(), -1
        while (at := raw.find(string, at + 1)) >= 0:
            out.add((i, at))
    return out


def whole_groups(spark, docs, least=100):
    """Groups by id, after a check that each is one string with every place where it stands."""
    groups: dict = {}
    for r in repeats.repeat_groups(plain(spark, list(docs.items()))).collect():
        groups.setdefault(r.group_id, []).append(r)
    covered: dict = {}
    for rows in groups.values():
        length = rows[0].length
        string = docs[rows[0].doc_id].encode()[rows[0].start:rows[0].start + length]
        assert {r.length for r in rows} == {length} and len(string) == length >= least
        places = places_by_hand(docs, string)
        assert sorted((r.doc_id, r.start) for r in rows) == sorted(places) and len(places) > 1
        assert [(r.doc_id, r.start) for r in rows if r.earliest] == [min(places)]
        for k in range(length - least + 1):
            covered.setdefault(string[k:k + least], set()).update((i, s + k) for i, s in places)
    windows: dict = {}
    for i, text in docs.items():
        raw = (text or "").encode()
        for s in range(len(raw) - least + 1):
            windows.setdefault(raw[s:s + least], set()).add((i, s))
    assert covered == {w: p for w, p in windows.items() if len(p) > 1}
    return groups


def copied_contexts():
    shared, a, b = invent(120), invent(60), invent(60)
    return {1: a + shared + a, 2: a + shared + a, 3: "x" + a + shared + a, 4: b + shared + b, 5: b + shared + b, 6: shared, 7: shared, 8: invent(130)}


def test_repeat_groups_tell_copies_of_a_context(spark):
    docs = copied_contexts()
    groups = whole_groups(spark, docs)
    assert any({r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7} and rows[0].length >= 100 for rows in groups.values())


@pytest.mark.parametrize(("huge", "batch"), [(10_000, 4096), (15, 4096), (3, 6)])
def test_repeat_groups_equal_brute_force(spark, monkeypatch, huge, batch):
    monkeypatch.setattr(repeats, "HUGE", huge)
    monkeypatch.setattr(repeats, "BATCH", batch)
    assert len(whole_groups(spark, dict(passages()))) > 20
    whole_groups(spark, copied_contexts())


def test_contexts_of_a_hot_gram_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HUGE", 15)
    monkeypatch.setattr(repeats, "BATCH", 40)
    passage = invent(300)
    docs = [(i, invent(150) + passage + invent(150)) for i in range(120)]
    keyed, dealt = repeats._dealt(plain(spark, docs), "text", 8)
    found = repeats.written(repeats.meet(repeats.anchor_blocks(keyed, "text", 8, 100, False), 8, False))
    contexts, hot = repeats.met_contexts(found, dealt, 8)
    grams: dict = {}
    for grp, part, n in contexts.groupBy("grp", F.spark_partition_id()).count().collect():
        grams.setdefault(grp, []).append(n)
    most = max(grams.values(), key=sum)
    assert hot and sum(most) > 100 and max(most) < sum(most) / 2
    assert {r[0]: tuple(r)[1:] for r in repeats.removal_report(plain(spark, docs)).collect()} == cut_by_hand(docs)


def test_stack_scan_gives_every_left_diverse_interval():
    for _ in range(300):
        n = RNG.randint(2, 12)
        common, left = [RNG.randint(1, 4) for _ in range(n - 1)], [RNG.randint(0, 2) for _ in range(n)]
        want = set()
        for a in range(n):
            for b in range(a + 1, n):
                d = min(common[a:b])
                if (a == 0 or common[a - 1] < d) and (b == n - 1 or common[b] < d) and len(set(left[a:b + 1])) > 1:
                    want.add((d, a, b))
        assert set(repeats.stack_scan(common, left)) == want


def test_repeats_of_odd_rows(spark):
    got = repeats.remove_repeats(odd(spark))
    assert got.columns == [c for c in odd(spark).columns if c not in ("removed", "kept")] + ["removed", "kept"]
    rows = got.collect()
    assert len(rows) == len(ROWS)
    assert {len(r.kept) for r in rows if (r.text or "").startswith("palavra")} != {0}
    stage = repeats.cut_repeats(odd(spark))
    assert stage.columns == odd(spark).columns and stage.dtypes == odd(spark).dtypes
    left = {(r.doc_id, r.text) for r in stage.collect()}
    assert (8, "") in left and (11, "x") in left
    assert (10, ROWS[8][1][:107]) in left or any(i == 10 and len(t) < 300 for i, t in left)  # a periodic text keeps its beginning
    assert repeats.cut_repeats(empty(spark)).count() == 0 and repeats.removal_report(empty(spark)).count() == 0


# --- SimHash -----------------------------------------------------------------

def simhash_by_hand(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(rows):
    prints = [(i, simhash_by_hand(t or "")) for i, t in rows]
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4 and group[a] != group[b]:
                old = group[a]
                group = [group[b] if g == old else g for g in group]
    out = []
    for (i, p), g in zip(prints, group):
        ids = [j for (j, _), k in zip(prints, group) if k == g and j is not None]
        out.append((i, f"{p:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def near_copies():
    words = [invent(5, "abcdefgh") for _ in range(400)]
    rows = []
    for i in range(40):
        text = [RNG.choice(words) for _ in range(RNG.randint(30, 300))]
        for _ in range(RNG.choice([1, 1, 3, 6])):
            copy = list(text)
            for _ in range(RNG.randint(0, 2)):
                copy[RNG.randrange(len(copy))] = RNG.choice(words).upper()
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    return rows


@pytest.mark.parametrize("rows", [near_copies(), ROWS])
def test_components_equal_brute_force(spark, rows):
    got = simhash.document_components(plain(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == components_by_hand(rows)


@pytest.mark.parametrize(("run", "blocks"), [(512, 6), (8, 6), (512, 5), (512, 8)])
def test_links_equal_brute_force(spark, monkeypatch, run, blocks):
    monkeypatch.setattr(simhash, "RUN", run)
    prints = [RNG.getrandbits(64) for _ in range(60)]
    for _ in range(500):  # dense balls and chains around them
        p = RNG.choice(prints)
        for b in RNG.sample(range(64), RNG.randint(1, 5)):
            p ^= 1 << b
        prints.append(p)
    prints = list(dict.fromkeys(prints))
    table = simhash.PivotTable(4)
    linked = {frozenset((a, b)) for n, a in enumerate(prints) for b in prints[:n] if (a ^ b).bit_count() <= 4}
    found = {frozenset((int(x), int(y))) for a, b in simhash.find_links(table, np.array(prints, np.uint64), list(range(64))) for x, y in zip(a, b)}
    assert found == linked
    forest = simhash.Forest()
    for pair in linked:
        forest.link(*(x - (1 << 64) if x >> 63 else x for x in pair))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "simhash bigint")
    roots = {r.node: r.root for r in simhash.components(simhash.link_forest(df, 4, blocks)).collect()}
    assert {p: roots.get(p, p) for p in signed} == {p: forest.root(p) for p in signed}


def test_one_document_of_each_component_stays(spark):
    docs = odd(spark)
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    # Two texts have number 5 and are components of their own; one of the texts without a number is alone.
    assert {c for _, _, c in components_by_hand(ROWS)} == {5, None, 7, 10, 11, -3, 13, 14, 2 ** 62}
    assert sorted(str(r.doc_id) for r in got.collect()) == sorted(map(str, [5, 5, None, 7, 10, 11, -3, 13, 14, 2 ** 62]))
    assert simhash.drop_near_duplicates(empty(spark)).count() == 0 and simhash.document_components(empty(spark)).count() == 0


# --- licences ----------------------------------------------------------------

def test_license_paragraphs(spark):
    notices = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
               "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
               "BSD": " ".join(licenses.TEMPLATES["BSD"][3].split()[:30])}
    docs = [(i, f"Some words about nothing.\nMore of them.\n{n}\nThe end of it.") for i, n in enumerate(notices.values())]
    docs += [(100, "The bar lost its license to sell beer.\nPermission denied."), (101, "version 2.0 of the interface"), (102, None), (103, "")]
    got = {r.doc_id: r for r in licenses.scan_documents(plain(spark, docs)).collect()}
    for i, (family, notice) in enumerate(notices.items()):
        assert [(x.family, x.paragraph, x.confirmed) for x in got[i].licenses] == [(family, 2, True)]
        assert docs[i][1][got[i].licenses[0].start:].startswith(notice)
    assert all(not [x for x in got[i].licenses if x.confirmed] for i in (100, 101, 102, 103))
    assert licenses.scan_documents(odd(spark)).count() == len(ROWS) and licenses.scan_documents(empty(spark)).count() == 0


def test_titles_and_tags_of_one_or_two_words(spark):
    lines = {"MIT License": "MIT", "License: MIT": "MIT", "# MIT License": "MIT", "Apache License": "Apache-2.0", "GPLv3": "GPL-3.0", "License: GPLv3": "GPL-3.0",
             "GPLv2": "GPL-2.0", "LGPL": "LGPL", "BSD License": "BSD", "License: BSD": "BSD", "ISC License": "ISC", "CC0": "CC0", "Unlicense": "Unlicense"}
    others = ["License", "The license", "MIT", "MIT researchers", "Apache helicopters", "General public", "Software license", "License: unknown", "Fishing license", "Free software"]
    docs = list(enumerate([f"{invent(30)}\n{x}\n{invent(30)}" for x in [*lines, *others]]))
    got = {r.doc_id: [(x.family, x.paragraph) for x in r.licenses if x.confirmed] for r in licenses.scan_documents(plain(spark, docs)).collect()}
    assert [got[i] for i, _ in docs] == [[(f, 1)] for f in lines.values()] + [[]] * len(others)


# --- decontamination ---------------------------------------------------------

def leaks_by_hand(docs, items):
    out = set()
    for d, text in docs:
        words = decontam.WORD.findall((text or "").lower().encode())
        for m, item in items:
            want = decontam.shingle_set(item or "")
            if want:
                size = len(next(iter(want)))
                both = len(want & {tuple(words[i:i + size]) for i in range(len(words) - size + 1)})
                if both / len(want) >= 0.8:
                    out.add((d, m, both / len(want), both, len(want)))
    return out


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_leaks_equal_brute_force(spark, sent):
    vocabulary = [invent(4, "abcdef") for _ in range(60)]
    say = lambda n: " ".join(RNG.choice(vocabulary) for _ in range(n))
    items = [(i, say(RNG.choice([3, 4, 5, 6, 12, 40, 90]))) for i in range(25)] + [(90, ""), (91, None), (92, "solo"), (93, "...")]
    docs = []
    for i in range(60):
        text = say(RNG.choice([0, 3, 50, 2000]))
        for _, item in RNG.sample(items[:25], 2):
            words = item.split()
            for _ in range(RNG.choice([0, 0, 1, 2, 5])):
                words[RNG.randrange(len(words))] = "other"
            text += ". " + ", ".join(words).upper() + " " + say(5)
        docs.append((i, text))
    docs += [(200, "solo"), (201, None), (202, ""), (None, items[5][1])]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontam.leak_pairs(plain(spark, docs), table, max_sent=sent)
    want = leaks_by_hand(docs, items)
    assert len(want) > 40
    assert {tuple(r) for r in got.collect()} == want
    clean = decontam.drop_contaminated(odd(spark), table, max_sent=sent)
    assert clean.columns == odd(spark).columns and clean.count() == len(ROWS)
    assert decontam.drop_contaminated(empty(spark), table, max_sent=sent).count() == 0
    assert decontam.drop_contaminated(odd(spark), spark.createDataFrame([], table.schema)).count() == len(ROWS)


@pytest.mark.parametrize("sent", [decontam.MAX_SENT, 0])
def test_leaks_of_repeated_and_null_item_ids(spark, sent):
    one, two = " ".join(invent(6, "abcdefgh") for _ in range(30)), " ".join(invent(6, "abcdefgh") for _ in range(40))
    items = [(1, one), (1, two), (1, one), (None, two), (None, one), (None, "solo"), (2, None), (2, ""), (3, "two words"), (3, "two words")]
    docs = [(1, one), (2, f"x {two} y"), (3, f"{two} {one}"), (None, f"solo {one}"), (None, f"solo {one}"), (5, "two words, said"), (6, None), (7, "words two")]
    got = decontam.leak_pairs(plain(spark, docs), spark.createDataFrame(items, "item_id bigint, text string").repartition(3), max_sent=sent)
    want = []
    for i, text in docs:
        words = decontam.WORD.findall((text or "").lower().encode())
        for j, item in items:
            shingles = decontam.shingle_set(item or "")
            size = len(next(iter(shingles), ()))
            have = {tuple(words[k:k + size]) for k in range(len(words) - size + 1)}
            if shingles and len(shingles & have) >= 0.8 * len(shingles):
                want.append((i, j, len(shingles & have) / len(shingles), len(shingles & have), len(shingles)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str) and len(want) > 12


# --- WARC --------------------------------------------------------------------

def pages_by_hand(pages):
    first: dict = {}
    for i, _, html in pages:
        key = (html or "").encode()
        if i is not None:
            first[key] = min(first.get(key, i), i)
    out = []
    for i, _, html in pages:
        raw = (html or "").encode()
        least = first.get(raw)
        again = least is not None and i != least
        out.append((i, len(raw), b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", least if again else None))
    return sorted(out, key=str)


def test_archives_read_back(spark, tmp_path):
    same = "<p>é same\r\n\r\nWARC/1.1\r\n" * 9000
    pages = [(3, "http://a.example/x y\n", same), (1, None, same), (7, "u", same), (2, "u", ""), (4, "u", None), (5, "u", "<html>\r\n0\r\n\r\n"),
             (6, "u", "日本" * 40_000), (8, "u", "twice"), (8, "u", "twice"), (8, "u", "other"), (None, "u", same), (None, "u", "alone")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    got = warc.round_trip(df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == pages_by_hand(pages)
    path = str(tmp_path / "archive")
    warc.write_archives(df, path, segment=1000, file_records=5)
    records = warc.read_records(spark, path)
    assert records.where("type = 'continuation'").count() > 100
    assert sorted((tuple(r) for r in warc.read_pages(spark, path).collect()), key=str) == pages_by_hand(pages)
    ids = [r.record_id for r in records.collect()]
    assert len(ids) == len(set(ids))
    with pytest.raises(Exception, match="broken segments"):
        warc.reassembled(records.where("segment IS NULL OR segment <> 2")).collect()
    assert warc.round_trip(df.limit(0)).count() == 0


def test_chunked_framing():
    for n in (0, 1, 8191, 8192, 8193, 30_000):
        body = RNG.randbytes(n)
        assert warc.dechunked(warc.chunked(body)) == body
    assert warc.dechunked(b"4;ext=1\r\nab\r\n\r\n0\r\nTrailer: x\r\n\r\n") == b"ab\r\n"
    with pytest.raises(ValueError):
        warc.dechunked(b"4\r\nabcdef\r\n0\r\n\r\n")
