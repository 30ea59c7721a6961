"""The pipeline's stages against brute force on a small table, and on awkward rows."""

import os
import zlib

import duckdb
from tests.conftest import SMOKE
from tests.llm.odd import CLASHES, ROWS, empty, odd
from tests.llm.test_corpus import components_by_hand, leaks_by_hand

import corpus_pipeline
from paritylab.llm import toxicity
from paritylab.llm.queries import ORACLE, QUERIES


def repeats_cut(docs, least=100):
    seen, out = set(), []
    for i, text in sorted(docs):
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - least + 1):
            w = raw[s:s + least]
            if w in seen:
                gone[s:s + least] = b"\x01" * least
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
        if kept or not any(gone):
            out.append((i, kept))
    return out


def test_pipeline_equals_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMOKE}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMOKE}/benchmark.parquet'").fetchall()
    toxic = dict(duckdb.sql(f"SELECT doc_id, max(toxic) FROM '{SMOKE}/labels.parquet' GROUP BY ALL").fetchall())
    text = dict(docs)
    own = spark.createDataFrame([(i, 0) for i in toxic], "doc_id bigint, x int").selectExpr("doc_id", "xxhash64(doc_id) AS h").collect()
    order = [r.doc_id for r in sorted(own, key=lambda r: (r.h, r.doc_id)) if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    model = toxicity.fit([text[i] for i in order], [toxic[i] for i in order])
    docs = [(i, t) for (i, t), s in zip(docs, toxicity.score_texts(model, {}, [t for _, t in docs])) if s < toxicity.THRESHOLD]
    docs = [(i, t) for i, t in docs if i in {c for _, _, c in components_by_hand(docs)}]
    docs = repeats_cut(docs)
    leaked = {r[0] for r in leaks_by_hand(docs, items)}
    docs = [(i, t) for i, t in docs if i not in leaked]
    assert leaked
    from paritylab.llm.chunkbpe import ChunkEncoder
    from paritylab.llm.common import sha256_hex
    from paritylab.llm.queries import vocabulary
    lib = ChunkEncoder(vocabulary("word_bpe_49k.json")).lib
    want = {(i, len(lib.encode(t, add_special_tokens=False).ids),
             sha256_hex(lib.decode(lib.encode(t, add_special_tokens=False).ids, skip_special_tokens=False).encode())) for i, t in docs}
    assert {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, SMOKE).collect()} == want


def test_stages_on_odd_and_empty_tables(spark):
    for table in (odd(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, table, SMOKE)
            assert got.columns == table.columns and got.dtypes == table.dtypes
            rows = got.collect()
            assert len(rows) <= len(ROWS)
            assert all(r[c].startswith(c) for r in rows for c in CLASHES)  # columns that look like ours are carried along
        assert corpus_pipeline.STAGES[-1][1](spark, table, SMOKE).count() == table.count()


def test_registered_queries_with_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SMOKE, t)}.parquet'")
    for name, sql in ORACLE.items():
        got, want = QUERIES[name](spark, SMOKE), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(str, (tuple(r) for r in got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
