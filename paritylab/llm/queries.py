"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritylab.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register
def op1_winnowing_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritylab.llm.winnowing import edited_neighbours
    return edited_neighbours(table(spark, sf_dir, "documents").selectExpr("cast(doc_id as bigint) AS doc_id", "text"))


@register
def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritylab.llm.repeats import removal_report
    return removal_report(table(spark, sf_dir, "documents"))


@register
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritylab.llm.toxicity import THRESHOLD, remainder, score_documents, train
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as bigint) AS doc_id", "text")
    scored = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
                         (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))


@register
def op5_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritylab.llm.chunkbpe import encode_documents
    return encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@register
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritylab.llm.simhash import document_components
    return document_components(table(spark, sf_dir, "documents"))


@register
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritylab.llm.decontam import leak_pairs
    return leak_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritylab.llm.tokencount import token_counts
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@register
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from paritylab.llm.packing import pack_documents
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)


@register
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritylab.llm.warc import round_trip
    return round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


ORACLE["op10_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT *, sha1(b) AS h, min(page_id) OVER (PARTITION BY sha1(b)) AS first_id FROM p),
d AS (SELECT *, [CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) FOR i IN range(0, 20)] AS y FROM f)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((((y[(k * 5) // 8 + 1] * 256 + coalesce(y[(k * 5) // 8 + 2], 0)) >> CAST(11 - (k * 5) % 8 AS INTEGER)) & 31) + 1 AS BIGINT), 1)
    FOR k IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d"""


@register
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritylab.llm.licenses import scan_documents
    return scan_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_paragraphs", F.size("licenses").cast("long").alias("n_licenses"),
        F.size(F.filter("licenses", lambda x: x.confirmed)).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("licenses", lambda x: x.confirmed), lambda x: x.family))), ",").alias("families"),
        F.array_max(F.transform("licenses", lambda x: x.probability)).alias("top_probability"))


@register
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritylab.llm.resampling import resample
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 by its table, which the polynomial gives; words are hashed once each.
ORACLE["op12_importance_resampling"] = r"""
WITH tbl AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(0, 8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d), qw AS (SELECT unnest(ws) AS w FROM q),
sw AS (SELECT w, count(*) AS n FROM dw GROUP BY w), tw AS (SELECT w, count(*) AS n FROM qw GROUP BY w),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM sw UNION SELECT w FROM tw)),
b AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      [CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT) FOR i IN range(0, length(h) // 2)]),
    lambda c, y: xor(c >> 8, t[CAST((xor(c, y) & 255) + 1 AS BIGINT)])), 4294967295) % 10000 AS k FROM v, tbl),
s AS (SELECT k, sum(n) AS n FROM sw JOIN b USING (w) GROUP BY k), t AS (SELECT k, sum(n) AS n FROM tw JOIN b USING (w) GROUP BY k),
g AS (SELECT b.w, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM b LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
x AS (SELECT doc_id, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM dw JOIN g USING (w) GROUP BY doc_id),
y AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN x USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, 10 * count(*) FILTER (n_features >= 20) OVER () // 100 AS drawn FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM r"""


@register
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritylab.llm.alignment import align
    return align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


@register
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paritylab.llm.secretscan import secret_report
    return secret_report(table(spark, sf_dir, "documents"))
