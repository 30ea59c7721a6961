"""WARC archives: writing with revisits, segmentation and chunked transfer framing, and reading back.

Writing: a response record holds an HTTP response whose body is the payload in chunked framing; a
payload that an earlier record has already becomes a revisit record without a body (its HTTP header
tells the length). A block longer than ``SEGMENT`` bytes is cut: the first piece keeps the record's
type, the others are continuation records with the origin's identifier and a segment number; the last
one tells the total length. Archives are plain WARC/1.1 text that Spark's text writer makes: a row is a
record, and the blank lines that end a record are the line separator (gzip around each file).

Reading: archive files come through Spark's binaryFile reader, so from any store. Records are parsed by
their Content-Length; continuation records are grouped by origin identifier, ordered by segment number,
checked against the total length, and the joined block's chunked framing is decoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritylab.llm.common import lean

SEGMENT = 32 << 10
CHUNK = 8 << 10
#: Records of a file: with segments of at most SEGMENT bytes this bounds a file (24 MB and headers).
FILE_RECORDS = 768
CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KINDS = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("type", pa.string()), ("segment", pa.int32()),
                   ("origin", pa.string()), ("total", pa.int64()), ("refers", pa.string()), ("digest", pa.string()), ("block", pa.binary())])
RECORD = "record_id string, page_id bigint, type string, segment int, origin string, total bigint, refers string, digest string, block binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    out = []
    for lo in range(0, len(body), size):
        part = body[lo:lo + size]
        out += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*out, b"0", CRLF, CRLF])


def dechunked(framed: bytes) -> bytes:
    """The body of chunked framing; extensions are skipped, trailers allowed. Broken framing is an error."""
    out, at = [], 0
    while True:
        end = framed.index(CRLF, at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if framed[at + size:at + size + 2] != CRLF:
            raise ValueError("chunk without its line end")
        out.append(framed[at:at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """Body of an HTTP response block."""
    head, _, body = block.partition(CRLF + CRLF)
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(CRLF, b"\n")) else body


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + CRLF + CRLF + block


def _clean(url: str | None) -> str:
    return re.sub(r"\s", "%20", url or "about:blank")


def page_records(key: str, page_id: int | None, url: str | None, html: str | None, refers_to: int | None, segment: int) -> list[bytes]:
    """The record of a page, in segments if it is long. ``key`` is the page_id; rows that share
    one get a longer key, so that identifiers are unique."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    me = f"<urn:page:{key}>"
    head = [("WARC-Record-ID", me), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)),
            ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    kind = [("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        return [_record([("WARC-Type", "revisit"), *head, ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE), *kind], http)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [_record([("WARC-Type", "response"), *head, *kind], block)]
    out = [_record([("WARC-Type", "response"), *head, ("WARC-Segment-Number", "1"), *kind], block[:segment])]
    for n, lo in enumerate(range(segment, len(block), segment), 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{key}:{n}>"), ("WARC-Date", DATE),
                ("WARC-Segment-Origin-ID", me), ("WARC-Segment-Number", str(n))]
        if lo + segment >= len(block):
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(more, block[lo:lo + segment]))
    return out


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with ``single`` (no other row has its page_id) and ``refers_to``: the smallest page_id with an equal payload, for all
    other records of that payload if it has ``least_bytes`` or more. Only ids and digests meet by digest;
    pages are shuffled once, by page_id. Rows that repeat the smallest id are responses too; a null id is
    larger than any other."""
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html.cast("binary")).alias("_sha"),
                       F.octet_length(html).alias("_bytes"))
    ids = own.select("page_id", "_sha", "_bytes")
    first = (ids.where(F.col("_bytes") >= least_bytes).groupBy("_sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
             .where("n > 1"))
    again = (ids.join(first, "_sha").where("page_id > refers_to OR page_id IS NULL AND refers_to IS NOT NULL")
             .select("page_id", "_sha", "refers_to", F.lit(False).alias("many")))
    repeated = ids.groupBy("page_id").count().where("count > 1").select(F.col("page_id").alias("_q"))
    same = (ids.join(repeated, F.col("page_id").eqNullSafe(F.col("_q")))
            .select("page_id", "_sha", F.lit(None).cast("long").alias("refers_to"), F.lit(True).alias("many")))
    marks = (again.unionAll(same).groupBy("page_id", "_sha").agg(F.max("refers_to").alias("refers_to"), F.max("many").alias("many"))
             .withColumnsRenamed({"page_id": "_p", "_sha": "_s"}))
    return (own.join(marks, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("_sha") == F.col("_s")), "left")
            .select("page_id", "url", "html", "refers_to", (~F.coalesce("many", F.lit(False)) & F.col("page_id").isNotNull()).alias("single")))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, file_records: int = FILE_RECORDS, least_bytes: int = 0) -> None:
    """One WARC record (or its segments) per row of ``pages``, into gzip files of at most ``file_records`` records."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        for b in batches:
            out, held = [], 0
            cols = b.to_pydict()
            for single, *row in zip(cols["single"], cols["page_id"], cols["url"], cols["html"], cols["refers_to"]):
                n += 1
                made = page_records(str(row[0]) if single else f"{row[0]}:{task}:{n}", *row, segment)
                out += made
                held += sum(map(len, made))
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    (with_revisits(pages, least_bytes).mapInArrow(lean(run), "record binary").select(F.col("record").cast("string").alias("record"))
     .write.mode("errorifexists").option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", file_records).text(path))


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of an archive file, one after another by their Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(CRLF + CRLF, at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        block = data[end + 4:end + 4 + size]
        if len(block) != size or data[end + 4 + size:end + 8 + size] != CRLF + CRLF:
            raise ValueError(f"record at byte {at} is cut short")
        at = end + 8 + size
        number = lambda k: int(head[k]) if k in head else None
        refers = re.fullmatch(r"<urn:page:(-?\d+)>", head.get("warc-refers-to", ""))
        yield {"record_id": head["warc-record-id"], "page_id": number("x-page-id"), "type": head["warc-type"],
               "segment": number("warc-segment-number"), "origin": head.get("warc-segment-origin-id"),
               "total": number("warc-segment-total-length"), "refers": refers[1] if refers else None,
               "digest": head.get("warc-payload-digest", "").removeprefix("sha1:"), "block": block}


def gunzipped(data: bytes) -> bytes:
    """All members of a gzip file."""
    out = []
    while data:
        z = zlib.decompressobj(31)
        out += [z.decompress(data), z.flush()]
        data = z.unused_data
    return b"".join(out)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``, segments apart."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = b.column("content")[i].as_buffer().to_pybytes()
                data = gunzipped(data) if data[:2] == b"\x1f\x8b" else data
                out, held = [], 0
                for r in parse_records(data):
                    out.append(r)
                    held += len(r["block"])
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema=KINDS)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=KINDS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(lean(run), RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records: segments are grouped by the origin's identifier, ordered by segment number and joined.

    A gap in the numbers, a missing last segment or a wrong total length is an error, not a loss. A group is
    one record, so it is bounded by the record; records without segments are not shuffled."""
    whole = records.where("segment IS NULL")
    parts = records.where("segment IS NOT NULL").withColumn("key", F.coalesce("origin", "record_id"))
    joined = parts.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("s"), F.max("total").alias("total"),
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("page_id", "type", "refers", "digest")])
    block = F.expr("array_join(transform(s, x -> hex(x.block)), '')")
    sound = F.expr("transform(s, x -> x.segment) = sequence(1, size(s)) AND total = aggregate(s, 0L, (a, x) -> a + octet_length(x.block))")
    joined = joined.select(F.col("key").alias("record_id"), "page_id", "type", "refers", "digest",
                           F.when(F.coalesce(sound, F.lit(False)), F.unhex(block))
                           .otherwise(F.raise_error(F.concat(F.lit("broken segments of "), "key"))).alias("block"))
    return whole.select("record_id", "page_id", "type", "refers", "digest", "block").unionByName(joined)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page in the archives.

    A response's length and digest are taken from its decoded payload and must agree with its header; a
    revisit has no body, so its HTTP header and its WARC header give them."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["type"] == "revisit":
                    size, digest = int(re.search(rb"(?im)^content-length:\s*(\d+)", r["block"])[1]), r["digest"]
                else:
                    payload = payload_of(r["block"])
                    size, digest = len(payload), sha1_base32(payload)
                    if digest != r["digest"]:
                        raise ValueError(f"payload of {r['record_id']} does not have its digest")
                rows.append((r["page_id"], size, digest, r["type"], int(r["refers"]) if r["refers"] else None))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return reassembled(read_records(spark, path)).mapInArrow(
        lean(run), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in a new folder of the shared checkpoint directory and read the archives back.

    Null html is an empty payload; an empty table gives an empty result."""
    import uuid

    from paritylab.session import ensure_checkpoint_dir

    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    if not spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").head(1):
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    return read_pages(spark, path)
