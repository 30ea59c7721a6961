"""Table sources and sinks.

Delimited text is read with Spark's CSV reader, all columns as text (a record
with too many fields is an error). Quotes are doubled inside quoted fields; a quoted field may hold delimiters and line
breaks. One aggregate over the lines finds the files in which a line leaves a quote open: these are read record by record, unsplit,
the others are split as usual. Names come from the first file's header, so
that duplicates get the ``_dup_k`` suffixes instead of Spark's positional
renaming, and every file's own header line is skipped, then numeric columns are inferred in one aggregate
(``profile.infer_numeric``).
"""

from __future__ import annotations

import csv
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paritylab.operators.prep import dedupe_columns

# Delimiters considered by the delimiter inference.
CANDIDATE_DELIMITERS = (",", ";", "\t", "|")
# Lines that the delimiter inference reads unless told otherwise.
SAMPLE_LINES = 200

_READERS: dict[str, Callable[..., DataFrame]] = {}


def register_reader(suffix: str, fn: Callable[..., DataFrame]) -> None:
    """Extension point, a reader per file suffix."""
    _READERS[suffix.lower()] = fn


def _unquoted(value, sep: str):
    """``value`` without its quoted fields."""
    return F.regexp_replace(value, f'(^|{_class(sep)})[ ]*"(?:[^"]|"")*+"', "$1")


def _class(sep: str) -> str:
    return "[" + "".join(f"\\x{ord(c):02X}" if ord(c) < 256 else c for c in sep) + "]"


def infer_delimiter(spark: SparkSession, path: str, sample_lines: int | None = SAMPLE_LINES) -> str:
    """Per-line counts of each candidate over the first ``sample_lines`` lines (None: all lines), quoted fields left out; the
    delimiter that occurs the same number of times in most lines wins, on ties the more frequent; comma when none occurs."""
    lines = spark.read.text(path)
    lines = lines if sample_lines is None else lines.limit(sample_lines)
    bare = _unquoted(F.col("value"), "".join(CANDIDATE_DELIMITERS))
    exploded = lines.select(bare.alias("value")).select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("d"), (F.length("value") - F.length(F.replace("value", F.lit(d), F.lit(""))))
                 .alias("k")) for d in CANDIDATE_DELIMITERS])).alias("x")).select("x.d", "x.k")
    modal = (exploded.where(F.col("k") > 0).groupBy("d", "k").agg(F.count(F.lit(1)).alias("n"))
             .orderBy(F.col("n").desc(), F.col("k").desc(), F.col("d")).limit(1).collect())
    return modal[0]["d"] if modal else ","


def files_with_breaks(spark: SparkSession, path: str, sep: str) -> tuple[list[str], list[str]]:
    """(files whose records are lines, files in which a line leaves a quoted field open). A file with an odd number of quotes
    among the latter is an error: a quote never closes (signs inside a field, as in ``5" wide``, do not count). One row a file reaches
    the driver, as when Spark lists them."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    within = _class(sep)[1:-1]
    bare = F.regexp_replace("value", f'(?<=[^"{within}])"(?=[^"{within}])', "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    opens = F.col("value").contains('"') & F.coalesce(_unquoted(F.col("value"), sep).rlike(f'(^|{_class(sep)})[ ]*"'), F.lit(False))
    files = lines.groupBy("file").agg(F.max(opens).alias("opens"), F.sum(quotes).alias("quotes")).collect()
    odd = sorted(r["file"] for r in files if r["opens"] and r["quotes"] % 2)
    if odd:
        raise ValueError(f"a quote is never closed in {odd[0]}")
    return sorted(r["file"] for r in files if not r["opens"]), sorted(r["file"] for r in files if r["opens"])


def strip_headers(df: DataFrame) -> DataFrame:
    """S3: trim surrounding whitespace of column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def read_table(spark: SparkSession, path: str, sep: str | None = None, infer_types: bool = True,
               sample_lines: int | None = SAMPLE_LINES) -> DataFrame:
    """Load by suffix. csv/txt/tsv: header line in each file, one delimiter, inferred from
    ``sample_lines`` lines unless ``sep`` is given; a short record is filled with nulls, a long one and a quote that never closes are
    errors. parquet/orc/json use Spark readers."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower().lstrip(".")
    if suffix in _READERS:
        return _READERS[suffix](spark, path)
    if suffix in ("parquet", "orc", "json"):
        return strip_headers(spark.read.format(suffix).load(path))
    if suffix not in ("csv", "txt", "tsv", "data", ""):
        raise ValueError(f"Unsupported file format: .{suffix}")
    df = _read_delimited(spark, path, sep or ("\t" if suffix == "tsv" else infer_delimiter(spark, path, sample_lines)))
    if len(df.columns) <= 1:
        raise ValueError("could not split the file into columns")
    if infer_types:
        from paritylab.operators.profile import infer_numeric
        df, _ = infer_numeric(df)
    return df


def _read_delimited(spark: SparkSession, path: str, sep: str) -> DataFrame:
    by_line, by_record = files_with_breaks(spark, path, sep)
    if not by_line and not by_record:
        return spark.createDataFrame([], "value string")
    if by_record:  # a header may hold a line break, too
        first = _csv(spark, sep).option("multiLine", True).option("header", False).csv(by_record[0]).first()
        names = [n or "" for n in first] if first is not None else []
    else:
        names = next(csv.reader([spark.read.text(path).first()["value"]], delimiter=sep), [])
    if not any(names):
        return spark.createDataFrame([], "value string")
    names = dedupe_columns([n.strip() for n in names])
    cells = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)]  # the last takes what is too much
    reader = _csv(spark, sep).schema(T.StructType(cells)).option("header", True)
    if not by_record:
        rows = reader.csv(path)
    else:
        rows = _csv(spark, sep).schema(T.StructType(cells)).option("header", True).option("multiLine", True).csv(by_record)
        rows = rows.unionByName(reader.csv(by_line)) if by_line else rows
    over = F.raise_error(F.lit(f"a line has more than {len(names)} fields"))
    rows = rows.withColumn("c0", F.when(F.col(cells[-1].name).isNotNull(), over.cast("string")).otherwise(F.col("c0")))
    return rows.select(*[F.col(c.name).alias(n) for c, n in zip(cells, names)])


def _csv(spark: SparkSession, sep: str):
    return spark.read.option("sep", sep).option("encoding", "UTF-8").option("quote", '"').option("escape", '"')


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> str:
    """Mitigated-table sink (CSV with header and doubled quotes, or any Spark format)."""
    w = df.write.mode(mode)
    (w.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else w.format(fmt).save(path))
    return path
