"""Corpus preparation in five stages: toxicity, near-duplicates, repeated passages, test items, token ids.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``docs``.

Null texts count as empty, repeated rows meet in the near-duplicate stage, an empty table passes through
empty, and columns beyond those of ``documents`` are carried along, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paritylab.llm.chunkbpe import encode_documents
from paritylab.llm.common import fresh, table
from paritylab.llm.decontam import drop_contaminated
from paritylab.llm.queries import vocabulary
from paritylab.llm.repeats import cut_repeats
from paritylab.llm.simhash import drop_near_duplicates
from paritylab.llm.toxicity import THRESHOLD, score_documents, train
from paritylab.session import ensure_checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold stay."""
    score = fresh(docs, "toxicity")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, model, into=score).where(F.col(score) < THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: 4-word shingles, at most 4 differing bits."""
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of 100-byte strings are cut out of the texts; documents that are nothing else go."""
    return cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids and decoded text of what is left."""
    return encode_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("simhash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages),
          ("benchmark decontamination", decontamination), ("BPE encoding and decoding", token_ids)]

#: A trained classifier, XXH64 and BPE have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage keeps is written below the shared checkpoint folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(kept.schema).parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
