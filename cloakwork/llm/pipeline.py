"""A corpus pipeline: quality, near duplicates, secrets, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept; all but the last return the columns of ``documents``. The
stages handle nulls, empty texts, repeated rows and empty tables as their
operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, mixing, quality, secrets
from .storage import Scratch, materialize, sized

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject; all of them if a class has no usable text, so that no model could be fitted."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model.good is None or model.bad is None:
        return docs.select(*COLUMNS)
    return quality.score(docs, model).filter("predicted = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; rows without an id stay.

    Up to 32 MB of the ids that go are sent to all executors; the documents
    are shuffled only beyond that.
    """
    groups = jaccard.similar_groups(docs)
    gone = materialize(groups.filter("component_id <> doc_id").select("doc_id").distinct())
    return docs.join(sized(gone), "doc_id", "left_anti").select(*COLUMNS)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret."""
    rows, _ = secrets.scan(docs)
    rows = rows.withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    return rows.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    mixed = mixing.mix(docs).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining row, digested."""
    tokens = bpe.encode_texts(docs, bpe.default_vocabulary(), with_ids=False)
    return tokens.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", keep_good),
    ("near_copies", drop_near_copies),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("tokens", encode),
]
#: The classifier, the join and the tokenizer have no SQL; tests/llm/test_pipeline.py holds each stage against brute force or its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to the shared folder, and go once the next stage is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    before = Scratch()
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            after = Scratch()
            docs = after.keep(docs)
            before.clear()
            before = after
    return docs
