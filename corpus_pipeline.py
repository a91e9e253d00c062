"""A training corpus from raw documents: five stages, each over all that the stage before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, common, linededup, mixing, neardup, quality


def _like(docs: DataFrame, kept: DataFrame) -> DataFrame:
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the log-likelihood ratio keep; the rest go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _like(docs, quality.score_quality(docs, labels).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more share stay in one of them; n_chars follows the text."""
    deduped = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        deduped = deduped.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long"))
    return _like(docs, deduped)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with linked 5-word shingle sets (similarity 0.8 or more) stays: that of the least doc_id.

    Rows are told apart, not ids: rows of one id with different texts are different documents. Of equal ids in a group
    the row with the least hash of all its columns stays, so repeated rows leave one; a row without an id stays only
    where its group has no id. Rows without words have no group and all stay.
    """
    row, tie = common.free_name(docs, "_row"), common.free_name(docs, "_tie")
    keyed = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(tie, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    keyed = common.materialise(keyed)
    groups = neardup.near_duplicates(keyed, k=5, num=80, den=100, keep=(row, tie))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", tie, row)).alias("first")
    kept = groups.where("group_id is not null").groupBy("group_id").agg(first).select(F.col(f"first.{row}").alias(row))
    kept = kept.unionByName(groups.where("group_id is null").select(row))
    return _like(docs, keyed.join(kept, row, "left_semi"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to twice."""
    return _like(docs, mixing.apply_mix(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, with digests of the ids and of the bytes that they decode to."""
    vocabulary = bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = bpe.encode_documents(docs.select("doc_id", "source", "text"), vocabulary).select("doc_id", "source", "ids")
    return bpe.digests(encoded, vocabulary, keep=("source", "ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

#: Quality scores, the mix and tokens are not for SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written and read again as the documents of the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.materialise(docs)
    return docs
