"""The given tables as the operators' inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.notes import document_notes, markdown_notes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_notes(table(spark, sf_dir, "documents"))


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_notes(table(spark, sf_dir, "documents"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks: three of them make a note."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("n"), F.expr("vec_id div 3").cast("string")).alias("note_path"), F.col("embedding").alias("vec"), F.concat(F.lit("t"), F.repeat(F.lit("x"), (F.col("vec_id") % 7).cast("int"))).alias("text"), "label")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files with the time of their last change."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string"), F.lit(".md")).alias("note_path"), F.col("ts").cast("timestamp").alias("modified"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as revisions of a note for each user, with a score and a count."""
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("note_path"), F.sha1(F.col("event_id").cast("string")).alias("sha"), F.col("ts").cast("timestamp").alias("commit_ts"), (F.col("value") / 100).alias("conviction"), F.get_json_object("props", "$.k").cast("long").alias("supporting"), F.col("event_type").alias("message"))
