"""Retrieval metrics over batches of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked_notes(hits: DataFrame) -> DataFrame:
    """(query_id, note_path, rank): notes in order of their first hit (query_id, note_path, score, rank), scores above 0 only."""
    first = hits.where("score > 0").groupBy("query_id", "note_path").agg(F.min("rank").alias("_r"))
    return first.select("query_id", "note_path", F.row_number().over(Window.partitionBy("query_id").orderBy("_r", "note_path")).alias("rank"))


def metrics(ranked: DataFrame, gold: DataFrame, k: int = 10, any_of: bool = False) -> DataFrame:
    """(query_id, recall, rr, ndcg) for every query of ``gold`` (query_id, note_path); no gold rows, no query.

    ``any_of``: recall is 1 as soon as one relevant note is among the first k.
    """
    wanted = gold.distinct()
    met = wanted.join(ranked, ["query_id", "note_path"], "left")
    near = F.col("rank") <= k
    found = met.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.when(near, 1).otherwise(0)).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    recall = (F.col("hits") > 0).cast("double") if any_of else F.col("hits") / F.col("n")
    return found.select("query_id", recall.alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.col("dcg") / ideal).alias("ndcg"))


def summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg"))


def truth_recall(got: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): hits over the smaller of both sets; an empty truth gives 1."""
    hits = got.join(truth, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    sizes = got.groupBy("query_id").agg(F.count("*").alias("g")).join(truth.groupBy("query_id").agg(F.count("*").alias("t")), "query_id", "left")
    told = sizes.join(hits, "query_id", "left")
    return told.select("query_id", F.when(F.coalesce("t", F.lit(0)) == 0, 1.0).otherwise(F.coalesce("hits", F.lit(0)) / F.least("g", "t")).alias("recall"))


def check_router(base: DataFrame, routed: DataFrame, diverse: DataFrame) -> DataFrame:
    """(router_ok, diversity_ok) from summaries: routing must not lower recall, diversity not cost over 0.05 of ndcg."""
    one = base.select(F.col("recall").alias("r0"), F.col("ndcg").alias("n0")).crossJoin(routed.select(F.col("recall").alias("r1"))).crossJoin(diverse.select(F.col("ndcg").alias("n2")))
    return one.select((F.col("r1") >= F.col("r0")).alias("router_ok"), (F.col("n2") - F.col("n0") >= -0.05).alias("diversity_ok"))
