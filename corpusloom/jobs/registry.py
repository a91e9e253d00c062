"""Registered queries of the package, with SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.jobs import corpus_queries, edit_queries, link_queries, note_queries, retrieval_queries, time_queries

MODULES = (corpus_queries, note_queries, link_queries, retrieval_queries, time_queries, edit_queries)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_queries.QUERIES["dense_topk"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
