"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common


class UnionFind:
    """Sets of whole numbers; a set's name is its least member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        low, high = min(a, b), max(a, b)
        self.parent[high] = low
        self.parent.setdefault(low, low)
        return True


def contract(edges: DataFrame) -> DataFrame:
    """Replace each partition's edges (a, b) by stars to the least member of each of its components."""

    def stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = UnionFind()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                sets.join(a, b)
        members = np.fromiter(sets.parent, np.int64, len(sets.parent))
        roots = np.fromiter(map(sets.find, list(sets.parent)), np.int64, len(members))
        some = members != roots
        yield pa.RecordBatch.from_arrays([pa.array(members[some]), pa.array(roots[some])], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(stars, "a long, b long")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): for every node of ``edges`` (a, b: long) the least node that it is connected with.

    Partitions are contracted apart first; then large-star and small-star rounds (each links a node's neighbours to
    the least of them) run until nothing changes, which takes a number of rounds that grows with the logarithm of the
    graph. Every round is written, so a lost executor costs one round at most. Empty edges give an empty result.
    """
    now = common.materialise(contract(edges).where("a <> b").distinct())
    before = None
    for _ in range(max_rounds):
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before or not sign[0]:
            break
        before = sign
        # large star: every larger neighbour meets the least neighbour (or the node itself)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node's smaller neighbours and the node itself meet the least of them
        large = common.materialise(large.where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        # what meets in one partition is settled there, so a small graph takes few rounds
        now = common.materialise(contract(small.where("a <> b")).distinct())
    else:
        raise RuntimeError("components did not settle")
    stars = now.groupBy("a").agg(F.min("b").alias("b"))
    roots = now.select(F.col("b").alias("node")).distinct().join(stars.select(F.col("a").alias("node")), "node", "left_anti")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
