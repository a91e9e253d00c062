"""N-gram Jaccard join with a count-vector R-tree.

A document is its set of word shingles. Shingles hash into GROUPS groups; a set's numbers of members in each are a
point, and two sets share at most the sum of the coordinates' minima. Points lie in an R-tree; a node's upper corner
bounds all points below it, so subtrees and pairs that can't reach the needed overlap fall away and only surviving
pairs are verified on the sets.

A tree over the whole corpus would not fit one task, and its corners would not tell unrelated documents of like size
apart, so documents first meet by rare shingles: under one global order (rarest first, by a table of counters of fixed
size) two sets that are similar enough must share one of their first n - ceil(t n) + 1 shingles. That deals the points
to trees: sharers of a shingle are the points of one tree, whose bound decides which of them make a family, and each
family, or each tile of a large one, is a tree of its own that gives the pairs to verify. Of two sets the smaller one
shares even one of its first n - ceil(2t / (1 + t) n) + 1, so sharers that have the shingle further on only meet those.

Texts made of a few popular building blocks have no rare shingles: all their first ones have very many sharers, who
are not alike. Such sets meet by parts instead. Sets similar enough differ in at most D shingles, D given by their size
class, so of more than D parts that shingles are dealt to by hash one at least is the same in both; a key is the whole
content of a part. A part that very many have in common makes them a family without any comparison.

Two things keep a large family from costing all pairs of its tiles. Tiles are linked within themselves first, together
with some visitors from other tiles; what is connected by then is dealt to tiles again by component, and two tiles of
one component don't meet. And within a task whoever is connected already is left out before any bound is worked out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common
from corpusloom.llm.graphs import UnionFind, connected_components

GROUPS = 256
#: Counters of the popularity table, whose size is fixed. They only set the order of shingles, never a result.
COUNTER_BITS = 22
PARTS = 64
#: Points below one node of the R-tree; as few make a tree of one leaf.
FANOUT = 16
#: Sharers of a shingle up to which they are compared by the bound; where there are more they meet by parts.
SHARERS = 512
#: Sharers of a part up to which they are compared by the bound; more are one family.
PART_SHARERS = 2048
#: Shingles of one tile: a tile of very long texts has fewer of them.
TILE_SHINGLES = 1 << 21
#: Rows of equal sets are dealt to so many parts before they are named.
SALTS = 64
#: One of so many nodes of a tile visits other tiles of its family.
VISITOR = 128


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct 64-bit shingle hashes (A-Z lower-cased; fewer than k words are one shingle)."""
    owner, codes, words = common.words_of(pc.ascii_lower(texts))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))[codes]
    n = len(hashes)
    windows = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(windows)]
    windows = common.mix64(windows)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    sets = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # noqa: B905
        if b - a >= k:
            sets.append(np.unique(windows[a : b - k + 1]))
        elif b > a:
            sets.append(np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def set_name(shingles: np.ndarray) -> int:
    """A signed 64-bit hash that stands for the whole set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def point_of(shingles: np.ndarray) -> bytes:
    """Members of a set by group, as bytes, or as 32-bit numbers where a count is above 255."""
    counts = np.bincount((shingles & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.uint8 if counts.max() < 256 else np.int32).tobytes()


def size_step(num: int, den: int) -> float:
    """Logarithm of the width of a size class; similar sets are of the same class or of neighbouring ones."""
    return max(1e-6, math.log(den / num) * 1.001)


def part_keys(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a set's parts, for its size class and the next one: sets that are similar enough have one in common.

    In a class sets differ in D shingles at most. There are some more than D + 1 parts, so that one part with a member
    is the same in both; only a set with members in D parts or fewer also gets keys for its empty parts.
    """
    n, step, keys = len(shingles), size_step(num, den), []
    own = math.floor(math.log(n) / step)
    for c in (own, own + 1):
        most = math.ceil(math.exp((c + 1) * step))
        differ = 2 * most * (den - num) // (den + num)
        parts = differ + 3 + differ // 16
        part = (common.mix64(shingles ^ np.uint64(c + 1)) % np.uint64(parts)).astype(np.int64)
        # content of a part: sums of two hashes of its members
        one, two = np.zeros(parts, np.uint64), np.zeros(parts, np.uint64)
        np.add.at(one, part, shingles)
        np.add.at(two, part, common.mix64(shingles))
        named = common.mix64(one ^ common.mix64(two + np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c)))
        held = np.bincount(part, minlength=parts) > 0
        keys.append(named[held] if held.sum() > differ else named)
    return np.unique(np.concatenate(keys)).view(np.int64)


def read_points(packed: list[bytes]) -> np.ndarray:
    points = np.empty((len(packed), GROUPS), np.int32)
    for i, x in enumerate(packed):
        points[i] = np.frombuffer(x, np.uint8 if len(x) == GROUPS else np.int32)
    return points


def popularity(docs: DataFrame, k: int) -> np.ndarray:
    """How many (document, shingle) pairs of all documents fall on each of 2^COUNTER_BITS counters, in eighths of powers of two."""
    width = (1 << COUNTER_BITS) // PARTS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, np.int32)
        for batch in common.slices(batches):
            at = np.sort(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(common.texts_of(batch), k)]) >> np.uint64(64 - COUNTER_BITS))
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), at[1:] != at[:-1])))
            total[at[first].astype(np.int64)] += np.diff(np.append(first, len(at))).astype(np.int32)
        rows = [total[p * width : (p + 1) * width].tobytes() for p in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(rows, pa.binary())], names=["part", "counters"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for x in table["counters"]:
            total += np.frombuffer(x.as_py(), np.int32)
        steps = np.minimum(255, np.floor(8 * np.log2(total + 1))).astype(np.uint8)
        return pa.table({"part": table["part"].slice(0, 1), "counters": pa.array([steps.tobytes()], pa.binary())})

    summed = docs.select("text").mapInArrow(count, "part int, counters binary").groupBy("part").applyInArrow(add, "part int, counters binary")
    whole = np.zeros(1 << COUNTER_BITS, np.uint8)
    for part, counters in summed.collect():  # PARTS rows, a byte for each counter
        whole[part * width : (part + 1) * width] = np.frombuffer(counters, np.uint8)
    return whole


class CountTree:
    """An R-tree packed from points in order: each node keeps the upper corner and the size range of FANOUT below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.levels = [(points, sizes, sizes)]
        while len(self.levels[-1][0]) > FANOUT:
            high, low_n, high_n = self.levels[-1]
            at = np.arange(0, len(high), FANOUT)
            self.levels.append((np.maximum.reduceat(high, at), np.minimum.reduceat(low_n, at), np.maximum.reduceat(high_n, at)))

    def reach(self, point: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Points that may be similar enough: num/den of the union must be within the summed minima."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low_n, high_n = self.levels[depth]
            fits = (den * low_n[nodes] * num <= den * den * size) & (den * high_n[nodes] >= num * size)
            nodes = nodes[fits]
            if len(nodes):
                bound = np.minimum(high[nodes], point).sum(axis=1, dtype=np.int64)
                nodes = nodes[(num + den) * bound >= num * (size + low_n[nodes])]
            if depth and len(nodes):
                below = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = below[below < len(self.levels[depth - 1][0])]
        return nodes


def link_tiles(nodes: list[int], sets: list[np.ndarray], points: np.ndarray, home: np.ndarray, num: int, den: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what is connected among ``nodes``; ``home`` tells the tile, and tiles 0 and 1 are joined.

    With one tile all pairs count, with two those across. Nodes of the same ``known`` label, or connected by a link
    found before, are not compared. A link holds if den * |a and b| >= num * |a or b|.
    """
    sizes = np.array([len(s) for s in sets])
    left = np.flatnonzero(home == 0)
    right = np.flatnonzero(home == 1) if home.any() else left
    order = right[np.lexsort((points[right, 0], sizes[right]))]
    tree, links = CountTree(points[order], sizes[order]), []
    label = np.unique(known, return_inverse=True)[1] if known is not None else np.arange(len(nodes))
    codes = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)[1]
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.concatenate([codes[cuts[j] : cuts[j + 1]] for j in order.tolist()] or [codes[:0]])
    starts = np.concatenate(([0], np.cumsum(sizes[order])))
    mark = np.zeros(len(codes) + 1, bool)
    for i in left.tolist():
        apart = label[order] != label[i]
        if not apart.any():
            continue
        near = tree.reach(points[i], int(sizes[i]), num, den)
        near = near[apart[near]]
        if not len(near):
            continue
        mine = codes[cuts[i] : cuts[i + 1]]
        mark[mine] = True
        if 4 * sizes[order[near]].sum() < len(flat):
            both = np.array([np.count_nonzero(mark[flat[starts[j] : starts[j + 1]]]) for j in near.tolist()])
        else:
            both = np.add.reduceat(mark[flat], starts[:-1], dtype=np.int64)[near]
        mark[mine] = False
        union = sizes[i] + sizes[order[near]] - both
        for j in order[near[den * both >= num * union]].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                links.append((nodes[i], nodes[j]))
    return links


def near_duplicates(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, tile: int = 1024, max_broadcast_ids: int = 2_000_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Groups of documents that links connect: den * |intersection| >= num * |union| of their k-word shingle sets.

    Returns a row for each row of ``docs``: doc_id, n_shingles (long), component_id, the smallest doc_id reachable by
    links, itself included. With ``keep``, names of more columns of ``docs``, also group_id (long: the same for all
    rows of a group, null without a set) and these columns. Equal sets are one node from the start. Exact: no link
    between different sets is lost and no partner is capped (sets and shingles are told apart by 64-bit hashes).

    Words are runs without ASCII white space, A-Z lower-cased; fewer than k words are one shingle. Null or empty texts
    have no set, n_shingles 0, and are linked with nothing. Null ids never name a component unless it has no other
    id; repeated rows, and rows of one id with different texts, are nodes alike. Other columns are ignored. An empty
    table gives an empty result.
    """
    counters = docs.sparkSession.sparkContext.broadcast(popularity(docs, k))
    kept = [f"_k{i}" for i in range(len(keep))]
    given = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, kept, strict=True)])

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, row = counters.value, 0
        for batch in common.slices(batches):
            names, counts, keys, shorts, points = [], [], [], [], []
            for s in shingle_sets(common.texts_of(batch), k):
                n = len(s)
                shorts.append(n - -(-2 * num * n // (num + den)) + 1)
                names.append(set_name(s) if n else None)
                counts.append(n)
                first = np.argsort(table[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)], kind="stable")[: n - -(-num * n // den) + 1]
                keys.append(s[first].view(np.int64))
                points.append(point_of(s) if n else None)
            salt, row = np.arange(row, row + batch.num_rows, dtype=np.int32) % SALTS, row + batch.num_rows
            columns = [batch.column("doc_id"), batch.column("th"), pa.array(salt), pa.array(names, pa.int64()), pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(shorts, pa.int32()), pa.array(points, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in kept)], names=["doc_id", "th", "salt", "node", "n", "keys", "short", "point", *kept])

    schema = T.StructType([*T.StructType.fromDDL("doc_id long, th long, salt int, node long, n long, keys array<long>, short int, point binary").fields, *(given.schema[c] for c in kept)])
    described = common.materialise(given.mapInArrow(describe, schema))
    rows = described.select("doc_id", "salt", "node", "n", *kept)
    # equal sets meet in two steps, so that a text that a third of all rows have is spread over SALTS tasks
    where = F.coalesce(F.min_by("th", "doc_id"), F.min("th")).alias("th")
    parts = common.materialise(described.where("node is not null").groupBy("node", "salt").agg(F.min("doc_id").alias("low"), where))
    lowest = common.materialise(parts.groupBy("node").agg(F.min("low").alias("low"), F.coalesce(F.min_by("th", "low"), F.min("th")).alias("th")))
    nodes = common.materialise(described.where("n > 0").select("node", "n", "keys", "short", "point").dropDuplicates(["node"]))
    by_parts = lambda hot: _parts_of(docs, hot.join(lowest, "node"), k, num, den, max_broadcast_ids)
    family = common.materialise(connected_components(_family_edges(nodes, num, den, by_parts)))
    wanted = common.materialise(family.join(lowest, "node").select("node", "component", "low", "th"))
    sets = _sets_of(docs, wanted, k, max_broadcast_ids)
    groups = common.materialise(connected_components(_family_links(sets, num, den, tile)))
    least = groups.join(lowest, "node").groupBy("component").agg(F.min("low").alias("least"))
    named = groups.join(common.broadcast_if_small(least, max_broadcast_ids), "component")
    named = lowest.join(named, "node", "left").select("node", F.coalesce("least", "low").alias("least"), F.coalesce("component", "node").alias("group_id"))
    told = parts.select("node", "salt").join(named, "node").select(F.col("node").alias("_node"), F.col("salt").alias("_salt"), "least", "group_id")
    joined = rows.join(told, (F.col("node") == F.col("_node")) & (F.col("salt") == F.col("_salt")), "left")
    extra = ["group_id", *[F.col(n).alias(c) for c, n in zip(keep, kept, strict=True)]] if keep else []
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), *extra)


def _family_edges(nodes: DataFrame, num: int, den: int, by_parts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (a, b) that put into one family whoever may be similar; nodes: (node, n, keys, short, point), once each.

    ``by_parts`` gives (node, key) of the parts of some nodes' sets.
    """
    keys = nodes.select("node", "n", F.posexplode("keys").alias("pos", "key"), "short").withColumn("short", F.col("pos") < F.col("short"))
    counts = keys.groupBy("key").agg(F.count("*").alias("m"), F.sum(F.col("short").cast("int")).alias("s"))
    counts = common.materialise(counts.where("m > 1 and s > 0").select("key", "m"))
    # fewer than (all keys) / SHARERS rows
    hot = common.broadcast_if_small(counts.where(F.col("m") > SHARERS).select("key"), 1_000_000)
    points = nodes.select("node", "n", "point")
    few = keys.drop("n", "pos").join(counts.where(F.col("m") <= SHARERS).select("key"), "key")
    near = _bounded_edges(few.join(points, "node"), num, den)
    many = common.materialise(keys.join(hot, "key").select("node").distinct())
    if many.isEmpty():
        return near
    parts = common.materialise(by_parts(many))
    sizes = common.materialise(parts.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("head")).where("m > 1"))
    stars = parts.join(common.broadcast_if_small(sizes.where(F.col("m") > PART_SHARERS), 1_000_000), "key").select(F.col("node").alias("a"), F.col("head").alias("b"))
    some = parts.join(sizes.where(F.col("m") <= PART_SHARERS).select("key"), "key").withColumn("short", F.lit(True))
    found = _bounded_edges(some.join(points, "node"), num, den)
    return near.unionByName(found).unionByName(stars.where("a <> b").distinct())


def _bounded_edges(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that connect whom the bound can't tell apart among sharers of a key; rows: (key, node, n, short, point).

    Of a pair the smaller set has to be ``short``.

    A task goes through its keys one after another and keeps, beside the points of one key, whom it has connected;
    who is connected already is not compared again.
    """

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, key, held = UnionFind(), None, []

        def settle() -> list[tuple[int, int]]:
            found = []
            if len(held) < 2 or not any(x[3] for x in held[:-1]):
                return found
            nodes = [x[0] for x in held]
            label = np.array([sets.find(x) for x in nodes])
            if (label == label[0]).all():
                return found
            sizes, points = np.array([x[1] for x in held]), read_points([x[2] for x in held])
            tree = CountTree(points, sizes) if len(held) > FANOUT else None
            for i in range(len(held) - 1):
                if not held[i][3]:
                    continue
                apart = label != label[i]
                if not apart[i + 1 :].any():
                    continue
                if tree:
                    others = tree.reach(points[i], int(sizes[i]), num, den)
                    others = others[others > i]
                else:  # one leaf; rows come by size
                    last = int(np.searchsorted(sizes * num, sizes[i] * den, side="right"))
                    bound = np.minimum(points[i], points[i + 1 : last]).sum(axis=1)
                    others = i + 1 + np.flatnonzero((num + den) * bound >= num * (sizes[i] + sizes[i + 1 : last]))
                for j in others[apart[others]].tolist():
                    if label[i] != label[j]:
                        sets.join(nodes[i], nodes[j])
                        found.append((nodes[i], nodes[j]))
                        label[(label == label[i]) | (label == label[j])] = min(label[i], label[j])
            return found

        for batch in batches:
            found = []
            for k, node, n, point, short in zip(*(batch.column(c).to_pylist() for c in ("key", "node", "n", "point", "short")), strict=True):
                if k != key:
                    found += settle()
                    key, held = k, []
                held.append((node, n, point, short))
            yield _edge_batch(found)
        yield _edge_batch(settle())

    return rows.select("key", "node", "n", "point", "short").repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(compare, "a long, b long")


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _texts_of(docs: DataFrame, wanted: DataFrame, max_broadcast_ids: int, *more: str) -> DataFrame:
    """(node, text, ...) for ``wanted`` (node, low, th, ...): a node's text is found by its hash and its least id."""
    asked = common.broadcast_if_small(wanted.select("node", F.col("low").alias("_low"), F.col("th").alias("_th"), *more), max_broadcast_ids)
    found = (F.xxhash64("text") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_low"))
    return docs.select("doc_id", "text").join(asked, found).select("node", "text", *more)


def _parts_of(docs: DataFrame, wanted: DataFrame, k: int, num: int, den: int, max_broadcast_ids: int) -> DataFrame:
    """(node, key) for all parts of the nodes' sets."""

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, target=1 << 17):
            names, keys = [], []
            for s, node in zip(shingle_sets(common.texts_of(batch), k), batch.column("node").to_pylist(), strict=True):
                if len(s) and set_name(s) == node:
                    keys.append(part_keys(s, num, den))
                    names.append(np.full(len(keys[-1]), node, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (names, keys)], names=["node", "key"])

    return _texts_of(docs, wanted, max_broadcast_ids).mapInArrow(collect, "node long, key long").distinct()


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int, max_broadcast_ids: int) -> DataFrame:
    """(component, node, n, members, point) of the nodes in families: only these sets are ever moved.

    A node's text is found by its hash and its least id, so many rows of one id, or of none, don't meet each other.
    """

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            keep, names, sizes, members, points = [], [], [], [], []
            for i, (s, node) in enumerate(zip(shingle_sets(common.texts_of(batch), k), batch.column("node").to_pylist(), strict=True)):
                if len(s) and set_name(s) == node:
                    keep.append(i)
                    names.append(node)
                    sizes.append(len(s))
                    members.append(s.tobytes())
                    points.append(point_of(s))
            columns = [batch.column("component").take(pa.array(keep, pa.int32())), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(members, pa.binary()), pa.array(points, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["component", "node", "n", "members", "point"])

    texts = _texts_of(docs, wanted, max_broadcast_ids, "component")
    sets = texts.mapInArrow(collect, "component long, node long, n long, members binary, point binary")
    return common.materialise(sets.dropDuplicates(["node"]))


def _dealt(placed: DataFrame, by: list[str], tile: int) -> DataFrame:
    """``placed`` with ``c`` and ``part``: at most about ``tile`` nodes, and TILE_SHINGLES shingles, for each value of ``by`` and both."""
    classed = placed.withColumn("c", F.floor(F.log2("n") * 4))
    sizes = classed.groupBy(*by, "c").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    sizes = sizes.withColumn("parts", F.ceil(F.greatest(F.col("m") / tile, F.col("w") / TILE_SHINGLES)).cast("int")).drop("m", "w")
    sized = classed.join(common.broadcast_if_small(sizes, 1_000_000), [*by, "c"])
    return sized.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def _family_links(sets: DataFrame, num: int, den: int, tile: int) -> DataFrame:
    """Links (a, b) inside families: within tiles first, then between tiles that are not of one component by then."""
    slim = sets.select("component", "node", "n")
    large = slim.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("w")).where((F.col("m") > tile) | (F.col("w") > TILE_SHINGLES)).select("component")
    large = common.materialise(large)  # fewer than nodes / tile rows, apart from families of very long texts
    known = common.broadcast_if_small(large, 1_000_000)
    small = slim.join(known, "component", "left_anti").select("component", F.lit(0).cast("long").alias("c"), F.lit(0).alias("part"), "node")
    placed = common.materialise(_dealt(slim.join(known, "component"), ["component"], tile))
    # visitors go to parts 1, 2, 4, ... further on in their class, and to one of the next class
    guests = placed.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(max(1, min(VISITOR, tile // 2)))) == 0)
    hops = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.col("parts").cast("double"))).cast("int")), lambda j: F.pmod(F.col("part") + F.pow(F.lit(2), j).cast("int"), F.col("parts")))
    within = guests.select("component", "c", F.explode(F.array_distinct(hops)).alias("part"), "node")
    above = placed.select("component", (F.col("c") - 1).alias("c"), F.col("parts").alias("_above")).distinct()
    onward = guests.join(above, ["component", "c"]).select("component", (F.col("c") + 1).alias("c"), F.pmod("part", "_above").alias("part"), "node")
    own = placed.select("component", "c", "part", "node")
    pooled = own.unionByName(within).unionByName(onward).distinct().unionByName(small)

    def within_tile(table: pa.Table) -> pa.Table:
        return _links_of(table, np.zeros(len(table), np.int8), num, den)

    held = sets.select("node", "members", "point")
    first = common.materialise(pooled.join(held, "node").groupBy("component", "c", "part").applyInArrow(within_tile, "a long, b long"))
    if large.isEmpty():
        return first
    return first.unionByName(_links_between(placed.select("component", "node", "n"), first, held, num, den, tile))


def _links_of(table: pa.Table, home: np.ndarray, num: int, den: int, known: np.ndarray | None = None) -> pa.Table:
    members = [np.frombuffer(x, np.uint64) for x in table["members"].to_pylist()]
    found = link_tiles(table["node"].to_pylist(), members, read_points(table["point"].to_pylist()), home, num, den, known)
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def _links_between(slim: DataFrame, first: DataFrame, held: DataFrame, num: int, den: int, tile: int) -> DataFrame:
    """Links between tiles of large families, dealt by the components that ``first`` makes.

    A component of a quarter tile or more has tiles of its own, the rest shares tiles. Tiles meet if the bound of
    their corners lets them, but not if both are of one component.
    """
    label = connected_components(first).select("node", F.col("component").alias("label"))
    named = common.materialise(slim.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    own = named.groupBy("label").agg(F.count("*").alias("m")).where(F.col("m") * 4 >= tile).select("label", F.col("label").alias("own"))
    whole = named.join(common.broadcast_if_small(own, 1_000_000), "label", "left").withColumn("own", F.coalesce(F.col("own").cast("string"), F.lit("")))
    placed = _dealt(whole, ["component", "own"], tile).withColumn("tile", F.concat_ws("/", "own", F.col("c").cast("string"), F.col("part").cast("string")))
    placed = common.materialise(placed.select("component", "node", "n", "label", "own", "tile"))

    def corner(table: pa.Table) -> pa.Table:
        n = table["n"].to_numpy()
        row = [table[c][0].as_py() for c in ("component", "own", "tile")] + [int(n.min()), int(n.max()), read_points(table["point"].to_pylist()).max(axis=0)]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        return pa.table({c: pa.array([v], k) for c, v, k in zip(("component", "own", "tile", "low", "high", "corner"), row, kinds, strict=True)})

    pointed = placed.select("component", "own", "tile", "node", "n").join(held.select("node", "point"), "node")
    tiles = common.materialise(pointed.groupBy("component", "own", "tile").applyInArrow(corner, "component long, own string, tile string, low long, high long, corner array<int>"))
    left = tiles.select("component", F.col("own").alias("o1"), F.col("tile").alias("i"), F.col("low").alias("l1"), F.col("high").alias("h1"), F.col("corner").alias("c1"))
    right = tiles.select("component", F.col("own").alias("o2"), F.col("tile").alias("j"), F.col("low").alias("l2"), F.col("high").alias("h2"), F.col("corner").alias("c2"))
    bound = F.aggregate(F.zip_with("c1", "c2", lambda x, y: F.least(x, y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    meet = left.join(right, "component").where("i <= j").where("o1 = '' or o1 <> o2")
    meet = meet.where((F.col("h1") * den >= F.col("l2") * num) & (F.col("h2") * den >= F.col("l1") * num) & ((num + den) * bound >= num * (F.col("l1") + F.col("l2"))))
    meet = meet.select("component", "i", "j")
    spread = meet.select("component", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    dealt = placed.select("component", "node", "label", "tile").join(spread, ["component", "tile"]).join(held, "node")

    def link(table: pa.Table) -> pa.Table:
        home = (np.asarray(table["tile"]) != np.asarray(table["i"])).astype(np.int8)
        return _links_of(table, home, num, den, table["label"].to_numpy())

    return dealt.select("component", "i", "j", "tile", "node", "label", "members", "point").groupBy("component", "i", "j").applyInArrow(link, "a long, b long")
