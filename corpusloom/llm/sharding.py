"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common


class RoomTree:
    """Open bins (room, number) in an AVL tree, so that the tightest bin with enough room is found in logarithmic time."""

    def __init__(self):
        self.root = None  # node: [key, left, right, height]

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._add(self.root, key)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least room of at least ``size``, ties to the lower number."""
        best, node = None, self.root
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[1]
            else:
                node = node[2]
        if best is not None:
            self.root = self._drop(self.root, best)
        return best

    @staticmethod
    def _height(node) -> int:
        return node[3] if node is not None else 0

    def _level(self, node):
        """``node`` with both sides' heights at most one apart."""
        lean = self._height(node[1]) - self._height(node[2])
        if abs(lean) > 1:
            high, low = (1, 2) if lean > 0 else (2, 1)
            if self._height(node[high][low]) > self._height(node[high][high]):
                node[high] = self._turn(node[high], low)
            return self._turn(node, high)
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        return node

    def _turn(self, node, side: int):
        """The child on ``side`` takes the place of ``node``."""
        top, other = node[side], 3 - side
        node[side], top[other] = top[other], node
        for x in (node, top):
            x[3] = 1 + max(self._height(x[1]), self._height(x[2]))
        return top

    def _add(self, node, key):
        if node is None:
            return [key, None, None, 1]
        side = 1 if key < node[0] else 2
        node[side] = self._add(node[side], key)
        return self._level(node)

    def _drop(self, node, key):
        if key == node[0]:
            if node[1] is None or node[2] is None:
                return node[1] if node[2] is None else node[2]
            least = node[2]
            while least[1] is not None:
                least = least[1]
            node[0] = key = least[0]
            node[2] = self._drop(node[2], key)
        else:
            side = 1 if key < node[0] else 2
            node[side] = self._drop(node[side], key)
        return self._level(node)


def best_fit_decreasing(items: list[tuple[int, object]], capacity: int, most: int | None = None) -> dict[object, int] | None:
    """Bins of ``items`` (size, name): the largest first, each into the tightest bin that has room, else a new bin.

    Open bins are in a balanced tree by remaining room, ties by number. An item above ``capacity`` does not fit any
    bin; then, and if more than ``most`` bins are needed, there is no packing (None).
    """
    room, placed, bins = RoomTree(), {}, 0
    for size, name in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        found = room.take(size)
        if found is None:
            if most is not None and bins >= most or size > capacity:
                return None
            found, bins = (capacity, bins), bins + 1
        left, bin_ = found
        placed[name] = bin_
        room.add((left - size, bin_))
    return placed


def pack_bins(items: list[tuple[int, object]], bins: int) -> dict[object, int]:
    """``items`` in at most ``bins`` bins of near equal sizes.

    An item above the fair share of what is left has a bin of its own, as nothing that can be done with the others
    makes that bin smaller; the rest are packed at the smallest capacity for which the bins that are left are enough.
    """
    rest, own = sorted(items, key=lambda x: (-x[0], str(x[1]))), []
    total = sum(s for s, _ in rest)
    while rest and len(own) < bins - 1 and rest[0][0] * (bins - len(own)) > total:
        total -= rest[0][0]
        own.append(rest.pop(0))
    placed = {name: i for i, (_, name) in enumerate(own)}
    return placed | {name: bin_ + len(own) for name, bin_ in tightest(rest, bins - len(own)).items()}


def tightest(items: list[tuple[int, object]], bins: int) -> dict[object, int]:
    """Best fit at the smallest capacity found by halving for which ``bins`` bins are enough."""
    total, largest = sum(s for s, _ in items), max((s for s, _ in items), default=0)
    low, high = max(largest, -(-total // bins)), max(largest, -(-total // bins)) * 2 + 1
    best = None
    while low <= high:
        middle = (low + high) // 2
        if (found := best_fit_decreasing(items, middle, bins)) is not None:
            best, high = found, middle - 1
        else:
            low = middle + 1
    return best or {}


def pack_shards(docs: DataFrame, shards: int = 16, grain: int = 1024) -> DataFrame:
    """Put all documents into ``shards`` shards of near equal bytes; equal texts stay in one shard.

    A group of equal texts is one item, of the bytes of all its rows (UTF-8 plus 1 each), and is never divided: one
    above a shard's fair share is alone in its shard, and the other shards are of near equal bytes among themselves.
    Groups smaller than 1 / (shards x grain) of all bytes are first bundled, in order of their digest, into items of
    about that size, so best-fit-decreasing meets at most 2 x shards x grain + shards items however large the table is.

    Returns doc_id, size, text_crc32, shard (int) and slot (long, gapless from 0 in each shard, by doc_id and digest).
    Shards and slots follow from ids and texts, not from how rows are dealt to files; rows alike in both are
    interchangeable. Null text counts as empty; null ids and repeated rows are placed as any other row; an empty table
    gives an empty result. A shard can stay empty when there are fewer items than shards.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.unhex(F.md5(text)).alias("digest"))
    base = common.materialise(base.withColumn("_row", F.monotonically_increasing_id()).withColumn("_salt", F.pmod(F.col("_row"), F.lit(64)).cast("int")))
    total = base.agg(F.sum("size")).first()[0] or 0
    small = max(1, total // (shards * grain))
    parts = common.materialise(base.groupBy("digest", "_salt").agg(F.sum("size").alias("bytes")))
    items = common.materialise(parts.groupBy("digest").agg(F.sum("bytes").alias("bytes")))
    tail = common.running_sums(items.where(F.col("bytes") < small), ["digest"], {"upto": "bytes"})
    bundle = F.floor((F.col("upto") - F.col("bytes")) / small)
    named = tail.select("digest", "bytes", F.concat(F.lit("bundle-"), bundle.cast("string")).alias("packed"))
    named = common.materialise(named.unionByName(items.where(F.col("bytes") >= small).select("digest", "bytes", F.hex("digest").alias("packed"))))
    packed = [(r["bytes"], r["packed"]) for r in named.groupBy("packed").agg(F.sum("bytes").alias("bytes")).collect()]  # bounded, see above
    placed = docs.sparkSession.createDataFrame(list(pack_bins(packed, shards).items()) or [], "packed string, shard int")
    shard_of = named.join(F.broadcast(placed), "packed").select("digest", "shard")
    # a text that very many rows have meets its shard in 64 parts
    spread = parts.select("digest", "_salt").join(shard_of, "digest")
    rows = base.join(spread, ["digest", "_salt"]).select("doc_id", "size", "text_crc32", "shard", "digest", "_row", F.lit(1).alias("_one"))
    lined = common.running_sums(rows, ["shard", "doc_id", "digest", "_row"], {"_upto": "_one"})
    starts = F.broadcast(lined.groupBy(F.col("shard").alias("_s")).agg(F.min("_upto").alias("_first")))  # a row for each shard
    slots = lined.join(starts, F.col("shard") == F.col("_s"))
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("_upto") - F.col("_first")).cast("long").alias("slot"))
