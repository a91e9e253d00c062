"""Vectors as 8-bit codes, candidate buckets for pairs, and a stored index of cells for top-k.

Codes are bytes, one a component, in binary columns: a quarter of the floats on disk, in shuffles and in memory. A row
also carries how far its code is from its vector, which bounds the error of any product of codes, so that nothing that
could qualify is lost before the exact score is worked out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import vectors as V
from corpusloom.operators import retrieval as R
from corpusloom.sources.scratch import materialise

#: Rows of one side of a bucket that are compared at a time.
TILE = 1024
#: Cells of an index at most: their centroids go to all tasks.
MAX_CELLS = 16_384
#: Rows of a table that may be sent to all tasks.
SMALL = 1_000_000


def pack(m: np.ndarray, scale: float) -> np.ndarray:
    """Whole steps of ``scale``, halves up, within -127 to 127, a byte each."""
    return np.clip(np.floor(m / scale + 0.5), -127, 127).astype(np.int8)


def unpack(codes: pa.Array, dims: int) -> np.ndarray:
    """Codes as a matrix for products: whole numbers, which the float type chosen holds exactly for that many components."""
    data = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(-1, dims)
    return data.astype(np.float32 if dims * 127 * 127 < 1 << 24 else np.float64)


def as_binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def code_scale(chunks: DataFrame) -> float:
    """One pass over the vectors: the step of their codes."""
    return R.quantize_scale(chunks).first()[0]


def encode(chunks: DataFrame, scale: float, keep: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """The columns ``keep`` with ``code`` (binary) and ``off`` (double, the distance of the code from the vector); null vectors go."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = R._matrix(batch.column("vec"))
            codes = pack(m, scale)
            off = np.sqrt(((m - codes * scale) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), as_binary(codes), pa.array(off)], names=[*keep, "code", "off"])

    kept = chunks.where("vec is not null").select(*keep, "vec")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "vec")
    return kept.mapInArrow(run, f"{kinds}, code binary, off double")


def hint(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A broadcast hint where ``df`` is counted to have at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


# --- top-k by codes


def score_codes(codes: DataFrame, queries: DataFrame, scale: float, keep: int, max_queries: int = R.MAX_QUERIES) -> DataFrame:
    """(query_id, chunk_id, score): whole-number products of codes; at least the ``keep`` best of each query.

    ``codes`` (chunk_id, code) are read as they are, without a shuffle; ``queries`` (query_id, vec) are counted, and a
    larger set goes to the tasks a block of ``max_queries`` at a time. Queries without a vector get no rows.
    """
    queries = queries.where("vec is not null")
    most = R.queries_at_once(keep, max_queries)
    asked = queries.select("query_id", "vec").limit(most + 1).toArrow()
    if asked.num_rows > most:
        blocks = -(-queries.count() // most)
        parts = [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks)) == i) for i in range(2 * blocks)]
        found = [score_codes(codes, p, scale, keep, 4 * most) for p in parts]
        for more in found[1:]:
            found[0] = found[0].unionByName(more)
        return found[0]
    m = R._matrix(asked["vec"].combine_chunks())
    shared = queries.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(), pack(m, scale)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, small = shared.value
        mine = small.astype(np.float32 if small.shape[1] * 127 * 127 < 1 << 24 else np.float64)
        best = R._Best(len(ids), keep)
        for batch in batches:
            for at in range(0, batch.num_rows if len(ids) else 0, R.ROWS):
                part = batch.slice(at, R.ROWS)
                R._rank_all(best, mine, unpack(part.column("code"), mine.shape[1]), part.column("chunk_id").to_numpy())
        yield R._scored(ids, best)

    return codes.select("chunk_id", "code").mapInArrow(run, R.SCORED)


def rescore(coarse: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best of ``coarse`` (query_id, chunk_id, score) by exact product, ties by coarse score, then chunk."""
    picked = hint(coarse.select("query_id", "chunk_id", F.col("score").alias("dot")))
    both = chunks.select("chunk_id", "vec").join(picked, "chunk_id").join(hint(queries.select("query_id", F.col("vec").alias("qvec"))), "query_id")
    return R.top_k(both.select("query_id", "chunk_id", "dot", V.dot(F.col("vec"), F.col("qvec")).alias("score")), k, "query_id", F.desc("dot"), "chunk_id").drop("dot")


def coarse_topk(codes: DataFrame, chunks: DataFrame, queries: DataFrame, scale: float, k: int = 10, oversample: int = 8) -> DataFrame:
    """Top-k by stored codes: k * oversample by products of codes, then exact scores of these alone."""
    dots = score_codes(codes, queries, scale, k * oversample)
    coarse = materialise(R.top_k(dots, k * oversample, "query_id", "chunk_id").drop("rank"))
    return rescore(coarse, chunks, queries, k)


# --- candidate buckets for pairs


@dataclass(frozen=True)
class SignTables:
    """Tables of sign projections: a vector's key in a table says on which side of ``bits`` random planes it lies.

    Two vectors of cosine c agree on a plane with probability 1 - acos(c) / pi. ``fit`` takes so many bits that a bucket
    of unlike vectors stays small and so many tables that a pair at the threshold meets with probability ``recall``.
    """

    bits: int
    tables: int
    seed: int = 7

    @classmethod
    def fit(cls, rows: int, min_score: float, recall: float = 0.97) -> SignTables:
        agree = 1 - math.acos(max(-1.0, min(1.0, min_score))) / math.pi
        bits = max(2, min(30, math.ceil(math.log2(max(2, rows) / 64))))
        return cls(bits, max(1, math.ceil(math.log(1 - recall) / math.log(max(1e-12, 1 - agree**bits)))) if agree < 1 else 1)

    def keys(self, m: np.ndarray) -> np.ndarray:
        """A row of keys, one for each table."""
        planes = np.random.default_rng(self.seed).normal(size=(m.shape[1], self.bits * self.tables))
        signs = (m @ planes > 0).reshape(len(m), self.tables, self.bits)
        return (signs @ (1 << np.arange(self.bits))).astype(np.int32)


def vector_classes(chunks: DataFrame) -> DataFrame:
    """(chunk_id, class_id): the least chunk with an equal vector (of other rows' equal vectors too, whatever their note)."""
    key = F.xxhash64("vec")
    # equal vectors meet by aggregates that combine before the shuffle; the class comes back by a join on the hash
    least = chunks.where("vec is not null").groupBy(key.alias("h"), "vec").agg(F.min("chunk_id").alias("class_id"))
    return chunks.select("chunk_id", key.alias("h"), "vec").join(least, ["h", "vec"]).select("chunk_id", "class_id")


def near_pairs(chunks: DataFrame, min_score: float = 0.92, tables: SignTables | None = None, recall: float = 0.97) -> DataFrame:
    """(a, b, score) with a < b: different unit vectors with cosine of at least ``min_score``, each by its least chunk_id.

    Equal vectors are one (``vector_classes`` tells the members). Pairs are dropped where all chunks of both are of one
    note. Candidates share a bucket of one of ``tables``; a pair is compared in the first table that it shares, by codes
    with their error bound, and what may qualify gets its exact score. A bucket above TILE rows is cut into parts that
    meet pairwise, so no task holds more than two. ``retrieval.similar_pairs`` is the exact way; expect at least
    ``recall`` of its pairs. Null vectors have no pairs; an empty table gives an empty result.
    """
    one = chunks.where("vec is not null").groupBy("vec").agg(F.min("chunk_id").alias("chunk_id"), F.min("note_path").alias("lo"), F.max("note_path").alias("hi"))
    one = materialise(one)
    tables = tables or SignTables.fit(one.count(), min_score, recall)
    scale = code_scale(one)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                m, n = R._matrix(part.column("vec")), part.num_rows
                keys, codes = tables.keys(m), pack(m, scale)
                off, norm = np.sqrt(((m - codes * scale) ** 2).sum(axis=1)), np.sqrt((m**2).sum(axis=1))
                each = np.repeat(np.arange(n), tables.tables)
                columns = [pa.array(np.tile(np.arange(tables.tables, dtype=np.int32), n)), pa.array(keys.ravel()), part.column("chunk_id").take(pa.array(each)), as_binary(codes[each]), pa.array(off[each]), pa.array(norm[each]), as_binary(keys[each])]
                yield pa.RecordBatch.from_arrays(columns, names=["t", "key", "chunk_id", "code", "off", "norm", "keys"])

    dealt = materialise(one.select("chunk_id", "vec").mapInArrow(deal, "t int, key int, chunk_id long, code binary, off double, norm double, keys binary"))
    sizes = dealt.groupBy("t", "key").agg(F.count("*").alias("m")).where("m > 1")
    placed = dealt.join(sizes.withColumn("parts", F.ceil(F.col("m") / TILE).cast("int")).drop("m"), ["t", "key"])
    placed = placed.withColumn("x", F.pmod(F.xxhash64("chunk_id"), F.col("parts")).cast("int"))
    spread = placed.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    spread = spread.select("t", "key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), (F.col("x") <= F.col("y")).alias("first"), "chunk_id", "code", "off", "norm", "keys")

    def compare(table: pa.Table) -> pa.Table:
        t, same = table["t"][0].as_py(), table["i"][0].as_py() == table["j"][0].as_py()
        ids, first = table["chunk_id"].to_numpy(), np.asarray(table["first"])
        codes = np.frombuffer(b"".join(table["code"].to_pylist()), np.int8).reshape(len(ids), -1).astype(np.float32)
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.int32).reshape(len(ids), -1)
        off, norm = table["off"].to_numpy(), table["norm"].to_numpy()
        left, right = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(first), np.flatnonzero(~first))
        out = [(np.zeros(0, np.int64),) * 2]
        for s in range(0, len(left), 256):
            x = left[s : s + 256]
            # |ab - a'b'| <= |a - a'||b| + |a'||b - b'|
            slack = off[x][:, None] * norm[right] + (norm[x] + off[x])[:, None] * off[right] + 1e-6
            u, v = np.nonzero((codes[x] @ codes[right].T).astype(np.float64) * scale**2 + slack >= min_score)
            u, v = x[u], right[v]
            some = ids[u] < ids[v] if same else np.ones(len(u), bool)
            u, v = u[some], v[some]
            new = (keys[u, :t] != keys[v, :t]).all(axis=1)
            out.append((np.minimum(ids[u], ids[v])[new], np.maximum(ids[u], ids[v])[new]))
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = spread.groupBy("t", "key", "i", "j").applyInArrow(compare, "a long, b long")
    of = lambda side: one.select(F.col("chunk_id").alias(side), F.col("vec").alias(f"v{side}"), F.col("lo").alias(f"lo{side}"), F.col("hi").alias(f"hi{side}"))
    scored = met.join(of("a"), "a").join(of("b"), "b").withColumn("score", V.dot(F.col("va"), F.col("vb")))
    apart = ~(F.col("loa").eqNullSafe(F.col("hia")) & F.col("lob").eqNullSafe(F.col("hib")) & F.col("loa").eqNullSafe(F.col("lob")))
    return scored.where(F.col("score") >= min_score).where(apart).select("a", "b", "score")


# --- a stored index of cells


def fit_centroids(chunks: DataFrame, cells: int, sample: int = 100_000, rounds: int = 12) -> np.ndarray:
    """Unit centroids by k-means on a bounded sample: the ``sample`` chunks with the least hash of their id."""
    picked = chunks.where("vec is not null").orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vec").toArrow()
    m = R._matrix(picked["vec"].combine_chunks()) if picked.num_rows else np.zeros((0, 1))
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    m = np.unique(m, axis=0)
    rng = np.random.default_rng(3)
    centroids = m[rng.permutation(len(m))[: max(1, min(cells, len(m)))]] if len(m) else np.zeros((1, 1))
    for _ in range(rounds if len(m) else 0):
        nearest = np.concatenate([(m[i : i + 4096] @ centroids.T).argmax(axis=1) for i in range(0, len(m), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, m)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-12), centroids)
        if np.allclose(moved, centroids, atol=1e-9):
            break
        centroids = moved
    return centroids


def write_index(chunks: DataFrame, folder: str, cells: int | None = None, rows_a_file: int = 1 << 20, sample: int = 100_000) -> None:
    """Assign every vector to its nearest centroid and store it with its code below ``folder``, a folder a cell.

    ``cells`` is the square root of the number of vectors if not given, MAX_CELLS at most. A cell of more than
    ``rows_a_file`` rows is dealt to several tasks and files, so a cell that holds a third of all rows is no task's. Beside the
    vectors, ``cells`` holds each centroid with its number of rows and its widest angle. Null vectors are left out.
    """
    spark = chunks.sparkSession
    n = chunks.count()
    cells = min(MAX_CELLS, cells or max(1, round(math.sqrt(n))))
    centroids, scale = fit_centroids(chunks, cells, sample), code_scale(chunks)
    shared, step = spark.sparkContext.broadcast(centroids), max(1, R.PRODUCTS // max(1, len(centroids)))

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                m = R._matrix(part.column("vec"))
                scores = m @ shared.value.T
                cell, norm = scores.argmax(axis=1), np.maximum(np.linalg.norm(m, axis=1), 1e-12)
                angle = np.arccos(np.clip(scores.max(axis=1) / norm, -1, 1))
                columns = [*part.columns, pa.array(cell.astype(np.int32)), pa.array(angle), pa.array(norm), as_binary(pack(m, scale))]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk_id", "note_path", "vec", "cell", "angle", "norm", "code"])

    given = chunks.where("vec is not null").select("chunk_id", "note_path", "vec")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema)
    placed = materialise(given.mapInArrow(assign, f"{kinds}, cell int, angle double, norm double, code binary"))
    told = placed.groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("angle"), F.max("norm").alias("norm"))
    told = {r.cell: r for r in told.collect()}  # a row for each cell
    sizes = spark.createDataFrame([(c, -(-r.rows // rows_a_file)) for c, r in told.items()], "cell int, files long")
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("files")))
    dealt.repartition("cell", "part").drop("files", "part", "angle", "norm").write.option("maxRecordsPerFile", rows_a_file).partitionBy("cell").parquet(f"{folder}/vectors")
    rows = [(c, centroids[c].tolist(), r.rows, r.angle, r.norm, scale) for c, r in told.items()]
    spark.createDataFrame(rows, "cell int, centroid array<double>, rows long, angle double, norm double, scale double").coalesce(1).write.parquet(f"{folder}/cells")


class VectorIndex:
    """Reads what ``write_index`` has stored; a search scans only the cells that it probes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        told = spark.read.parquet(f"{folder}/cells").orderBy("cell").toArrow()  # MAX_CELLS rows at most
        self.cells = told["cell"].to_numpy()
        self.centroids = R._matrix(told["centroid"].combine_chunks()) if len(self.cells) else np.zeros((0, 1))
        self.rows, self.angle, self.norm = (told[c].to_numpy() for c in ("rows", "angle", "norm"))
        self.scale = told["scale"][0].as_py() if len(self.cells) else 1.0

    def vectors(self, cells: Iterable[int] | None = None) -> DataFrame:
        """The stored rows of some cells, or of all; cells are folders, so others are not read."""
        all_ = self.spark.read.parquet(f"{self.folder}/vectors") if len(self.cells) else self.spark.createDataFrame([], "chunk_id long, note_path string, vec array<float>, code binary, cell int")
        return all_ if cells is None else all_.where(F.col("cell").isin(sorted(map(int, cells))))

    def order(self, m: np.ndarray) -> np.ndarray:
        """Places of cells for each query, the nearest first."""
        return np.argsort(-(m @ self.centroids.T), axis=1, kind="stable")

    def calibrate(self, k: int = 10, target: float = 0.95, queries: int = 256) -> int:
        """Cells to probe for ``target`` recall: told by the exact nearest of ``queries`` stored vectors, in one scan."""
        stored = self.vectors()
        asked = materialise(stored.orderBy(F.xxhash64("chunk_id", F.lit(1)), "chunk_id").limit(queries).select(F.col("chunk_id").alias("query_id"), "vec"))
        truth = R.dense_topk(stored, asked, k).select("query_id", "chunk_id")
        where = truth.join(stored.select("chunk_id", "cell"), "chunk_id").groupBy("query_id").agg(F.collect_list("cell").alias("cells"))
        rows = where.join(asked, "query_id").toArrow()
        if not rows.num_rows:
            return 1
        order = self.cells[self.order(R._matrix(rows["vec"].combine_chunks()))]
        rank = np.argsort(order, axis=1)
        place = {c: i for i, c in enumerate(np.sort(self.cells).tolist())}
        needed = np.sort([rank[i, place[c]] for i, cells in enumerate(rows["cells"].to_pylist()) for c in cells])
        return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)]) + 1

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, oversample: int = 8, max_queries: int = R.MAX_QUERIES) -> DataFrame:
        """(query_id, chunk_id, score, rank): the k best of the ``probes`` nearest cells, by codes first, then exactly.

        Up to ``max_queries`` queries go to the tasks that scan the probed cells, and nothing is shuffled but each
        task's best. More queries meet their cells in groups of a cell's part and a block of its queries.
        """
        queries = queries.where("vec is not null")
        scored, cells = self._probe(queries, k * oversample, probes, max_queries)
        coarse = materialise(R.top_k(scored, k * oversample, "query_id", "chunk_id").drop("rank"))
        return rescore(coarse, self.vectors(cells), queries, k)

    def search_exact(self, queries: DataFrame, k: int = 10, probes: int = 8, max_queries: int = R.MAX_QUERIES) -> DataFrame:
        """The rows of ``retrieval.dense_topk``: after ``probes`` cells, all cells whose bound reaches the k-th score so far.

        No vector of a cell is nearer to a query than the angle between centroid and query, less the cell's widest.
        """
        queries = queries.where("vec is not null")
        asked = queries.select("query_id", "vec").limit(max_queries + 1).toArrow()
        if asked.num_rows > max_queries or not len(self.cells):
            return R.dense_topk(self.vectors(), queries, k)
        ids, m = asked["query_id"].to_numpy(), R._matrix(asked["vec"].combine_chunks())
        if not len(ids):
            return R.dense_topk(self.vectors(), queries, k)
        floor = {r.query_id: r.score for r in self.search(queries, k, probes).where(F.col("rank") == k).collect()}
        least = np.array([floor.get(i, -np.inf) for i in ids.tolist()])
        length = np.maximum(np.linalg.norm(m, axis=1), 1e-12)
        between = np.arccos(np.clip(m @ self.centroids.T / length[:, None] / np.maximum(np.linalg.norm(self.centroids, axis=1), 1e-12), -1, 1))
        bound = np.cos(np.maximum(0, between - self.angle)) * length[:, None]
        bound = np.where(bound > 0, bound * self.norm, np.where(self.norm > 0, 0, bound))
        needed = bound >= least[:, None] - 1e-9
        return R.dense_topk(self.vectors(self.cells[needed.any(axis=0)]), queries, k)

    def _probe(self, queries: DataFrame, keep: int, probes: int, max_queries: int) -> tuple[DataFrame, list[int] | None]:
        """Products of codes in the probed cells, and these cells (None: all)."""
        asked = queries.select("query_id", "vec").limit(max_queries + 1).toArrow()
        if asked.num_rows > max_queries:
            return self._probe_blocks(queries, keep, probes), None
        ids, m = asked["query_id"].to_numpy(), R._matrix(asked["vec"].combine_chunks())
        if not len(ids) or not len(self.cells):
            return self.spark.createDataFrame([], R.SCORED), []
        near = self.cells[self.order(m)[:, :probes]]
        by_cell: dict[int, list[int]] = {}
        for i, cells in enumerate(near.tolist()):
            for c in cells:
                by_cell.setdefault(c, []).append(i)
        shared = self.spark.sparkContext.broadcast((ids, pack(m, self.scale), {c: np.array(q) for c, q in by_cell.items()}))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, codes, asked = shared.value
            codes = codes.astype(np.float32 if codes.shape[1] * 127 * 127 < 1 << 24 else np.float64)
            best = R._Best(len(ids), keep)
            for batch in batches:
                cell = batch.column("cell").to_numpy()
                for c in np.unique(cell).tolist():
                    rows = batch.take(pa.array(np.flatnonzero(cell == c)))
                    for at in range(0, rows.num_rows, R.ROWS):
                        part = rows.slice(at, R.ROWS)
                        R._rank_all(best, codes[asked[c]], unpack(part.column("code"), codes.shape[1]), part.column("chunk_id").to_numpy(), asked[c])
            yield R._scored(ids, best)

        return self.vectors(by_cell).select("cell", "chunk_id", "code").mapInArrow(run, R.SCORED), list(by_cell)

    def _probe_blocks(self, queries: DataFrame, keep: int, probes: int, rows: int = 65_536, block: int = 4096) -> DataFrame:
        shared, cells, scale = self.spark.sparkContext.broadcast(self.centroids), self.cells, self.scale

        def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    m = R._matrix(part.column("vec"))
                    found = cells[np.argsort(-(m @ shared.value.T), axis=1, kind="stable")[:, :probes]]
                    each = np.repeat(np.arange(len(m)), found.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(found.ravel().astype(np.int32)), part.column("query_id").take(pa.array(each)), as_binary(pack(m, scale)[each])], names=["cell", "id", "code"])

        asked = materialise(queries.where("vec is not null").select("query_id", "vec").mapInArrow(near, "cell int, id long, code binary"))
        sizes = self.spark.createDataFrame([(int(c), int(-(-n // rows))) for c, n in zip(self.cells, self.rows, strict=True)], "cell int, parts int")
        blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # a row for each cell
        both = F.broadcast(sizes.join(blocks, "cell"))
        one = asked.join(both, "cell").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        stored = self.vectors().select("cell", F.col("chunk_id").alias("id"), "code")
        two = stored.join(both, "cell").withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = one.select("cell", "p", "b", "id", "code", F.lit(True).alias("asks")).unionByName(two.select("cell", "p", "b", "id", "code", F.lit(False).alias("asks")))

        def score(table: pa.Table) -> pa.Table:
            asks, ids = np.asarray(table["asks"]), table["id"].to_numpy()
            codes = unpack(table["code"].combine_chunks(), len(table["code"][0].as_py()))
            best = R._Best(int(asks.sum()), keep)
            R._rank_all(best, codes[asks], codes[~asks], ids[~asks])
            return pa.Table.from_batches([R._scored(ids[asks], best)])

        return met.groupBy("cell", "p", "b").applyInArrow(score, R.SCORED)
