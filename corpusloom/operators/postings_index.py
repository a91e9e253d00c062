"""BM25 from postings on storage: blocks of chunks whose bound can't reach a query's k-th score are not scored.

An index is a folder of segments, one for each added batch, under versions (``sources.versions``). A segment deals its
chunks to blocks of 64, chunks with like terms to one block, and has a row for each term and block: the postings, and
their impacts, the pairs (tf, dl) that no other posting of the row beats in both. As scores grow with tf and fall with
dl, the best impact is the row's exact largest score under any mean length, so bounds hold as segments come and go.
Rows are partitioned by a hash of the term; a term of many blocks fills several files.

A search adds up each block's bounds for each query, scores the few blocks with the highest, which gives a k-th score
to beat, and then scores only blocks whose bound reaches it. The rows are those of ``retrieval.bm25``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import retrieval as R
from corpusloom.sources.scratch import materialise
from corpusloom.sources.versions import Versions

#: Chunks of a block, and terms (repeats counted) above which a block ends earlier.
BLOCK, BLOCK_TERMS = 64, 1 << 18
#: A term's row in a block has the slots of its chunks and its counts there; the row without a term has all chunks and lengths.
ROWS = "term string, block bigint, n int, impacts array<struct<tf:int,dl:int>>, slots array<int>, counts array<int>, ids array<bigint>"
_IMPACT = pa.struct([("tf", pa.int32()), ("dl", pa.int32())])


def _block_rows(block: int, ids: np.ndarray, lists: pa.Array) -> pa.RecordBatch:
    """A row for each term of a block, and one without a term for all its chunks."""
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    pair, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
    term, slot = np.divmod(pair, max(1, len(ids)))
    dl = sizes[slot]
    first = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(first, len(term))
    # impacts: by tf from the largest, each pair whose dl is below all before it in its term
    order = np.lexsort((dl, -tf, term))
    t, length = term[order], dl[order]
    least = np.concatenate([np.minimum.accumulate(length[a:b]) for a, b in zip(ends, ends[1:])]) if len(t) else length  # noqa: B905
    fresh = np.ones(len(t), bool)
    fresh[1:] = (t[1:] != t[:-1]) | (length[1:] < least[:-1])
    chosen = order[fresh]
    heads = np.concatenate(([0], np.cumsum(np.bincount(term[chosen], minlength=len(first))))).astype(np.int32)
    struct = lambda kind, at, **other: pa.StructArray.from_arrays([pa.array(v.astype(f.type.to_pandas_dtype())) for f, v in zip(kind, [other[x.name] if x.name in other else at[x.name] for x in kind])], fields=list(kind))  # noqa: E731, B905
    every = np.arange(len(ids))
    wide = lambda a, b: pa.ListArray.from_arrays(pa.array(np.append(ends, len(a) + len(b)).astype(np.int32)), pa.array(np.concatenate((a, b)).astype(np.int32)))
    columns = [
        pa.concat_arrays([coded.dictionary.take(pa.array(term[first])), pa.nulls(1, coded.dictionary.type)]),
        pa.array(np.full(len(first) + 1, block, np.int64)),
        pa.array(np.append(np.diff(ends), len(ids)).astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(np.append(heads, heads[-1])), struct(_IMPACT, {"tf": tf[chosen], "dl": dl[chosen]})),
        wide(slot, every),
        wide(tf, sizes),
        pa.ListArray.from_arrays(pa.array(np.append(0 * ends, len(ids)).astype(np.int32)), pa.array(ids)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["term", "block", "n", "impacts", "slots", "counts", "ids"])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (chunk_id, terms, at), sorted, as blocks; ``at`` of a block's first row is its number."""
    held: list[pa.RecordBatch] = []

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            whole = pa.Table.from_batches(held).combine_chunks()
            yield _block_rows(whole["at"][0].as_py(), whole["chunk_id"].to_numpy(), whole["terms"].combine_chunks())
            held.clear()

    rows = terms = 0
    for batch in batches:
        sizes = pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False)
        start = 0
        for i, size in enumerate(sizes.tolist()):
            if rows and (rows == BLOCK or terms + size > BLOCK_TERMS):
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield from close()
                start, rows, terms = i, 0, 0
            rows, terms = rows + 1, terms + size
        held.append(batch.slice(start))
    yield from close()


def _scorer(shared, mean: float, k: int):
    """Scores of one block: (its rows, the queries that visit it); weights come with the queries or are broadcast."""

    def run(rows: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows.num_rows or not asks.num_rows:
            return pa.Table.from_batches([R._scored(np.zeros(0, np.int64), R._Best(0, k))])
        place = rows.filter(pc.is_null(rows["term"]))
        rows = rows.filter(pc.is_valid(rows["term"])).combine_chunks()
        if not place.num_rows:  # all its chunks are gone
            return pa.Table.from_batches([R._scored(np.zeros(0, np.int64), R._Best(0, k))])
        living, dl, chunk = (np.array(place[c][0].as_py(), np.int64) for c in ("slots", "counts", "ids"))
        length = np.full(int(max(living.max(), pc.max(pc.list_flatten(rows["slots"])).as_py() or 0)) + 1, -1.0)
        length[living] = dl
        slot, tf = (pc.list_flatten(rows[c]).to_numpy().astype(np.int64) for c in ("slots", "counts"))
        term = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows["slots"]).to_numpy())
        parts = np.zeros((rows.num_rows, len(length)))
        parts[term, slot] = tf / (tf + 1.2 * (0.25 + 0.75 * np.maximum(length[slot], 0) / mean))
        parts = parts[:, living]
        ids = asks["query_id"].to_numpy()
        if shared is None:
            terms, weights = asks["terms"].combine_chunks(), asks["w"].combine_chunks()
        else:
            known, terms, weights = shared.value
            at = np.argsort(known, kind="stable")
            at = pa.array(at[np.searchsorted(known, ids, sorter=at)])
            terms, weights = terms.take(at), weights.take(at)
        best, step = R._Best(len(ids), k), max(1, R.SCORES // max(1, rows.num_rows))
        for a in range(0, len(ids), step):
            some = terms.slice(a, step)
            row = np.repeat(np.arange(len(some)), pc.list_value_length(some).to_numpy())
            column = pc.fill_null(pc.index_in(some.flatten(), value_set=rows["term"].combine_chunks()), -1).to_numpy()
            matrix = np.zeros((len(some), rows.num_rows))
            matrix[row[column >= 0], column[column >= 0]] = weights.slice(a, step).flatten().to_numpy()[column >= 0]
            scores = matrix @ parts
            q, c = np.nonzero(scores > 0)
            best.add(q + a, np.round(scores[q, c], 9), chunk[c])
        return pa.Table.from_batches([R._scored(ids, best)])

    return run


class PostingsIndex:
    """Chunks (chunk_id, text) under BM25; ``add`` and ``remove`` commit a version each.

    Rows without chunk_id can't be an answer and are left out. An added id replaces the stored chunks of that id; rows
    that share an id within one batch are scored apart. Null and empty texts count as chunks without terms.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.versions = spark, Versions(spark, folder)

    # --- writing

    def add(self, chunks: DataFrame) -> int:
        """Adds a batch as a segment of its own; the version's number."""
        placed = materialise(R.postings(chunks.where("chunk_id is not null")))
        number, manifest = self.versions.manifest()
        gone = self._mark(manifest, placed.select("chunk_id").distinct())
        return self.versions.commit(number, self._with(manifest, [*manifest.get("segments", []), *self._segment(placed)], gone))

    def remove(self, ids: DataFrame) -> int:
        """Takes the chunks of ``ids`` (chunk_id) out; ids that are not stored change nothing."""
        number, manifest = self.versions.manifest()
        return self.versions.commit(number, self._with(manifest, manifest.get("segments", []), self._mark(manifest, ids.select("chunk_id").distinct())))

    def compact(self) -> int:
        """Writes all living chunks as one segment, from their postings."""
        number, manifest = self.versions.manifest()
        if not manifest:
            return number
        living = self._living(manifest)
        terms = self._postings(manifest).select("segment", F.explode(F.arrays_zip("slots", "counts")).alias("p"), "term", "block").select("segment", "block", F.col("p.slots").alias("slot"), F.col("p.counts").alias("tf"), "term")
        lists = terms.groupBy("segment", "block", "slot").agg(F.flatten(F.collect_list(F.array_repeat("term", F.col("tf")))).alias("terms"))  # a chunk's own terms
        placed = materialise(living.join(lists, ["segment", "block", "slot"], "left").select("chunk_id", "dl", F.coalesce("terms", F.array().cast("array<string>")).alias("terms")))
        return self.versions.commit(number, self._with({}, self._segment(placed), []))

    def vacuum(self, keep: int = 1) -> list[str]:
        return self.versions.vacuum(lambda m: [s["name"] for s in m.get("segments", [])] + [g["name"] for g in m.get("gone", [])], keep)

    @staticmethod
    def _with(manifest: dict, segments: list[dict], gone: list[dict]) -> dict:
        return {"segments": segments, "gone": [*manifest.get("gone", []), *gone]}

    def _segment(self, placed: DataFrame) -> list[dict]:
        """Writes a segment; none where there is no chunk."""
        told = placed.agg(F.count("*").alias("chunks"), F.sum("dl").alias("terms")).first()
        if not told.chunks:
            return []
        # chunks with like terms meet in a block: the least hash of a chunk's terms is often that of a like chunk's
        like = F.array_min(F.transform("terms", lambda x: F.xxhash64(x)))
        files = max(-(-told.chunks // (BLOCK * 512)), min(8, -(-told.chunks // (BLOCK * 8))))
        ranged = placed.select("chunk_id", "terms", F.col("dl").cast("int").alias("dl"), F.coalesce(like, F.lit(0)).alias("like")).repartitionByRange(files, "like", "chunk_id").sortWithinPartitions("like", "chunk_id", "dl")
        name = self.versions.new_data()
        # a task's numbers are used in that task alone, and its blocks are stored, so a task may be run again
        rows = materialise(ranged.select("chunk_id", "terms", F.monotonically_increasing_id().alias("at")).mapInArrow(_blocks, ROWS))
        widest = rows.where("term is null").count()
        buckets, parts = max(1, min(4096, -(-told.terms // 4_000_000))), max(1, -(-widest // 65_536))
        dealt = rows.where("term is not null").drop("ids").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
        dealt.repartition("bucket", "part").drop("part").sortWithinPartitions("bucket", "term", "block").write.option("maxRecordsPerFile", 2_000_000).partitionBy("bucket").parquet(f"{self.versions.data(name)}/postings")
        rows.where("term is null").select("block", F.explode(F.arrays_zip("slots", "ids", "counts")).alias("p")).select("block", F.col("p.slots").alias("slot"), F.col("p.ids").alias("chunk_id"), F.col("p.counts").alias("dl")).write.parquet(f"{self.versions.data(name)}/chunks")
        return [{"name": name, "buckets": int(buckets), "blocks": int(widest), "chunks": told.chunks, "terms": told.terms}]

    def _mark(self, manifest: dict, ids: DataFrame) -> list[dict]:
        """Marks the living chunks of ``ids`` as gone, with what that takes from the terms' frequencies."""
        if not manifest.get("segments"):
            return []
        dead = materialise(self._living(manifest).join(ids, "chunk_id", "left_semi"))
        told = dead.agg(F.count("*").alias("chunks"), F.sum("dl").alias("terms")).first()
        if not told.chunks:
            return []
        name = self.versions.new_data()
        dead.write.parquet(f"{self.versions.data(name)}/chunks")
        blocks = dead.select("segment", "block").distinct()
        hit = self._postings(manifest).join(blocks, ["segment", "block"], "left_semi").select("segment", "block", "term", F.explode("slots").alias("slot"))
        hit.join(dead.select("segment", "block", "slot"), ["segment", "block", "slot"], "left_semi").groupBy("term").agg(F.count("*").alias("n")).write.parquet(f"{self.versions.data(name)}/terms")
        return [{"name": name, "chunks": told.chunks, "terms": told.terms}]

    # --- reading

    def _each(self, names: list[str], what: str, schema: str) -> DataFrame:
        read = [self.spark.read.parquet(f"{self.versions.data(n)}/{what}").withColumn("segment", F.lit(n)) for n in names]
        return reduce(DataFrame.unionByName, read) if read else self.spark.createDataFrame([], schema)

    def _postings(self, manifest: dict) -> DataFrame:
        return self._each([s["name"] for s in manifest.get("segments", [])], "postings", "term string, block bigint, n int, impacts array<struct<tf:int,dl:int>>, slots array<int>, counts array<int>, bucket int, segment string")

    def _gone(self, manifest: dict) -> DataFrame:
        read = [self.spark.read.parquet(f"{self.versions.data(g['name'])}/chunks") for g in manifest.get("gone", [])]
        return reduce(DataFrame.unionByName, read)

    def _living(self, manifest: dict) -> DataFrame:
        """(segment, block, slot, chunk_id, dl) of all chunks that are not gone."""
        stored = self._each([s["name"] for s in manifest.get("segments", [])], "chunks", "block bigint, slot int, chunk_id bigint, dl int, segment string").select("segment", "block", "slot", "chunk_id", "dl")
        if not manifest.get("gone"):
            return stored
        gone = self._gone(manifest).select("segment", F.col("chunk_id"))
        return stored.join(gone.distinct(), ["segment", "chunk_id"], "left_anti").select("segment", "block", "slot", "chunk_id", "dl")

    def sizes(self, version: int | None = None) -> tuple[int, float]:
        """(chunks, mean length), from the manifest alone."""
        _, manifest = self.versions.manifest(version)
        added, gone = manifest.get("segments", []), manifest.get("gone", [])
        chunks = sum(s["chunks"] for s in added) - sum(g["chunks"] for g in gone)
        return chunks, (sum(s["terms"] for s in added) - sum(g["terms"] for g in gone)) / chunks if chunks else 0.0

    def plan(self, queries: DataFrame, k: int = 10, first: int = 4, version: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows, visits): the answers, and (query_id, segment, block, bound, visited) of every block with a term of a query."""
        _, manifest = self.versions.manifest(version)
        chunks, mean = self.sizes(version)
        asked = materialise(queries.select("query_id", F.explode(R.terms_of(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")))
        wanted = asked.select("term").distinct()
        small = wanted.limit(R.MAX_ASKED + 1).count() <= R.MAX_ASKED
        wanted = F.broadcast(wanted) if small else wanted
        stored = self._postings(manifest)
        part = lambda p: p["tf"] / (p["tf"] + 1.2 * (0.25 + 0.75 * p["dl"] / F.lit(mean or 1.0)))
        bounds = materialise(stored.select("term", "segment", "block", "n", F.array_max(F.transform("impacts", part)).alias("best")).join(wanted, "term", "left_semi"))
        spread = bounds.groupBy("term").agg(F.sum("n").alias("n"))
        for g in manifest.get("gone", []):
            spread = spread.unionByName(self.spark.read.parquet(f"{self.versions.data(g['name'])}/terms").join(wanted, "term", "left_semi").select("term", (-F.col("n")).alias("n")))
        n = F.col("n")
        idf = F.ln((F.lit(chunks) - n + 0.5) / (n + 0.5))
        spread = spread.groupBy("term").agg(F.sum("n").alias("n")).where("n > 0").select("term", F.when(idf > 0, idf).otherwise(F.lit(1e-6)).alias("idf"))
        weighed = materialise(asked.join(spread, "term").select("query_id", "term", (F.col("times") * F.col("idf") * 2.2).alias("w")))
        entries = weighed.count()
        weighed_ = F.broadcast(weighed) if entries <= R.MAX_ASKED else weighed
        reach = bounds.join(weighed_, "term").groupBy("query_id", "segment", "block").agg(F.sum(F.col("w") * F.col("best")).alias("bound"))
        reach = materialise(reach)
        ahead = materialise(R.top_k(reach, first, "query_id", "segment", "block", score="bound").drop("rank"))
        places = self._living(manifest).groupBy("segment", "block").agg(F.sort_array(F.collect_list(F.struct("slot", "chunk_id", "dl"))).alias("c"))  # 64 a block
        none = lambda kind: F.lit(None).cast(kind)
        places = places.select("segment", "block", none("string").alias("term"), F.col("c.slot").alias("slots"), F.col("c.dl").alias("counts"), F.col("c.chunk_id").alias("ids"))
        lists = stored.join(wanted, "term", "left_semi").select("segment", "block", "term", "slots", "counts", none("array<bigint>").alias("ids"))

        def score(visits: DataFrame) -> DataFrame:
            """Each block's k best chunks of each query that visits it; a block's postings are shuffled once for all its queries."""
            asks = visits.select("query_id", "segment", "block").join(weighed_, "query_id")
            blocks = visits.select("segment", "block").distinct()
            asks = asks.groupBy("segment", "block", "query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("w")) if entries > R.MAX_TERMS else visits.select("segment", "block", "query_id")
            rows = lists.unionByName(places).join(blocks, ["segment", "block"], "left_semi")
            by = ["segment", "block"]
            return rows.groupBy(*by).cogroup(asks.groupBy(*by)).applyInArrow(_scorer(shared, mean or 1.0, k), R.SCORED)

        shared = None
        if entries <= R.MAX_TERMS:
            table = weighed.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("w").alias("w")).toArrow()
            shared = self.spark.sparkContext.broadcast((table["query_id"].to_numpy(), table["terms"].combine_chunks(), table["w"].combine_chunks()))
        early = materialise(R.top_k(score(ahead), k, "query_id", "chunk_id"))
        floor = early.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        # rounding takes 5e-10 at most from a score, and adding up in another order less
        rest = reach.join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-8)).drop("floor")
        rest = materialise(rest.join(ahead.select("query_id", "segment", "block"), ["query_id", "segment", "block"], "left_anti"))
        rows = R.top_k(early.drop("rank").unionByName(score(rest)), k, "query_id", "chunk_id")
        seen = ahead.select("query_id", "segment", "block").unionByName(rest.select("query_id", "segment", "block")).withColumn("visited", F.lit(True))
        return rows, reach.join(seen, ["query_id", "segment", "block"], "left").withColumn("visited", F.coalesce("visited", F.lit(False)))

    def search(self, queries: DataFrame, k: int = 10, version: int | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank) for queries (query_id, query), as ``retrieval.bm25`` gives them."""
        return self.plan(queries, k, version=version)[0]
