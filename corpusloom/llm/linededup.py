"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import common

STRIPPED = " \t\n\x0b\x0c\r"
#: Line keys above this part of all lines are joined apart from the rest.
HEAVY = 1 << 16


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased (other letters stay)."""
    bare = F.regexp_replace(line, rf"^{common.SPACE}+|{common.SPACE}+\z", "")
    return F.translate(bare, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _key_of(line: str) -> str:
    return line.strip(STRIPPED).translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


@contextlib.contextmanager
def _sorted_buckets(spark: SparkSession) -> Iterator[None]:
    """While it lasts, scans of runs count as sorted, so that merges of runs neither shuffle nor sort them."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Sorted runs of (hash, n_docs, owner) on levels, in the shared folder.

    A run has one sorted file for each bucket of the hash, and all runs have the same buckets: what is merged with a
    run is read bucket by bucket, in order, without a shuffle of the run. A batch is aggregated by hash, merge-joined
    with the runs, and written as a run of its own. Hashes that no run holds get the batch's largest document as owner
    (the anti-join); others only add to the count. Before a level with ``fanout`` runs gets another one they are
    merged into one run of the next level, so a batch meets few runs however many came before.

    The runs' places stand in a manifest below ``root``: ``LineRuns(spark, root)`` goes on where an earlier object,
    in this session or another, has stopped. Batches must not be added from two sides at a time.
    """

    SCHEMA = "h binary, n_docs long, owner long"
    MANIFEST = "level int, place int, run string, buckets int"

    def __init__(self, spark: SparkSession, root: str | None = None, fanout: int = 2):
        self.spark, self.fanout, self.root, self.version = spark, fanout, root or common.scratch_dir(spark), 0
        self.levels: list[list[str]] = [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        if root is not None:
            self._open()

    def _open(self) -> None:
        try:
            told = self.spark.read.schema(self.MANIFEST + ", version int").json(f"{self.root}/manifest").collect()  # a row for each run and version
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        self.version = max((r["version"] for r in told), default=0)
        for r in sorted((r for r in told if r["version"] == self.version), key=lambda r: (r["level"], r["place"])):
            while len(self.levels) <= r["level"]:
                self.levels.append([])
            self.levels[r["level"]].append(r["run"])
            self.buckets = r["buckets"]
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {r['run']} (h BINARY, n_docs BIGINT, owner BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{r['run']}'")

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.option("path", f"{self.root}/{name}").bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _note(self) -> None:
        rows = [(level, place, run, self.buckets) for level, runs in enumerate(self.levels) for place, run in enumerate(runs)]
        self.version += 1
        self.spark.createDataFrame(rows, self.MANIFEST).coalesce(1).write.json(f"{self.root}/manifest/version={self.version}")

    def _in_order(self) -> list[str]:
        """All runs, the oldest first: higher levels are older."""
        return [run for level in reversed(self.levels) for run in level]

    def entries(self) -> DataFrame:
        """All runs merged: one row for each hash.

        A hash has its owner in the run that brought it; later runs add their counts to that row.
        """
        runs, merged = self._in_order(), self.spark.createDataFrame([], self.SCHEMA)
        for i, run in enumerate(runs):
            own, count = self._run(run).where("owner is not null"), F.col("n_docs")
            for j, later in enumerate(runs[i + 1 :]):
                own = own.join(self._run(later).select("h", F.col("n_docs").alias(f"_n{j}")).hint("merge"), "h", "left")
                count = count + F.coalesce(f"_n{j}", F.lit(0))
            merged = merged.unionByName(own.select("h", count.alias("n_docs"), "owner"))
        return merged

    def add(self, batch: DataFrame) -> None:
        """``batch``: (h, doc_id), once for each document and hash; what is new gets the batch's largest doc_id as owner."""
        with _sorted_buckets(self.spark):
            self._compact()
            own = batch.groupBy("h").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("owner"))
            if self.buckets != int(self.spark.conf.get("spark.sql.shuffle.partitions")):
                own = own.repartition(self.buckets, "h")
            seen = F.lit(False)
            for i, run in enumerate(self._in_order()):
                own = own.join(self._run(run).select("h", F.lit(True).alias(f"_seen{i}")).hint("merge"), "h", "left")
                seen = seen | F.col(f"_seen{i}").isNotNull()
            self._write(own.select("h", "n_docs", F.when(~seen, F.col("owner")).alias("owner")), 0)
        self._note()

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            runs = self.levels[level]
            while len(runs) >= self.fanout and len(runs) > 1:
                one, two = (self._run(r).select("h", F.col("n_docs").alias(f"_n{i}"), F.col("owner").alias(f"_o{i}")) for i, r in enumerate(runs[:2]))
                both = one.join(two.hint("merge"), "h", "full")
                both = both.select("h", (F.coalesce("_n0", F.lit(0)) + F.coalesce("_n1", F.lit(0))).alias("n_docs"), F.coalesce("_o0", "_o1").alias("owner"))
                if len(runs) == 2:
                    self.levels[level] = []
                    self._write(both, level + 1)
                    break
                self._write(both, level)
                runs[:] = [runs[-1], *runs[2:-1]]

    def close(self) -> None:
        """Take the runs' names out of the session's catalog; their files stay."""
        for run in self._in_order():
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4) -> DataFrame:
    """Drop lines whose key many documents hold, except in the document with the largest id.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents loses all its lines but those of
    its owner, the largest doc_id that holds it. Adds ``n_lines`` (before dropping) and ``n_dropped``, and replaces
    ``text`` by the lines left, joined by newline; other columns stay. Documents are taken in ``batches`` ranges of
    doc_id from the largest down, so that the first batch to bring a line owns it.

    Null or empty text: one empty line, nothing dropped, empty text. Rows with a null doc_id stay whole and count
    nowhere. Rows that share a doc_id are one document for counting and all lose the same keys. Keys are compared by
    MD5 (128 bits). Clashing columns n_lines and n_dropped are replaced. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    ids = docs.where(F.col("doc_id").isNotNull())
    cuts = ids.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("cuts")).first()["cuts"] or []
    batch_of = F.lit(0)
    for cut in sorted(set(cuts)):
        batch_of = batch_of + (F.col("doc_id") <= cut).cast("int")
    keys = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), line_key), lambda k: F.char_length(k) >= min_chars))
    lines = ids.select("doc_id", F.explode(keys).alias("key")).select(F.unhex(F.md5("key")).alias("h"), "doc_id", batch_of.alias("batch"))
    lines = common.materialise(lines, "batch")
    runs = LineRuns(spark)
    for b in range(len(set(cuts)) + 1):
        runs.add(lines.where(F.col("batch") == b).select("h", "doc_id").distinct())
    with _sorted_buckets(spark):
        shared = common.materialise(runs.entries().where(F.col("n_docs") >= min_docs))
    runs.close()
    held = lines.select("h", "doc_id")
    # keys that hold more than 1 / HEAVY of all lines are fewer than HEAVY, so they can go to all tasks
    least = held.count() // HEAVY
    heavy = F.broadcast(shared.where(F.col("n_docs") > least))
    light = held.join(heavy.select("h"), "h", "left_anti").join(shared.where(F.col("n_docs") <= least), "h") if least >= min_docs else None
    lost = held.join(heavy, "h") if light is None else held.join(heavy, "h").unionByName(light)
    lost = lost.where(F.col("doc_id") != F.col("owner"))
    id_, lost_ = common.free_name(docs, "_id"), common.free_name(docs, "_lost")
    lost = lost.groupBy(F.col("doc_id").alias(id_)).agg(F.collect_set("h").alias(lost_))
    joined = docs.join(lost, F.col("doc_id") == F.col(id_), "left").drop(id_)
    names = docs.columns

    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            texts, counts, gone = [], [], []
            for text, keys in zip(batch.column("text").to_pylist(), batch.column(lost_).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                if keys:
                    keys = set(keys)
                    left = [x for x in lines if hashlib.md5(_key_of(x).encode()).digest() not in keys]
                else:
                    left = lines
                texts.append("\n".join(left))
                counts.append(len(lines))
                gone.append(len(lines) - len(left))
            own = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*own, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    schema = common.plus(docs, "n_lines long, n_dropped long")
    return joined.mapInArrow(rewrite, schema)
