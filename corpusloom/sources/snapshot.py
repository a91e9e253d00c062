"""An index kept as Parquet: what changed, what to rebuild, and its replacement by buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.scratch import materialise
from corpusloom.sources.versions import Versions

BUCKETS = 64


def content_sha(notes: DataFrame) -> DataFrame:
    return notes.withColumn("content_sha", F.sha2("text", 256))


def restore_diff(current: DataFrame, prior: DataFrame) -> DataFrame:
    """(note_path, action): restored, rebuilt or pruned, by a full join of (note_path, content_sha) tables."""
    p = prior.select("note_path", F.col("content_sha").alias("_old"))
    joined = current.select("note_path", F.col("content_sha").alias("_new")).join(p, "note_path", "full")
    action = F.when(F.col("_new").isNull(), "pruned").when(F.col("_new") == F.col("_old"), "restored").otherwise("rebuilt")
    return joined.select("note_path", action.alias("action"))


def refresh(current: DataFrame, chunks: DataFrame, diff: DataFrame, chunker) -> DataFrame:
    """New chunk table: restored notes keep their rows, rebuilt ones go through ``chunker``; only these are read again."""
    kept = chunks.join(diff.where("action = 'restored'").select("note_path"), "note_path", "left_semi")
    changed = current.join(diff.where("action = 'rebuilt'").select("note_path"), "note_path", "left_semi")
    return kept.unionByName(chunker(changed))


def remove_notes(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    return chunks.join(paths, "note_path", "left_anti")


def write_buckets(rows: DataFrame, folder: str) -> None:
    """Write by bucket of note_path; only buckets that ``rows`` has are replaced, so pass whole buckets."""
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("note_path"), F.lit(BUCKETS)).cast("int"))
    bucketed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def read_buckets(spark: SparkSession, folder: str, note_path: str | None = None) -> DataFrame:
    """The stored rows; for one note only its bucket is read."""
    rows = spark.read.parquet(folder)
    if note_path is not None:
        rows = rows.where((F.col("bucket") == F.pmod(F.xxhash64(F.lit(note_path)), F.lit(BUCKETS)).cast("int")) & (F.col("note_path") == note_path))
    return rows.drop("bucket")


# --- versions


#: Bytes of a bucket that are aimed at, and of a file in it (Zstandard, which holds some three times as much text as bytes).
BUCKET_BYTES, FILE_BYTES = 1 << 26, 1 << 25
#: Bytes of a file besides its rows, about; a table of small files would else outgrow its buckets for ever.
FOOTER_BYTES = 1 << 11
#: Buckets at most: a manifest names the folder of each.
MAX_BUCKETS = 1 << 17
#: Paths that may be sent to all tasks; more of them meet the rows by a shuffle.
SMALL = 1_000_000


class Snapshot:
    """A table with note_path, kept in immutable bucket folders under ``versions.Versions``.

    A change writes the buckets that it touches and no others, then commits a manifest that names each bucket's newest
    folder. The number of buckets is a power of two that follows the stored bytes: when they outgrow it, the table is
    written once with more. A bucket can have several files, so neither a large bucket nor the rows of one note are one
    task. Rows whose note_path is null are kept and replaced as a note of their own.

    Rows are shuffled once, on their way into their buckets. What a change keeps of a bucket is copied from its files
    into new ones without a shuffle, until the bucket has many files or small ones; then it is dealt anew.
    """

    def __init__(self, spark: SparkSession, folder: str, bucket_bytes: int = BUCKET_BYTES, file_bytes: int = FILE_BYTES):
        self.spark, self.versions, self.bucket_bytes, self.file_bytes = spark, Versions(spark, folder), bucket_bytes, file_bytes

    def read(self, note_path: str | None = None, version: int | None = None) -> DataFrame:
        """The rows of a version, of the latest where none is named; for one note only its bucket is read."""
        _, manifest = self.versions.manifest(version)
        if not manifest:
            raise ValueError(f"nothing is stored in {self.versions.folder}")
        schema = T.StructType.fromJson(manifest["schema"])
        only = None
        if note_path is not None:
            only = self.spark.range(1).select(_bucket(F.lit(note_path), manifest["buckets"])).first()[0]
        rows = self._folders(manifest, schema, None if only is None else {only})
        return rows if note_path is None else rows.where(F.col("note_path") == note_path)

    def _folders(self, manifest: dict, schema: T.StructType, buckets: set[int] | None = None) -> DataFrame:
        paths = []
        for name, stored in manifest["writes"].items():
            root = self.versions.data(name)
            current = [b for b, w in manifest["current"].items() if w == name]
            whole = buckets is None and len(current) == stored["buckets"]
            paths += [root] if whole else [f"{root}/bucket={b}" for b in current if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], schema)
        # the folders' own names are not columns of the table
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths)

    def _store(self, rows: DataFrame, buckets: int, files: int, told: DataFrame | None = None, stay: DataFrame | None = None) -> tuple[str, dict[str, int], dict[str, int]]:
        """Writes rows into a new folder; its name, and the bytes and the files of each bucket.

        Rows with ``_new`` take their content_sha from ``told`` (note_path, content_sha), which goes the way of its rows,
        and are left out where it lacks their path. ``stay`` are rows read from buckets, which are not dealt again.
        """
        name = self.versions.new_data()
        root = self.versions.data(name)
        spread = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith("map") and "map<" not in kind]), F.lit(files))
        dealt = rows.withColumn("bucket", _bucket(F.col("note_path"), buckets)).withColumn("_part", spread)
        tasks = max(1, min(buckets * files, 4 * self.spark.sparkContext.defaultParallelism * files))
        if told is None:
            dealt = dealt.repartition(tasks, "bucket", "_part")
        else:
            marks = told.select("note_path", "content_sha", _bucket(F.col("note_path"), buckets).alias("bucket"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(files - 1).cast("long"))).alias("_part"))
            dealt = dealt.withColumn("_mark", F.lit(False)).unionByName(marks.withColumn("_mark", F.lit(True)), allowMissingColumns=True).repartition(tasks, "bucket", "_part")
            sha = F.max(F.when(F.col("_mark"), F.col("content_sha"))).over(Window.partitionBy("bucket", "note_path", "_part"))
            dealt = dealt.withColumn("_sha", sha).where("not _mark and (not _new or _sha is not null)")
            dealt = dealt.withColumn("content_sha", F.when(F.col("_new"), F.col("_sha")).otherwise(F.col("content_sha"))).drop("_mark", "_sha", "_new")
        dealt = dealt.drop("_part")
        if stay is not None:
            dealt = dealt.unionByName(stay.withColumn("bucket", _bucket(F.col("note_path"), buckets)))
        dealt.sortWithinPartitions("bucket", "note_path").write.option("compression", "zstd").partitionBy("bucket").parquet(root)
        return name, *self.versions.sizes(f"data/{name}")

    def write(self, rows: DataFrame) -> int:
        """Replaces the whole table; the version's number."""
        number, _ = self.versions.manifest()
        rows = materialise(rows)
        return self.versions.commit(number, self._whole(rows, 1, self.versions.bytes_of(rows)))

    def _whole(self, rows: DataFrame, buckets: int, bytes_: int, told: DataFrame | None = None) -> dict:
        """A manifest of ``rows`` alone, with as many buckets as their bytes ask for."""
        while buckets < MAX_BUCKETS and bytes_ > buckets * self.bucket_bytes:
            buckets *= 2
        files = max(1, -(-bytes_ // (buckets * self.file_bytes)))
        name, sizes, counts = self._store(rows if told is None else rows.withColumn("_new", F.lit(True)), buckets, files, told)
        schema = T.StructType([f for f in rows.schema if f.name != "_new"])
        return {"schema": schema.jsonValue(), "buckets": buckets, "writes": {name: {"buckets": len(sizes)}}, "current": dict.fromkeys(sizes, name), "bytes": sizes, "files": counts}

    def _grown(self, made: dict) -> dict:
        """The manifest, or that of the table written anew where its bytes have outgrown its buckets."""
        stored = sum(made["bytes"].values())
        stored = max(stored // 2, stored - FOOTER_BYTES * sum(made["files"].values()))
        if made["buckets"] < MAX_BUCKETS and stored > 2 * made["buckets"] * self.bucket_bytes:
            return self._whole(self._folders(made, T.StructType.fromJson(made["schema"])), made["buckets"], stored)
        return made

    def replace(self, rows: DataFrame, removed: DataFrame | None = None) -> int:
        """Puts ``rows`` in place of the stored rows of their notes, and takes out the notes of ``removed`` (note_path)."""
        number, manifest = self.versions.manifest()
        rows = materialise(rows)
        bytes_ = self.versions.bytes_of(rows)
        if not manifest:
            return self.versions.commit(0, self._whole(rows, 1, bytes_))
        paths = rows.select("note_path")
        paths = materialise((paths if removed is None else paths.unionByName(removed.select("note_path"))).distinct())
        return self._replace(number, manifest, rows, paths, bytes_)

    def _replace(self, number: int, manifest: dict, rows: DataFrame, paths: DataFrame, bytes_: int, told: DataFrame | None = None) -> int:
        """Puts ``rows``, some ``bytes_`` when stored, in place of the rows of all ``paths`` (note_path)."""
        schema, buckets = T.StructType.fromJson(manifest["schema"]), manifest["buckets"]
        touched = {r[0] for r in paths.select(_bucket(F.col("note_path"), buckets)).distinct().collect()}  # MAX_BUCKETS at most
        if not touched:
            return number
        few = paths.limit(SMALL + 1).count() <= SMALL
        stored, counts = ({int(b): n for b, n in manifest.get(what, {}).items()} for what in ("bytes", "files"))
        # by a shuffle of the paths no row would stay where it was
        staying = {b for b in touched if few and 2 * stored.get(b, 0) >= self.file_bytes and counts.get(b, 1 << 30) <= 4 + 2 * -(-stored[b] // self.file_bytes)}

        def kept(of: set[int]) -> DataFrame:
            gone = (F.broadcast(paths) if few else paths).alias("p")
            return self._folders(manifest, schema, of).alias("old").join(gone, F.col("old.note_path").eqNullSafe(F.col("p.note_path")), "left_anti")

        fresh = rows.select(*schema.names) if told is None else rows.select(*schema.names, F.lit(True).alias("_new"))
        if touched - staying:
            moved = kept(touched - staying)
            fresh = moved.unionByName(fresh) if told is None else moved.withColumn("_new", F.lit(False)).unionByName(fresh)
        largest = max((stored.get(b, 0) for b in touched - staying), default=0) + bytes_ // len(touched)
        name, sizes, files = self._store(fresh, buckets, max(1, -(-largest // self.file_bytes)), told, kept(staying) if staying else None)
        left = lambda old, new: {b: x for b, x in old.items() if int(b) not in touched} | new
        current = left(manifest["current"], dict.fromkeys(sizes, name))
        writes = {w: s for w, s in (manifest["writes"] | {name: {"buckets": len(sizes)}}).items() if w in set(current.values())}
        made = manifest | {"writes": writes, "current": current, "bytes": left(manifest["bytes"], sizes), "files": left(manifest.get("files", {}), files)}
        return self.versions.commit(number, self._grown(made))

    def refresh(self, notes: DataFrame, build: Callable[[DataFrame], DataFrame]) -> tuple[int, DataFrame]:
        """Brings the table to the state of ``notes`` (note_path, text, ...): (version, what became of each path).

        ``build`` makes rows with note_path from notes, at least one for each, and is given new and changed notes only.
        Stored rows carry the content_sha of their note. A path that several notes share is built anew each time. Notes
        are read twice, for their hashes and by ``build``; only hashes are stored on the way, no text.
        """
        current = notes.select("note_path", F.coalesce(F.sha2("text", 256), F.sha2(F.lit(""), 256)).alias("content_sha"), F.octet_length("text").alias("_bytes"))
        number, manifest = self.versions.manifest()
        shas = current.groupBy("note_path").agg(F.min("content_sha").alias("_new"), F.max("content_sha").alias("_most"), F.count("*").alias("_n"), F.sum("_bytes").alias("_bytes"))
        prior = (self.read() if manifest else self.spark.createDataFrame([], "note_path string, content_sha string")).groupBy("note_path").agg(F.max("content_sha").alias("_old")).withColumnRenamed("note_path", "_path").withColumn("_stored", F.lit(True))
        joined = shas.withColumn("_given", F.lit(True)).join(prior, F.col("note_path").eqNullSafe(F.col("_path")), "full")
        action = F.when(F.col("_given").isNull(), "pruned").when((F.col("_new") == F.col("_old")) & (F.col("_n") == 1), "restored").otherwise("rebuilt")
        sha = F.when(F.col("_n") == 1, F.col("_most")).otherwise(F.concat(F.lit("several "), "_most"))  # equals that of no note left alone
        diff = materialise(joined.select(F.when(F.col("_given").isNull(), F.col("_path")).otherwise(F.col("note_path")).alias("note_path"), action.alias("action"), sha.alias("content_sha"), "_bytes"))
        told = diff.where("action = 'rebuilt'")
        bytes_ = (told.agg(F.sum("_bytes")).first()[0] or 0) // 3
        changed, told = notes, told.select("note_path", "content_sha")
        if manifest:  # else all notes are new
            few = told.limit(SMALL + 1).count() <= SMALL
            paths = told.select("note_path")
            changed = notes.alias("c").join((F.broadcast(paths) if few else paths).alias("d"), F.col("c.note_path").eqNullSafe(F.col("d.note_path")), "left_semi")
        built = build(changed).drop("content_sha").withColumn("content_sha", F.lit(None).cast("string"))
        actions = diff.select("note_path", "action")
        if manifest:
            return self._replace(number, manifest, built, actions.where("action <> 'restored'").select("note_path"), bytes_, told), actions
        return self.versions.commit(0, self._grown(self._whole(built, 1, bytes_, told))), actions

    def vacuum(self, keep: int = 1) -> list[str]:
        return self.versions.vacuum(lambda m: list(m.get("writes", {})), keep)


def _bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")
