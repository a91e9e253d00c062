"""Helpers that the operators share: scratch tables, checked broadcasts, Arrow slices and words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that ends a word, for Java and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]"
#: The same characters, for Python.
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``.

    Where that is unset a local session gets a folder of its own; on a cluster, where executors would not share it,
    that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    _FOLDERS.append(f"{root.rstrip('/')}/corpusloom-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


_FOLDERS: list[str] = []


def clear_scratch(spark: SparkSession) -> None:
    """Delete all folders of ``scratch_dir``; call it when results that were read from them have been written or collected."""
    jvm = spark.sparkContext._jvm
    while _FOLDERS:
        path = jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    path = scratch_dir(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint when ``df`` has at most ``max_rows`` rows (counted, not guessed); beyond it the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add, for each new name of ``sums``, the sum of its column (whole numbers) from the first row in ``order`` to this one.

    One range sort over all rows, whatever keys they have: rows that are equal in the first columns of ``order`` still
    spread over tasks if later ones differ. Each task sums its own rows, a row for each task goes to the driver, and
    the sums before a task are added. Nulls come first and count as 0. The result is written, in order.
    """
    names, new = df.columns, list(sums)

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), dict.fromkeys(new, 0)
        for batch in batches:
            made = []
            for name in new:
                made.append(np.cumsum(np.asarray(pc.fill_null(batch.column(sums[name]), 0), dtype=np.int64)) + before[name])
                before[name] = int(made[-1][-1]) if batch.num_rows else before[name]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made), pa.array(np.full(batch.num_rows, part, np.int32))], names=[*names, *new, "_part"])

    schema = plus(df, ", ".join(f"{n} long" for n in new) + ", _part int")
    summed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(add, schema))
    ends = sorted(tuple(r) for r in summed.groupBy("_part").agg(*[F.max(n).alias(n) for n in new]).collect())
    offsets, total = [], [0] * len(new)
    for part, *last in ends:
        offsets.append((part, *total))
        total = [a + b for a, b in zip(total, last, strict=True)]
    before = df.sparkSession.createDataFrame(offsets, "_part int, " + ", ".join(f"_before_{n} long" for n in new))
    joined = summed.join(F.broadcast(before), "_part")  # a row for each task
    return joined.select(*[F.col(f"`{n}`") for n in names], *[(F.col(n) + F.col(f"_before_{n}")).alias(n) for n in new])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def plus(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` and more columns."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def text_bytes(text: Column | str = "text") -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.octet_length(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def word_count(text: str = "text") -> Column:
    """Number of words as a long, without Python; null is 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", target: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``target`` bytes of ``column`` (texts, bytes or lists of 32-bit numbers).

    Temporary arrays, and batches made from a slice, then stay small whatever stands together in a batch.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        sizes = pc.multiply(pc.list_value_length(values), 4) if pa.types.is_list(values.type) else pc.binary_length(values)
        sizes = np.asarray(pc.fill_null(sizes, 0), dtype=np.int64)
        group = np.cumsum(sizes) // target
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column).cast(pa.string()), "")


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without nulls, both as numpy views starting at 0."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of all texts in order: the text each belongs to, its code, and the distinct words that the codes stand for."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
    some = pc.not_equal(flat, "")
    flat, owner = flat.filter(some), owner[np.asarray(some)]
    coded = flat.dictionary_encode()
    return owner, np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and odd multipliers), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
