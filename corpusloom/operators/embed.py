"""Embeddings behind a cache: only texts that the cache lacks reach the provider."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.sources.scratch import materialise

Provider = Callable[[list[str]], np.ndarray]

#: Rows of one text above which its vector is made first, and its rows are dealt to many tasks.
COPIES = 1024


class HashEmbedder:
    """Deterministic offline stand-in: component d is the FNV-1a hash of ``text:d`` scaled to -1..1, then unit length."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), self.dims))
        for i, text in enumerate(texts):
            h = _fnv(2166136261, text)
            for d in range(self.dims):
                out[i, d] = _fnv(h, f":{d}") / 0xFFFFFFFF * 2 - 1
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32)


def _fnv(h: int, text: str) -> int:
    """FNV-1a over UTF-16 code units."""
    raw = text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = (h ^ (raw[i] | raw[i + 1] << 8)) * 16777619 & 0xFFFFFFFF
    return h


class ConstantEmbedder:
    """The same unit vector for all texts, to check an evaluation."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, texts: list[str]) -> np.ndarray:
        return np.tile(np.eye(1, self.dims, dtype=np.float32), (len(texts), 1))


def cache_key(model: str, text: Column | str) -> Column:
    return F.sha2(F.concat(F.sha2(F.lit(model), 256), F.col(text) if isinstance(text, str) else text), 256)


def cache_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """(key, text) that the cache (key, vec) lacks, each once."""
    return texts.select(cache_key(model, "text").alias("key"), "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def embed(texts: DataFrame, provider: Provider, batch: int = 256) -> DataFrame:
    """Adds vec (array of float) by the provider, ``batch`` texts a call; other columns stay."""
    names = [c for c in texts.columns if c != "vec"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                vectors = provider(part.column("text").to_pylist())
                if len(vectors) != part.num_rows:
                    raise ValueError("the provider returned another number of vectors")
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(list(vectors), pa.list_(pa.float32()))], names=[*names, "vec"])

    chosen = texts.select(*names)
    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields, T.StructField("vec", T.ArrayType(T.FloatType()))]))


def embed_cached(texts: DataFrame, cache: DataFrame, provider: Provider, model: str) -> tuple[DataFrame, DataFrame]:
    """(texts with vec, rows to append to the cache).

    Texts are shuffled once, to lie beside their copies and the cache's row; the provider gets the first of those that
    the cache lacks. A text of more than COPIES rows (few texts, for that reason) gets its vector before, and its rows
    are dealt to many tasks. Null texts have no vector.
    """
    keyed = texts.withColumn("_key", cache_key(model, "text"))
    fresh = embed(cache_misses(texts, cache, model).where("key is not null"), provider).select("key", "vec")
    often = materialise(keyed.where("_key is not null").groupBy("_key").count().where(F.col("count") > COPIES).select("_key"))
    vec = T.ArrayType(T.FloatType())
    if often.isEmpty():
        dealt = keyed.withColumn("vec", F.lit(None).cast(vec))
    else:
        copied = keyed.join(F.broadcast(often), "_key", "left_semi").select("text")
        held = cache.join(F.broadcast(often), F.col("key") == F.col("_key"), "left_semi").select("key", "vec").dropDuplicates(["key"])
        made = embed(cache_misses(copied, held, model), provider).select("key", "vec").unionByName(held)
        dealt = keyed.join(F.broadcast(materialise(made.select(F.col("key").alias("_key"), "vec"))), "_key", "left")
    apart = F.col("vec").isNotNull() | F.col("_key").isNull()
    spread = [c for c, kind in texts.dtypes if "map<" not in kind]
    dealt = dealt.select(*texts.columns, "_key", "vec", F.lit(True).alias("_row"), F.when(apart, F.xxhash64(F.spark_partition_id(), *spread) % 1024).otherwise(0).alias("_part"))
    known = cache.select(F.col("key").alias("_key"), F.col("vec").cast(vec).alias("vec"), F.lit(False).alias("_row"), F.lit(0).cast("long").alias("_part"))
    beside = dealt.unionByName(known, allowMissingColumns=True).repartition("_key", "_part").sortWithinPartitions("_key", "_part", "_row")
    return _vectors_of_runs(beside, texts.columns, provider), fresh


def _vectors_of_runs(beside: DataFrame, names: list[str], provider: Provider, batch: int = 256) -> DataFrame:
    """Rows sorted by _key, those with a vec first: all rows of a key get the first's vec, by the provider where it has none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, vec = None, pa.nulls(1, pa.list_(pa.float32()))  # of the last row so far
        for b in batches:
            if not b.num_rows:
                continue
            keys, given = b.column("_key").to_pylist(), b.column("vec").cast(vec.type)
            first = [k is not None and k != p for k, p in zip(keys, [key, *keys], strict=False)]
            ask = [i for i, (f, valid) in enumerate(zip(first, given.is_valid().to_pylist(), strict=True)) if f and not valid]
            made = [vec, given]
            for a in range(0, len(ask), batch):
                vectors = provider(b.column("text").take(pa.array(ask[a : a + batch])).to_pylist())
                if len(vectors) != len(ask[a : a + batch]):
                    raise ValueError("the provider returned another number of vectors")
                made.append(pa.array(list(vectors), vec.type))
            # places in ``made``: the last vector, those given, those of the provider
            at = np.where(first, np.arange(len(keys)) + 1, 0)
            at[ask] = len(keys) + 1 + np.arange(len(ask))
            at = at[np.maximum.accumulate(np.where(first, np.arange(len(keys)), -1))] * (np.maximum.accumulate(first) > 0)
            every = pa.concat_arrays(made).take(pa.array(at, mask=np.array([k is None for k in keys])))
            key, vec = keys[-1], every.slice(len(every) - 1)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), every], names=[*names, "vec"]).filter(b.column("_row"))

    fields = [beside.schema[n] for n in names]
    return beside.mapInArrow(run, T.StructType([*fields, T.StructField("vec", T.ArrayType(T.FloatType()))]))
