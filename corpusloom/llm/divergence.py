"""How far sources of a language are from one another, by their terms, from an index built in one pass.

Each task indexes what it reads in memory: occurrences and documents of every (language, term, source). When the block
is full it is spilled as a run, sorted by language and term and cut into shards by term. A shard's runs, from all tasks,
are merged through a heap into whole frequencies, term after term; where a shard has very many runs they are first
merged in rounds. Frequencies then stream by once more: distances between all pairs of sources start from what two
sources without any term would have, plus corrections for the terms that only one of them has, which depend on the
term's count alone and are made from a histogram of counts, plus corrections for the terms that both have.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corpusloom.llm import common

#: Bytes of postings that a task holds before it spills them as a run.
BLOCK_BYTES = 96 << 20
#: Runs of a shard that are merged at a time.
FAN_IN = 512
#: Rows of a run that are decoded at a time.
PIECE = 4096
#: Groups (language, source) up to which their totals are sent to all tasks; beyond, they are joined.
MAX_GROUPS = 200_000
#: Pairs of sources that a task sums up before it hands them on.
MAX_PAIRS = 1 << 21

RUN = "shard int, run long, postings binary"
POSTINGS = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[65:91] = _INSIDE[97:123] = _INSIDE[128:] = True


def terms_of(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Terms of all texts in order, A-Z lower-cased, and the text that each belongs to; terms are ASCII letters and all beyond ASCII."""
    data, offsets = common.raw_bytes(texts)
    inside = _INSIDE[data]
    before = np.concatenate((np.zeros(min(1, len(data)), bool), inside[:-1]))
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    packed = _LOWER[data[inside]]
    cuts = np.append(np.cumsum(inside)[starts] - 1, len(packed)).astype(np.int32)
    terms = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(packed)])
    return np.searchsorted(offsets[1:], starts, side="right"), terms.dictionary_encode()


def _counted(batch: pa.RecordBatch) -> pa.Table:
    """Postings of one slice of documents."""
    owner, terms = terms_of(batch.column("text"))
    codes, distinct = np.asarray(terms.indices, dtype=np.int64), len(terms.dictionary)
    pairs, n = np.unique(owner * max(1, distinct) + codes, return_counts=True)
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    group = np.asarray(lang.indices, dtype=np.int64) * max(1, len(source.dictionary)) + np.asarray(source.indices)
    keys, of = np.unique(group[pairs // max(1, distinct)] * max(1, distinct) + pairs % max(1, distinct), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, of, n)
    g, t = keys // max(1, distinct), keys % max(1, distinct)
    columns = [lang.dictionary.take(pa.array(g // max(1, len(source.dictionary)))), terms.dictionary.take(pa.array(t)), source.dictionary.take(pa.array(g % max(1, len(source.dictionary))))]
    return pa.table([*columns, pa.array(total), pa.array(np.bincount(of, minlength=len(keys)).astype(np.int64))], schema=POSTINGS)


def _together(tables: list[pa.Table]) -> pa.Table:
    summed = pa.concat_tables(tables).group_by(["lang", "term", "source"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return summed.select(["lang", "term", "source", "n_sum", "docs_sum"]).rename_columns(POSTINGS.names)


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, POSTINGS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table, max_chunksize=PIECE)
    return sink.getvalue().to_pybytes()


def _merged(runs: list[bytes], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Sorted runs as tables in order, each with whole terms; what runs have of a (language, term, source) is summed.

    A heap holds the next piece of every run by its first term. Pieces are taken from it in order, and as soon as about
    ``rows`` rows are at hand all terms before the heap's least one, which no run can have more of, go out.
    """
    streams, heap = [iter(pa.ipc.open_stream(run)) for run in runs], []

    def push(i: int) -> None:
        batch = next(streams[i], None)
        if batch is not None:
            heapq.heappush(heap, ((batch["lang"][0].as_py(), batch["term"][0].as_py()), i, batch))

    for i in range(len(streams)):
        push(i)
    held, n, full = [], 0, rows
    while heap:
        _, i, batch = heapq.heappop(heap)
        held.append(pa.Table.from_batches([batch]))
        n += batch.num_rows
        push(i)
        if n >= full and heap:
            (lang, term), *_ = heap[0]
            whole = _together(held)
            over = pc.and_(pc.equal(whole["lang"], lang), pc.greater_equal(whole["term"], term))
            over = pc.or_(over, pc.greater(whole["lang"], lang))
            yield _in_order(whole.filter(pc.invert(over)))
            held = [whole.filter(over)]
            n = held[0].num_rows
            full = n + rows
    if held:
        yield _in_order(_together(held))


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by([(c, "ascending") for c in ("lang", "term", "source")])


def _cut(run: int, table: pa.Table, shards: int) -> pa.RecordBatch:
    """A spilled run: sorted, a row for each shard that has some of it."""
    terms = table["term"].combine_chunks().dictionary_encode()
    where = np.fromiter((xxhash.xxh3_64_intdigest(t) % shards for t in terms.dictionary.to_pylist()), np.int32, len(terms.dictionary))
    table = table.append_column("shard", pa.array(where[np.asarray(terms.indices)])).sort_by([(c, "ascending") for c in ("shard", "lang", "term", "source")])
    at = np.asarray(table["shard"])
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), at[1:] != at[:-1])))
    packed = [_pack(table.slice(a, b - a).drop_columns(["shard"])) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(at[starts], pa.int32()), pa.array(np.full(len(starts), run, np.int64)), pa.array(packed, pa.binary())], names=["shard", "run", "postings"])


def index_runs(docs: DataFrame, shards: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(shard, run, postings): blocks of postings of ``docs`` (text, lang, source; no nulls), spilled as sorted runs."""

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, block, held = TaskContext.get().partitionId() << 24, [], 0
        for batch in common.slices(batches):
            block.append(_counted(batch))
            held += block[-1].nbytes
            if held > block_bytes:
                block = [_together(block)]
                held = block[0].nbytes
                if held > block_bytes // 2:
                    yield _cut(run, block[0], shards)
                    run, block, held = run + 1, [], 0
        if block:
            yield _cut(run, _together(block), shards)

    return docs.select("text", "lang", "source").mapInArrow(index, RUN)


def merge_runs(runs: DataFrame, shards: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge runs in rounds until no shard has more than ``fan_in``."""

    def merge(table: pa.Table) -> pa.Table:
        merged = pa.concat_tables(_merged(table["postings"].to_pylist()))
        return pa.table({"shard": table["shard"].slice(0, 1), "run": table["lot"].slice(0, 1), "postings": pa.array([_pack(merged)], pa.binary())})

    while (most := runs.groupBy("shard").count().agg(F.max("count")).first()[0] or 0) > fan_in:
        lots = -(-most // (fan_in // 2))  # about half of fan_in to a lot
        lotted = runs.select("shard", F.pmod(F.xxhash64("run"), F.lit(lots)).alias("lot"), "postings")
        runs = common.materialise(lotted.groupBy("shard", "lot").applyInArrow(merge, RUN))
    return runs


def term_frequencies(docs: DataFrame, least_docs: int = 3, shards: int | None = None, block_bytes: int = BLOCK_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """(lang, term, n, groups): terms in at least ``least_docs`` rows of their language, with occurrences by source.

    ``docs`` has text, lang and source without nulls; every row is a document. ``shards`` is the number of shuffle
    partitions if not given. A task that merges holds the packed runs of one shard.
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = merge_runs(common.materialise(index_runs(docs, shards, block_bytes)), shards, fan_in)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = [x for batch in batches for x in batch.column("postings").to_pylist()]
        for table in _merged(packed):
            yield from _by_term(table.combine_chunks(), least_docs).to_batches(max_chunksize=8192)

    shuffled = runs.repartitionById(shards, F.col("shard"))
    return shuffled.mapInArrow(merge, "lang string, term string, n long, groups array<struct<source: string, n: long>>")


def _by_term(table: pa.Table, least_docs: int) -> pa.Table:
    """A row for each term in enough documents, with its sources, from sorted rows (language, term, source)."""
    codes = [np.asarray(table[c].combine_chunks().dictionary_encode().indices) for c in ("lang", "term")]
    new = np.concatenate((np.ones(min(1, table.num_rows), bool), (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])))
    starts = np.flatnonzero(new)
    n, docs = (np.asarray(table[c]) for c in ("n", "docs"))
    kept = np.add.reduceat(docs, starts) >= least_docs if len(starts) else np.zeros(0, bool)
    sizes = np.diff(np.append(starts, table.num_rows))
    rows = table.filter(pa.array(np.repeat(kept, sizes)))
    groups = pa.StructArray.from_arrays([rows["source"].combine_chunks(), rows["n"].combine_chunks()], names=["source", "n"])
    cuts = np.concatenate(([0], np.cumsum(sizes[kept])))
    heads = table.take(pa.array(starts[kept]))
    total = np.add.reduceat(n, starts)[kept] if len(starts) else np.zeros(0, np.int64)
    return pa.table({"lang": heads["lang"], "term": heads["term"], "n": pa.array(total), "groups": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), groups)})


def _part_of(count: str, whole: str) -> str:
    """SQL for 1 + floor(10^9 (count + 1) / whole), three digits at a time, so that nothing overflows."""
    first, rest = f"(1000 * ({count} + 1)) div {whole}", f"(1000 * ({count} + 1)) % {whole}"
    second, last = f"(1000 * ({rest})) div {whole}", f"(1000 * ((1000 * ({rest})) % {whole})) div {whole}"
    return f"(1 + 1000000 * ({first}) + 1000 * ({second}) + ({last}))"


def _parts_of(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    part, rest = np.ones(len(count), np.int64), count + 1
    for unit in (1_000_000, 1_000, 1):
        part, rest = part + unit * (1000 * rest // whole), 1000 * rest % whole
    return part


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _both_have(frequencies: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value): sums over terms that both have of f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0).

    p and q are the two sources' parts for the term, p0 and q0 those of terms that they don't have.
    """
    few = totals.select("lang", "source", "whole", "none").limit(MAX_GROUPS + 1).collect()
    if len(few) <= MAX_GROUPS:
        shared = frequencies.sparkSession.sparkContext.broadcast({(r.lang, r.source): (i, r.whole, r.none) for i, r in enumerate(few)})
        rows = frequencies.select("lang", F.col("groups.source").alias("source"), F.col("groups.n").alias("n"), F.lit(None).cast("array<long>").alias("whole"), F.lit(None).cast("array<long>").alias("none"))
    else:
        shared = None
        each = frequencies.select("lang", "term", F.inline("groups")).join(totals.select("lang", "source", "whole", "none"), ["lang", "source"])
        listed = each.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n", "whole", "none")).alias("x"))
        rows = listed.select("lang", *[F.col(f"x.{c}").alias(c) for c in ("source", "n", "whole", "none")])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {k: v[0] for k, v in shared.value.items()} if shared else {}
        names, sums = list(ids), {}
        for batch in batches:
            sizes = np.asarray(batch.column("source").value_lengths(), dtype=np.int64)
            langs = np.repeat(np.asarray(batch.column("lang").to_pylist(), object), sizes).tolist()
            keys = list(zip(langs, batch.column("source").flatten().to_pylist(), strict=True))
            count = np.asarray(batch.column("n").flatten(), dtype=np.int64)
            if shared:
                told = np.array([shared.value[k] for k in keys], np.int64).reshape(-1, 3)
                of, whole, none = told[:, 0], told[:, 1], told[:, 2]
            else:
                whole, none = (np.asarray(batch.column(c).flatten(), dtype=np.int64) for c in ("whole", "none"))
                for k in keys:
                    if k not in ids:
                        ids[k] = len(names)
                        names.append(k)
                of = np.array([ids[k] for k in keys], np.int64)
            part, size = _parts_of(count, whole), np.repeat(sizes, sizes)
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            ends, at = np.cumsum(size), 0
            while at < len(size):  # each source with all sources of the same term, some sources at a time
                to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + MAX_PAIRS, side="right")))
                left = np.repeat(np.arange(at, to), size[at:to])
                right = first[left] + np.arange(len(left)) - np.repeat(ends[at:to] - size[at:to] - (ends[at] - size[at]), size[at:to])
                p, q, p0, q0 = part[left], part[right], none[left], none[right]
                value = (p - q) ** 2 // q - (p - q0) ** 2 // q0 - (p0 - q) ** 2 // q + (p0 - q0) ** 2 // q0
                pairs, where = np.unique(of[left] << 32 | of[right], return_inverse=True)
                total = np.zeros(len(pairs), np.int64)
                np.add.at(total, where, value)
                for pair, x in zip(pairs.tolist(), total.tolist(), strict=True):
                    sums[pair] = sums.get(pair, 0) + x
                at = to
                if len(sums) > MAX_PAIRS:
                    yield _pair_batch(sums, names)
                    sums = {}
        yield _pair_batch(sums, names)

    return rows.mapInArrow(add, "lang string, source string, item string, value long")


def _pair_batch(sums: dict[int, int], names: list[tuple[str, str]]) -> pa.RecordBatch:
    found = [(*names[k >> 32], names[k & 0xFFFFFFFF][1], x) for k, x in sums.items() if k >> 32 != k & 0xFFFFFFFF]
    columns = list(zip(*found, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()], strict=True)], names=["lang", "source", "item", "value"])


def audit_sources(docs: DataFrame, least_docs: int = 3, top: int = 200, **how) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for each (lang, source) of ``docs``; all arithmetic is on whole numbers.

    A language keeps the V terms of at least ``least_docs`` of its documents. A source gives a term 1 + floor(10^9
    (count + 1) / (N + V)), N its occurrences of kept terms; so does the language. Part ``pair``: item is another source
    of the language, value the sum over all kept terms of floor((p - q)^2 / q), q the other's part. Part ``term``: item
    is a kept term that the source has, p above the language's q, value its floor((p - q)^2 / q), only ranks to ``top``.
    Ranks go down by value, equal ones up by item.

    Null text, lang and source are empty texts; every row is a document, repeated ones too. Sources without kept terms
    have pairs (value 0 where the language keeps none) and no terms. Other columns are ignored; an empty table gives
    an empty result. Values are exact up to 9 * 10^15 occurrences in a source.
    """
    read = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    frequencies = common.materialise(term_frequencies(read, least_docs, **how))
    each = frequencies.select("lang", "term", F.col("n").alias("lang_n"), F.inline("groups"))
    kept = frequencies.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    # counts are few whatever the number of terms, so sources are totalled from their histogram
    histogram = common.materialise(each.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")))
    own = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("total"))
    totals = read.select("lang", "source").distinct().join(kept, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0, ["v", "lang_total", "total"])
    totals = totals.select("lang", "source", "v", (F.col("total") + F.col("v")).alias("whole"), (F.col("lang_total") + F.col("v")).alias("lang_whole"))
    totals = common.materialise(totals.withColumn("none", F.when(F.col("v") > 0, F.expr(_part_of("0", "whole"))).otherwise(1)))
    small = common.broadcast_if_small(totals, MAX_GROUPS)
    others = small.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"))

    # terms that one of the two has: f(p, q0) - f(p0, q0) for the one, f(p0, q) - f(p0, q0) for the other
    counted = histogram.join(small, ["lang", "source"]).withColumn("p", F.expr(_part_of("n", "whole")))
    met = counted.join(others, "lang").where("source <> item")
    one = met.groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * (_apart("p", "item_none") - _apart("none", "item_none"))).alias("value"))
    other = met.groupBy(F.col("lang"), F.col("item").alias("source"), F.col("source").alias("item")).agg(F.sum(F.col("terms") * (_apart("item_none", "p") - _apart("item_none", "none"))).alias("value"))
    start = small.join(others, "lang").where("source <> item").select("lang", "source", "item", (F.col("v") * _apart("none", "item_none")).alias("value"))
    pairs = start.unionByName(one).unionByName(other).unionByName(_both_have(frequencies, totals))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    terms = each.join(small, ["lang", "source"]).withColumn("p", F.expr(_part_of("n", "whole"))).withColumn("q", F.expr(_part_of("lang_n", "lang_whole")))
    terms = terms.where("p > q").select("lang", "source", F.col("term").alias("item"), _apart("p", "q").alias("value"))
    by = F.row_number().over(_descending())
    ranked = terms.withColumn("rank", by).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    ranked = pairs.withColumn("rank", by).withColumn("part", F.lit("pair")).unionByName(ranked)
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def _descending() -> WindowSpec:
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
