"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common

#: Sources that go to all tasks; more are met by a shuffle.
MAX_SOURCES = 500_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share_pct: int = 150, max_epochs: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take ``weights`` in turn and share ``share_pct`` percent of all sizes; a target
    stops at ``max_epochs`` times its source's size and the excess is shared again by weight until none is above.
    That fixed point is a water level: sources in order of size over weight are full until the level of the rest,
    (budget - full ones) / weight of the rest, is below the next one's own. Two range sorts of the sources, so there
    can be as many as there are hosts.
    """
    named = sizes.select("source", "source_size", F.col("source").isNull().alias("last"), F.lit(1).alias("one"))
    ranked = common.running_sums(named, ["last", "source"], {"place": "one"})
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", "last", weight.cast("long").alias("w"), (F.lit(max_epochs) * F.col("source_size")).cast("long").alias("cap"))
    ranked = common.running_sums(ranked.withColumn("at", F.col("cap") / F.col("w")), ["at", "last", "source"], {"caps": "cap", "weights": "w"})
    whole = ranked.agg(F.sum("source_size").alias("all"), F.sum("w").alias("all_w")).first()
    budget = (whole["all"] or 0) * share_pct / 100
    level = (F.lit(budget) - (F.col("caps") - F.col("cap"))) / (F.lit(whole["all_w"] or 0) - F.col("weights") + F.col("w"))
    opened = ranked.withColumn("level", level).where(F.col("level") * F.col("w") < F.col("cap"))
    best = opened.agg(F.min(F.struct("at", "level")).alias("b")).first()["b"]
    full = F.col("cap").cast("double")
    target = full if best is None else F.least(full, F.lit(best["level"]) * F.col("w"))
    return ranked.select("source", "source_size", target.alias("target"))


def shuffle_key(epoch: Column) -> Column:
    """The order of a source's documents in one epoch: pseudo-random, the same in each run; by ``name`` where there is no id."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.col("_name")), epoch.cast("string"))))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share_pct: int = 150, max_epochs: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """Give every document the words that a mix of all sources takes from it.

    Each source's documents come in a shuffled order once an epoch; a copy's virtual finish time is the source's
    words up to its end over the source's target. All copies are range-sorted by finish time into one queue, which is
    cut where its words pass the total of the targets. Both running sums, that of each source and that of the queue,
    come from a range sort over all copies, so no source is gathered in one task, nor are the rows without an id.

    Returns doc_id, source, size, source_size (long), target (double), taken (long), queue_pos (long, from 0: the
    place of the first copy that is taken, null if none is) and the columns of ``keep``, a row for each row of ``docs``.
    Null text has size 0; null source is a source of its own; null ids (shuffled by a hash of their text) and repeated
    rows are documents as any other (rows alike in doc_id, source and size are interchangeable; the rest does not depend on how rows are dealt to
    files). An empty table gives an empty result.
    """
    name = F.when(F.col("doc_id").isNull(), F.concat(F.lit("text "), F.hex(F.xxhash64("text"))))
    base = common.materialise(docs.select("doc_id", "source", common.word_count().alias("size"), F.monotonically_increasing_id().alias("_row"), name.alias("_name"), *keep))
    targets = common.materialise(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share_pct, max_epochs))
    same = F.col("source").eqNullSafe(F.col("_t"))
    few = common.broadcast_if_small(targets.withColumnRenamed("source", "_t"), MAX_SOURCES)
    copies = base.where("size > 0").select("_row", "source", "doc_id", "size", "_name", F.explode(F.array(*[F.lit(e) for e in range(max_epochs)])).alias("epoch"))
    copies = copies.withColumn("key", shuffle_key(F.col("epoch"))).drop("_name")
    lined = common.running_sums(copies, ["source", "epoch", "key", "doc_id", "size", "_row"], {"upto": "size"})
    start = lined.groupBy(F.col("source").alias("_t")).agg(F.min(F.col("upto") - F.col("size")).alias("start"))
    few_starts = common.broadcast_if_small(targets.join(start, F.col("source").eqNullSafe(F.col("_t"))).select("_t", "start", "target"), MAX_SOURCES)
    finish = (F.col("upto") - F.col("start")) / F.col("target")
    timed = lined.join(few_starts, same).select("_row", "source", "epoch", "key", "doc_id", "size", finish.alias("finish"), F.lit(1).alias("one"))
    queue = common.running_sums(timed, ["finish", "source", "epoch", "key", "doc_id", "_row"], {"words": "size", "place": "one"})
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    chosen = queue.where(F.col("words") <= F.floor(F.lit(total) + 1e-6))
    taken = chosen.groupBy(F.col("_row").alias("_r")).agg(F.sum("size").alias("taken"), (F.min("place") - 1).alias("queue_pos"))
    sized = base.join(taken, F.col("_row") == F.col("_r"), "left").join(few, same)
    return sized.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "queue_pos", *keep)


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share_pct: int = 150, max_epochs: int = 2) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, columns as they are.

    Rows without words are never taken. Nulls and repeated rows as in mix_sources.
    """
    names = docs.columns
    key, times = common.free_name(docs, "_key"), common.free_name(docs, "_times")
    keyed = common.materialise(docs.withColumn(key, F.monotonically_increasing_id()))
    taken = mix_sources(keyed.select("doc_id", "source", "text", key), weights, share_pct, max_epochs, keep=(key,)).where("taken > 0")
    counted = taken.select(key, F.expr("cast(taken div size as int)").alias(times))
    copies = keyed.join(counted, key).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return copies.select(*[F.col(f"`{n}`") for n in names])
