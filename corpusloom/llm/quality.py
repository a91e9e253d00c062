"""Quality rules: a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common

#: Hashed byte 4-grams fall into so many buckets; both multinomials have this fixed size.
BUCKETS = 1 << 16
GRAM = 4
#: Grams' worth of raw distribution that the trusted counts start from: with little trusted text ratios stay near 0.
PRIOR = 1 << 12
#: Fixed point of the per-gram ratio, so that sums are whole numbers and do not depend on order.
SCALE = 1_000_000


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte but the last three."""
    n = max(0, len(data) - GRAM + 1)
    key = np.zeros(n, np.uint32)
    for j in range(GRAM):
        key <<= np.uint32(8)
        key |= data[j : n + j]
    key *= np.uint32(2654435761)
    key >>= np.uint32(16)
    return key


def _gram_spans(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First gram and number of grams of each text."""
    return offsets[:-1], np.maximum(0, np.diff(offsets) - GRAM + 1)


def _inside(starts: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Which grams lie within one text."""
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, starts[counts > 0], 1)
    np.add.at(edge, (starts + counts)[counts > 0], -1)
    return np.cumsum(edge[:-1], dtype=np.int8).astype(bool)


def count_grams(docs: DataFrame, trusted: str) -> DataFrame:
    """(bucket, raw, target): grams of all texts and of those where the boolean column ``trusted`` holds.

    Each task sends one row for each bucket at most, so the shuffle is bounded by tasks x BUCKETS.
    """

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in common.slices(batches):
            data, offsets = common.raw_bytes(common.texts_of(batch))
            bucket = gram_buckets(data)
            starts, counts = _gram_spans(offsets)
            raw += np.bincount(bucket[_inside(starts, counts, len(bucket))], minlength=BUCKETS)
            flag = np.asarray(pc.fill_null(batch.column(trusted), False), dtype=bool)
            target += np.bincount(bucket[_inside(starts[flag], counts[flag], len(bucket))], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    parts = docs.select("text", trusted).mapInArrow(part, "bucket int, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """The fixed-point ratio of each bucket.

    At most BUCKETS rows come to the driver.
    """
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in counts.collect():
        raw[bucket], target[bucket] = r, t
    q = (raw + 1) / (raw.sum() + BUCKETS)
    p = (target + PRIOR * q) / (target.sum() + PRIOR)
    return np.rint(np.log(p / q) * SCALE).astype(np.int64)


def repeated_words(owner: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which words lie in a 3-word window that its own text holds twice or more."""
    hit = np.zeros(len(codes), bool)
    if len(codes) < 3:
        return hit
    base = int(codes.max()) + 1
    if base < 1 << 21:
        key = (codes[:-2] * base + codes[1:-1]) * base + codes[2:]
    else:  # too many distinct words to pack three codes into 63 bits
        pair = np.unique(codes[:-1] * base + codes[1:], return_inverse=True)[1]
        key = pair[:-1] * base + codes[2:]
    windows = np.flatnonzero(owner[:-2] == owner[2:])
    key = key[windows]
    order = np.argsort(key, kind="stable")
    key, at = key[order], windows[order]
    same = (key[1:] == key[:-1]) & (owner[at[1:]] == owner[at[:-1]])
    twice = np.concatenate((at[1:][same], at[:-1][same]))
    for j in range(3):
        hit[twice + j] = True
    return hit


def _rule_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    n = len(texts)
    tally = lambda at, weights=None: np.bincount(at, weights=weights, minlength=n).astype(np.int64)
    owner, codes, distinct = common.words_of(texts)
    chars = np.asarray(pc.utf8_length(distinct), dtype=np.int64)
    data, offsets = common.raw_bytes(texts)
    symbols = np.flatnonzero(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8)))
    lists = pc.split_pattern(texts, "\n")
    lines, line_of = lists.flatten(), np.repeat(np.arange(n), np.asarray(pc.list_value_length(lists)))
    wordy = pc.not_equal(pc.ascii_ltrim_whitespace(lines), "")
    lines, line_of = lines.filter(wordy), line_of[np.asarray(wordy)]
    line_codes = np.asarray(lines.dictionary_encode().indices, dtype=np.int64)
    first = np.unique(line_of * (len(lines) + 1) + line_codes) // (len(lines) + 1)
    return {
        "n_words": tally(owner),
        "word_chars": tally(owner, chars[codes]) if len(codes) else np.zeros(n, np.int64),
        "n_symbols": tally(np.searchsorted(offsets, symbols, side="right") - 1),
        "n_dup_lines": tally(line_of) - tally(first),
        "n_repeat_words": tally(owner[repeated_words(owner, codes)]),
    }


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = -0.35, min_words: int = 50, max_repeat_pct: int = 50, max_broadcast_labels: int = 2_000_000) -> DataFrame:
    """Judge every document: rule counts plus the length-normalised log-likelihood ratio of its hashed byte 4-grams.

    The trusted multinomial is that of all documents which ``labels`` (doc_id, quality) marks 1, the raw one that of
    the whole corpus; both have BUCKETS entries, the raw one smoothed by one each and the trusted one by PRIOR grams of
    the raw one, so without trusted text every ratio is 0. ``llr`` is the mean log ratio of a text's
    grams in millionths, rounded toward minus infinity; ``kept`` needs llr >= threshold and no failed base rule.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, llr (long), base_failed, kept to the columns of
    ``docs`` (which replace columns of these names). Null or empty texts have no words and fail; a text under four
    bytes has llr 0; null ids are never trusted; repeated rows are judged each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_good")).distinct()
    flagged = docs.select("doc_id", "text").join(common.broadcast_if_small(good, max_broadcast_labels), F.col("doc_id") == F.col("_good"), "left")
    ratios = spark.sparkContext.broadcast(log_ratios(count_grams(flagged.select("text", F.col("_good").isNotNull().alias("_trusted")), "_trusted")))
    least = int(round(threshold * SCALE))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr"]
    own = docs.drop(*[c for c in docs.columns if c in (*added, "base_failed", "kept")])
    names = own.columns

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratios.value
        for batch in common.slices(batches):
            texts = common.texts_of(batch)
            data, offsets = common.raw_bytes(texts)
            starts, counts = _gram_spans(offsets)
            value = np.append(table[gram_buckets(data)], 0)
            total = np.zeros(len(texts), np.int64)
            some = np.flatnonzero(counts)
            if len(some):
                cuts = np.stack((starts[some], (starts + counts)[some]), axis=1).ravel()
                total[some] = np.add.reduceat(value, cuts)[::2]
            rules = _rule_counts(texts)
            rules["llr"] = total // np.maximum(counts, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(rules[k], pa.int64()) for k in added)], names=[*names, *added])

    schema = common.plus(own, ", ".join(f"{k} long" for k in added))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return own.mapInArrow(judge, schema).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= least))
