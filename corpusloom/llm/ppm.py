"""LM scoring by prediction by partial matching over bytes, beside a word-count baseline.

The trie of contexts is the set of 6-grams (five context bytes and the next byte) with their training counts; the
contexts of orders 4 to 0 are its suffixes, so their counts are sums of it. With a fixed trie the probability of a
byte depends on its 6-gram alone: it is worked out once for each distinct 6-gram, where all trie nodes that share the
last three context bytes meet, and then summed by document. The trie is spread over ranges of contexts, more of them
for more text; each bucket of documents asks the ranges for the 6-grams it has. No task or driver ever holds the whole trie.

Rows between the steps carry packed arrays (sorted keys and their counts), so what is shuffled is a few bytes a key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common

ORDER = 5
#: Bytes that UTF-8 never uses: before a text, and its end, which is coded as a symbol.
BEFORE, END = b"\xfe", b"\xff"
SYMBOLS = 256
#: Texts are coded in segments of so many characters, cut at white space (a longer word stays whole).
SEGMENT = 1 << 20
#: Characters of a block of segments (one row), and of a bucket of blocks, whose keys are looked up together.
BLOCK, BUCKET = 4 << 20, 32 << 20
#: Ranges of keys: one for so much text, within bounds that keep packed rows of a useful size.
RANGE_BYTES, FEWEST, MOST = 2 << 30, 256, 1 << 14
#: Code lengths are kept in whole 1e-8 of a decade, so that sums do not depend on order.
SCALE = 100_000_000
GRAM, WORD = 0, 1


def pack(values: np.ndarray) -> bytes:
    """64-bit integers as compressed planes of bytes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys, as differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)).view(np.int64))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).view(np.uint64), dtype=np.uint64)


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and their counts."""
    if not len(ordered):
        return ordered, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[at], np.diff(np.append(at, len(ordered)))


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key of parts that are sorted each."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    distinct, sizes = runs(keys[order])
    counts = np.concatenate([c for _, c in parts])[order]
    return distinct, np.add.reduceat(counts, np.cumsum(sizes) - sizes) if len(distinct) else counts


def cut_segments(text: str, size: int) -> list[str]:
    """Consecutive parts of about ``size`` characters that end behind white space, so that no word is divided."""
    parts, start = [], 0
    while len(text) - start > size:
        end = start + size
        if text[end - 1] not in common.ASCII_SPACE:
            end = min((at + 1 for at in (text.find(c, end) for c in common.ASCII_SPACE) if at >= 0), default=len(text))
        parts.append(text[start:end])
        start = end
    return [*parts, text[start:]]


def segment_documents(docs: DataFrame, train: Column, size: int = SEGMENT) -> DataFrame:
    """(bucket, block): Arrow streams of segments (row, part, doc_id, train, head, text, last), head being the bytes before.

    A bucket is a stretch of one task's texts; the result is written, so buckets and row numbers stay as they are.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, row, seen, held, filled = TaskContext.get().partitionId() << 33, 0, 0, [], 0

        def block():
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), SEGMENTS)], schema=SEGMENTS)  # noqa: B905
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, SEGMENTS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            bucket = first + seen // BUCKET
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["bucket", "block"])

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                for doc, text, flag in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("train").to_pylist(), strict=True):
                    head, pieces = BEFORE * ORDER, cut_segments(text or "", size)
                    for k, piece in enumerate(pieces):
                        held.append((first + row, k, doc, flag, head, piece, k + 1 == len(pieces)))
                        filled += len(piece)
                        if filled >= BLOCK or len(held) >= 1 << 15:
                            yield block()
                            seen, held, filled = seen + filled, [], 0
                        head = (head + piece[-ORDER:].encode())[-ORDER:]
                    row += 1
        if held:
            yield block()

    return common.materialise(docs.select("doc_id", "text", train.alias("train")).mapInArrow(cut, "bucket long, block binary"))


SEGMENTS = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("train", pa.bool_()), ("head", pa.binary()), ("text", pa.string()), ("last", pa.bool_())])


def open_block(block: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(block).read_next_batch()


def packed_grams(segments: pa.RecordBatch) -> np.ndarray:
    """Sorted (6-gram << 16 | index of its segment) of all symbols of at most 2^16 segments, ends included."""
    tail = pc.if_else(segments.column("last"), pa.scalar(END), pa.scalar(b""))
    data, offsets = common.raw_bytes(pc.binary_join_element_wise(segments.column("head"), segments.column("text").cast(pa.binary()), tail, b""))
    n = len(data) - ORDER
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = data[:n].astype(np.uint64)
    for j in range(1, ORDER + 1):
        key <<= np.uint64(8)
        key |= data[j : n + j]
    key <<= np.uint64(16)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    key |= owner[ORDER:]
    key = key[owner[ORDER:] == owner[:n]]
    key.sort()
    return key


def word_keys(words: pa.Array) -> np.ndarray:
    """64-bit hashes that stand for distinct words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def gram_range(gram: np.ndarray, ranges: int) -> np.ndarray:
    """The range that a 6-gram's last three context bytes belong to."""
    return word_range(common.mix64((gram >> np.uint64(8)) & np.uint64(0xFFFFFF)), ranges)


def word_range(key: np.ndarray, ranges: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def count_keys(blocks: DataFrame, ranges: int = FEWEST) -> DataFrame:
    """(bucket, kind, range, keys, counts): the distinct 6-grams and words of each bucket, with their training counts.

    Keys of held-out texts are there too, with count 0.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [])

        def send():
            for kind in (GRAM, WORD):
                keys, counts = merge(held[kind])
                at = gram_range(keys, ranges) if kind == GRAM else word_range(keys, ranges)
                order = np.argsort(at, kind="stable")
                keys, counts, cuts = keys[order], counts[order], np.searchsorted(at[order], np.arange(ranges + 1))
                some = [r for r in range(ranges) if cuts[r + 1] > cuts[r]]
                columns = [pa.array([now] * len(some), pa.int64()), pa.array([kind] * len(some), pa.int32()), pa.array(some, pa.int32())]
                columns += [pa.array([pack_keys(keys[cuts[r] : cuts[r + 1]]) for r in some], pa.binary()), pa.array([pack(counts[cuts[r] : cuts[r + 1]]) for r in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "kind", "range", "keys", "counts"])

        for batch in batches:
            for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block"), strict=True):
                if now is not None and bucket != now:
                    yield from send()
                    held = ([], [])
                now, segments = bucket, open_block(block.as_py())
                for flag in (True, False):
                    some = segments.filter(segments.column("train") if flag else pc.invert(segments.column("train")))
                    if some.num_rows:
                        gram, n = runs(packed_grams(some) >> np.uint64(16))
                        held[GRAM].append((gram, n if flag else n * 0))
                owner, codes, words = common.words_of(pc.ascii_lower(segments.column("text")))
                n = np.bincount(codes[np.asarray(segments.column("train"))[owner]], minlength=len(words))
                keys = word_keys(words)
                order = np.argsort(keys)
                held[WORD].append((keys[order], n[order]))
        if now is not None:
            yield from send()

    return common.materialise(blocks.mapInArrow(count, "bucket long, kind int, range int, keys binary, counts binary"))


def total_keys(counts: DataFrame) -> DataFrame:
    """(kind, range, keys, counts, tokens, distinct, low, low_counts): each range's keys with counts over all buckets.

    tokens and distinct are sums for keys with a count above 0; low are the range's 3-grams (two context bytes).
    """
    schema = "kind int, range int, keys binary, counts binary, tokens long, distinct long, low array<int>, low_counts array<long>"

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def send():
            keys, n = merge(held)
            low, low_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if now[0] == GRAM:
                low, at = np.unique((keys & np.uint64(0xFFFFFF)).astype(np.int64), return_inverse=True)
                low_n = np.bincount(at, weights=n, minlength=len(low)).astype(np.int64)
            row = [now[0], now[1], pack_keys(keys), pack(n), int(n.sum()), int((n > 0).sum()), low, low_n]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=[x.split()[0] for x in schema.split(", ")])  # noqa: B905

        for batch in batches:
            for kind, range_, keys, n in zip(*(batch.column(c) for c in ("kind", "range", "keys", "counts")), strict=True):
                at = (kind.as_py(), range_.as_py())
                if now is not None and at != now:
                    yield send()
                    held = []
                now = at
                held.append((unpack_keys(keys.as_py()), unpack(n.as_py())))
                if len(held) >= 16:  # so that memory follows the distinct keys, not the number of buckets
                    held = [merge(held)]
        if now is not None:
            yield send()

    dealt = counts.select("kind", "range", "keys", "counts").repartition("kind", "range").sortWithinPartitions("kind", "range")
    return common.materialise(dealt.mapInArrow(fold, schema))


class Low:
    """Counts of orders 2 to 0, known to all tasks: at most 2^24 entries whatever the corpus, a few ten thousand in practice."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        self.grams, self.counts = grams[order].astype(np.uint64), counts[order]
        self.pair = np.zeros((256, 256), np.int64)
        np.add.at(self.pair, (((self.grams >> np.uint64(8)) & np.uint64(255)).astype(int), (self.grams & np.uint64(255)).astype(int)), self.counts)

    def of(self, grams: np.ndarray) -> np.ndarray:
        return self.counts[np.searchsorted(self.grams, grams)]


def gram_log_probs(gram: np.ndarray, n: np.ndarray, low: Low) -> np.ndarray:
    """log10 of each 6-gram's PPM probability; no 6-gram that shares the last three context bytes with one is missing.

    Escape method D with symbol exclusion. At a context seen n times with q distinct next symbols a symbol seen c times
    has (2 c - 1) / 2 n and escape q / 2 n; symbols that longer contexts have seen count neither in n nor in q, as the
    escapes so far have ruled them out. Below order 0 the symbols never seen are alike.
    """
    prob, open_, carry = np.zeros(len(gram)), np.ones(len(gram), bool), np.ones(len(gram))
    out_n, out_q = np.zeros(len(gram)), np.zeros(len(gram))  # what longer contexts exclude here

    def level(c, total, kinds):
        nonlocal open_
        rest, left = total - out_n, kinds - out_q
        here, some = open_ & (c > 0), rest > 0
        prob[here] = carry[here] * (c[here] - 0.5) / rest[here]
        open_ &= ~here
        go = open_ & some
        carry[go] *= 0.5 * left[go] / rest[go]

    def counted(keys, weights):
        distinct, at = np.unique(keys, return_inverse=True)
        return distinct, at, np.bincount(at, weights=weights, minlength=len(distinct))

    # orders above 2 from this range alone, order 2 from the table that all tasks have
    tables = {j: counted(gram & np.uint64((1 << 8 * (j + 1)) - 1), n) for j in range(ORDER, 2, -1)}
    for j in range(ORDER, 2, -1):
        grams, at, c = tables[j]
        _, ctx, total = counted(grams >> np.uint64(8), c)
        kinds = np.bincount(ctx, weights=c > 0, minlength=len(total))
        level(c[at], total[ctx][at], kinds[ctx][at])
        shorter = grams & np.uint64((1 << 8 * j) - 1)
        if j > 3:
            down = tables[j - 1][2][np.searchsorted(tables[j - 1][0], shorter)]
        else:
            down = low.of(shorter)
        out_n, out_q = np.bincount(ctx, weights=down * (c > 0), minlength=len(total))[ctx][at], kinds[ctx][at]
    symbol, last = (gram & np.uint64(255)).astype(np.int64), ((gram >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
    # order 2: totals by context over the whole table
    ctx2, at2, total2 = counted(low.grams >> np.uint64(8), low.counts)
    kinds2 = np.bincount(at2, weights=low.counts > 0, minlength=len(ctx2))
    down2 = low.pair[((low.grams >> np.uint64(8)) & np.uint64(255)).astype(int), (low.grams & np.uint64(255)).astype(int)]
    below2 = np.bincount(at2, weights=down2 * (low.counts > 0), minlength=len(ctx2))
    mine = np.searchsorted(ctx2, (gram >> np.uint64(8)) & np.uint64(0xFFFF))
    level(low.of(gram & np.uint64(0xFFFFFF)), total2[mine], kinds2[mine])
    out_n, out_q = below2[mine], kinds2[mine]
    zero, seen = low.pair.sum(axis=0), low.pair > 0
    level(low.pair[last, symbol], low.pair.sum(axis=1)[last], seen.sum(axis=1)[last])
    out_n, out_q = (seen @ zero)[last], seen.sum(axis=1)[last]
    level(zero[symbol], np.full(len(gram), zero.sum()), np.full(len(gram), (zero > 0).sum()))
    prob[open_] = carry[open_] / max(1, SYMBOLS - (zero > 0).sum())
    return np.log10(prob)


def answer_keys(counts: DataFrame, totals: DataFrame, low: Low) -> DataFrame:
    """(bucket, kind, keys, answers): for each bucket's 6-grams their code, for its words their training counts."""
    shared = counts.sparkSession.sparkContext.broadcast(low)
    none = F.lit(None)
    asked = counts.select("kind", "range", F.lit(1).alias("turn"), "bucket", "keys", none.cast("binary").alias("counts"))
    known = totals.select("kind", "range", F.lit(0).alias("turn"), none.cast("long").alias("bucket"), "keys", "counts")

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, answers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            out = []
            for kind, turn, bucket, packed, n in zip(*(batch.column(c) for c in ("kind", "turn", "bucket", "keys", "counts")), strict=True):
                mine = unpack_keys(packed.as_py())
                if turn.as_py() == 0:
                    keys, answers = mine, unpack(n.as_py())
                    if kind.as_py() == GRAM:
                        answers = np.rint(gram_log_probs(keys, answers, shared.value) * SCALE).astype(np.int64)
                else:
                    out.append((bucket.as_py(), kind.as_py(), packed.as_py(), pack(answers[np.searchsorted(keys, mine)])))
            if out:
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["bucket", "kind", "keys", "answers"])  # noqa: B905

    met = known.unionByName(asked).repartition("kind", "range").sortWithinPartitions("kind", "range", "turn")
    return met.mapInArrow(answer, "bucket long, kind int, keys binary, answers binary")


def score_documents(docs: DataFrame, train: Column, alpha: float = 0.1, segment: int = SEGMENT) -> DataFrame:
    """Score every document with a model learnt from those where ``train`` holds.

    Returns a row for each row of ``docs``: doc_id, train, n_tokens, n_known, train_tokens (long), base_score and
    score (double). ``score`` is the log10 probability of the text's bytes and its end by PPM of order ORDER;
    ``base_score`` that of its words (A-Z lower-cased, split at ASCII white space) and its end by their training
    counts with additive smoothing ``alpha``. Words are told apart by 64-bit hashes.

    Null or empty text is the end alone; null ids and repeated rows are documents as any other; a null ``train`` is
    false. Without any training text all symbols are alike. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    blocks = segment_documents(docs, F.coalesce(train, F.lit(False)), segment)
    text = blocks.agg(F.sum(F.octet_length("block").cast("long"))).first()[0] or 0  # compressed, about a third of the text
    counts = count_keys(blocks, int(min(MOST, max(FEWEST, 3 * text // RANGE_BYTES))))
    totals = total_keys(counts)
    pairs = totals.where(F.col("kind") == GRAM).select(F.explode(F.arrays_zip("low", "low_counts")).alias("x"))
    pairs = pairs.groupBy(F.col("x.low").alias("low")).agg(F.sum("x.low_counts").alias("n")).toArrow()
    low = Low(pairs["low"].to_numpy(), pairs["n"].to_numpy())
    # the end of a text is a token too: as many as training texts, which are also the 6-grams that end in END
    ends = int(low.counts[(low.grams & np.uint64(255)) == END[0]].sum())
    n, v = totals.where(F.col("kind") == WORD).agg(F.sum("tokens"), F.sum("distinct")).first()
    n, v = (n or 0) + ends, (v or 0) + (ends > 0)
    logs = lambda c: np.log10((c + alpha) / (n + alpha * (v + 1)))
    none = F.lit(None).cast("binary")
    asked = answer_keys(counts, totals, low).select("bucket", "kind", "keys", "answers", none.alias("block"))
    texts = blocks.select("bucket", F.lit(2).alias("kind"), none.alias("keys"), none.alias("answers"), "block")
    met = asked.unionByName(texts).repartition("bucket").sortWithinPartitions("bucket", "kind")
    schema = "row long, doc_id long, train boolean, n_tokens long, n_known long, base_score double, code long"

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tables = None, ([], []), None
        for batch in batches:
            for bucket, kind, keys, answers, block in zip(*(batch.column(c) for c in ("bucket", "kind", "keys", "answers", "block")), strict=True):
                if bucket.as_py() != now:
                    now, held, tables = bucket.as_py(), ([], []), None
                if (kind := kind.as_py()) < 2:
                    held[kind].append((unpack_keys(keys.as_py()), unpack(answers.as_py())))
                    continue
                if tables is None:
                    tables = [sort_pairs(x) for x in held]
                    held = ([], [])
                segments = open_block(block.as_py())
                m, last = segments.num_rows, np.asarray(segments.column("last"))
                packed = packed_grams(segments)
                values, sizes = runs(packed >> np.uint64(16))
                code = np.repeat(tables[GRAM][1][np.searchsorted(tables[GRAM][0], values)], sizes)
                order = (packed & np.uint64(0xFFFF)).astype(np.int64)
                owner, codes, distinct = common.words_of(pc.ascii_lower(segments.column("text")))
                c = tables[WORD][1][np.searchsorted(tables[WORD][0], word_keys(distinct))] if len(distinct) else np.zeros(0, np.int64)
                tokens = np.bincount(owner, minlength=m) + last
                known = np.bincount(owner, weights=(c > 0)[codes], minlength=m).astype(np.int64) + last * int(ends > 0)
                base = np.bincount(owner, weights=logs(c)[codes], minlength=m) + last * float(logs(ends))
                total = np.bincount(order, weights=code, minlength=m).astype(np.int64)  # whole numbers below 2^53
                made = [pa.array(tokens), pa.array(known), pa.array(base), pa.array(total)]
                yield pa.RecordBatch.from_arrays([*(segments.column(x) for x in ("row", "doc_id", "train")), *made], names=[x.split()[0] for x in schema.split(", ")])

    total_of = [F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score")]
    scored = met.mapInArrow(score, schema).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("train").alias("train"), *total_of, (F.sum("code") / SCALE).alias("score"))
    return scored.drop("row").withColumn("train_tokens", F.lit(n).cast("long"))


def sort_pairs(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, values = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))  # noqa: B905
    order = np.argsort(keys)
    return keys[order], values[order]
