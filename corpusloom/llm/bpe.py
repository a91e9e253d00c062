"""Byte-level BPE: chunks are pre-tokenised apart, stitched where their boundaries meet again, then encoded."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import common

#: Characters behind its end that a match may depend on; boundaries nearer to a chunk's end don't count. The given pattern
#: looks one character ahead of a run of white space, and takes "'re" as a whole; a pattern that looks further ahead (such
#: as ``\\s*[\\r\\n]+``, which gives back a whole run of blanks if no line end follows) needs a margin above its longest run.
MARGIN = 16
#: Entries of a worker's memo of encoded pre-tokens, and the longest one kept. It never changes a result.
MEMO, MEMO_CHARS = 150_000, 40


@dataclass(frozen=True)
class Vocabulary:
    """A rank file (base64 token, rank on each line) and the pattern whose matches are encoded separately."""

    ranks: bytes
    pattern: str

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def table(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines()) if a}


class Coder:
    """A vocabulary made ready in a worker."""

    def __init__(self, vocabulary: Vocabulary):
        table = vocabulary.table()
        self.find = regex.compile(vocabulary.pattern).findall
        self.encoding = tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=table, special_tokens={})
        self.tokens = [b""] * (max(table.values(), default=-1) + 1)
        for token, rank in table.items():
            self.tokens[rank] = token
        self.memo: dict[str, bytes] = {}

    def _fresh(self, piece: str) -> bytes:
        ids = np.array(self.encoding.encode_ordinary(piece), dtype="<u4").tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[piece] = ids
        return ids

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers."""
        known, fresh = self.memo.get, self._fresh
        return [known(p) or fresh(p) for p in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def coder(vocabulary: Vocabulary) -> Coder:
    return Coder(vocabulary)


def cut_chunks(text: str, size: int, overlap: int) -> list[str]:
    """Chunks of ``size`` characters, each but the last with the ``overlap`` that follows it."""
    if len(text) <= size + overlap:
        return [text]
    return [text[a : a + size + overlap] for a in range(0, len(text) - overlap, size)]


def stitch(chunks: list[tuple[str, list[str]]], size: int, find) -> list[str]:
    """Pre-tokens of the whole text from (chunk, its pre-tokens) in order.

    Two neighbours are joined at the first boundary that both have in their overlap: up to it the earlier chunk's
    pre-tokens hold, and as a match depends on nothing before its start, from it on the later chunk's hold. Where an
    overlap has no common boundary, both texts are joined and scanned again (a run without any boundary takes in twice
    the text each time), so the result is always that of one scan.
    """
    done: list[str] = []
    text, pieces = chunks[0]
    start, need = 0, 0
    for k in range(1, len(chunks)):
        after, later = chunks[k]
        base = k * size - start  # where the next chunk begins in this text
        if need:  # still taking in text
            text += after[len(text) - base :]
            if len(text) < need and k + 1 < len(chunks):
                continue
            pieces, need = find(text), 0
            continue
        ends, at = {}, 0
        for i, piece in enumerate(pieces):
            at += len(piece)
            if base <= at <= len(text) - MARGIN:
                ends[at - base] = i + 1
        at, meet = 0, (ends[0], 0) if 0 in ends else None
        for j, piece in enumerate(later):
            if meet or at > len(text) - base:
                break
            at += len(piece)
            meet = (ends[at], j + 1) if at in ends else None
        if meet:
            done += pieces[: meet[0]]
            start, text, pieces = k * size + at, after[at:], later[meet[1] :]
        else:
            need = 2 * len(text)
            text += after[len(text) - base :]
            if len(text) >= need or k + 1 == len(chunks):
                pieces, need = find(text), 0
    return done + pieces


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, size: int = 32_768, overlap: int = 1_024) -> DataFrame:
    """Add ``ids`` (array of int), each match of the vocabulary's pattern encoded separately, no special tokens.

    Texts are cut into chunks of ``size`` characters with ``overlap`` more. A text of one chunk is encoded where it
    is; the chunks of longer ones are dealt to all tasks, pre-tokenised there, and met again by document to be
    stitched and encoded, so one long text does not hold up a task. Whole texts are encoded, however long.

    Null text counts as empty: no ids. Repeated rows are encoded each, null ids as well; other columns stay and a
    column ``ids`` is replaced; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    docs = docs.drop("ids")
    names = docs.columns
    row_name = common.free_name(docs, "_row")
    long_text = F.char_length("text") > size + overlap

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(shared.value)
        for batch in batches:
            for part in common.slices([batch]):
                ids = [b"".join(code.encode(code.find(t))) if t else b"" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), id_lists(ids)], names=[*names, "ids"])
        code.memo.clear()  # workers are used again, for other things too

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("_row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                chunks = cut_chunks(text, size, overlap)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(chunks), pa.int64()), pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.string())], names=["_row", "k", "chunk"])

    def pretokenise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                pieces = [code.find(t) for t in part.column("chunk").to_pylist()]
                widths = pa.array([np.fromiter(map(len, p), np.int32, len(p)) for p in pieces], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(n) for n in ("_row", "k", "chunk")] + [widths], names=["_row", "k", "chunk", "widths"])

    def join(group: pa.Table) -> pa.Table:
        code = coder(shared.value)
        group = group.sort_by("k")
        chunks = []
        for text, widths in zip(group["chunk"].to_pylist(), group["widths"].to_pylist(), strict=True):
            ends = np.cumsum(widths).tolist()
            chunks.append((text, [text[a:b] for a, b in zip([0, *ends], ends)]))  # noqa: B905
        ids = b"".join(code.encode(stitch(chunks, size, code.find)))
        return pa.table({"_row": group["_row"].slice(0, 1), "ids": id_lists([ids])})

    ids_schema = common.plus(docs, "ids array<int>")
    short = docs.where(F.coalesce(~long_text, F.lit(True))).mapInArrow(whole, ids_schema)
    # written, because the row numbers must be the same in both uses below
    keyed = common.materialise(docs.where(long_text).select(F.monotonically_increasing_id().alias(row_name), *[F.col(f"`{n}`") for n in names]))
    chunks = keyed.select(F.col(row_name).alias("_row"), "text").mapInArrow(cut, "_row long, k int, chunk string")
    chunks = chunks.repartition("_row", "k").mapInArrow(pretokenise, "_row long, k int, chunk string, widths array<int>")
    joined = chunks.groupBy("_row").applyInArrow(join, "_row long, ids array<int>")
    longs = keyed.join(joined.select(F.col("_row").alias(row_name), "ids"), row_name).select(*[F.col(f"`{n}`") for n in names], "ids")
    return short.unionByName(longs)


def id_lists(ids: list[bytes]) -> pa.Array:
    """A list<int32> array of the packed ids."""
    offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary, column: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary): the raw bytes of all ids, joined. Null ids give null, no ids no bytes.

    An id that the vocabulary lacks fails the job; a column ``decoded`` is replaced.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    encoded = encoded.drop("decoded")
    names = encoded.columns

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(shared.value)
        for batch in batches:
            for part in common.slices([batch], column):
                lists = part.column(column)
                offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                null = lists.is_null().to_pylist()
                raw = [None if null[i] else code.decode(values[offsets[i] : offsets[i + 1]]) for i in range(len(lists))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*names, "decoded"])

    return encoded.mapInArrow(decode, common.plus(encoded, "decoded binary"))


def digests(encoded: DataFrame, vocabulary: Vocabulary, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents with ids, and the columns of ``keep``.

    Ids are decoded as decode_documents does, but only the digest of the bytes leaves the task.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(shared.value)
        for batch in batches:
            for part in common.slices([batch], "ids"):
                lists = part.column("ids")
                offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4")
                spans = list(zip(offsets, offsets[1:]))  # noqa: B905
                ids = [hashlib.sha256(values[x:y].tobytes()).hexdigest() for x, y in spans]
                raw = [hashlib.sha256(code.decode(values[x:y])).hexdigest() for x, y in spans]
                columns = [part.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(ids, pa.string()), pa.array(raw, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *(part.column(c) for c in keep)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep])

    chosen = encoded.select("doc_id", "ids", *[c for c in keep if c not in ("doc_id", "ids")])
    schema = common.plus(chosen.select("doc_id"), "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return chosen.mapInArrow(digest, T.StructType([*schema.fields, *(chosen.schema[c] for c in keep)]))
