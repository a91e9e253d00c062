"""WARC archives as seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common

# Fixed values of the seekable format: a skippable frame holds the seek table, its footer ends the file.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FOOTER = struct.Struct("<IBI")

INDEX = "archive string, record_id string, page_id long, frame int, frame_offset long, record_offset long, record_length long"
RECORDS = "page_id long, record_id string, record_type string, payload_digest string, payload_bytes long, payload binary, refers_to_record string, refers_to long"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(record_id: str, kind: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~-._"))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Headers (lower case), the payload, and its length as the HTTP head gives it."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    length = next(int(x[16:]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    return fields | {"payload": payload, "payload_bytes": length}


class BundleWriter:
    """Independent frames of about ``frame_bytes`` of records each, then the seek table."""

    def __init__(self, sink, frame_bytes: int):
        self.sink, self.frame_bytes, self.compressor = sink, frame_bytes, zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.buffer, self.filled, self.written = [], 0, 0

    def add(self, record: bytes) -> tuple[int, int, int]:
        """(frame, its offset in the file, the record's offset in the frame)."""
        at = (len(self.frames), self.written, self.filled)
        self.buffer.append(record)
        self.filled += len(record)
        if self.filled >= self.frame_bytes:
            self.flush()
        return at

    def flush(self) -> None:
        if self.buffer:
            frame = self.compressor.compress(b"".join(self.buffer))
            self.sink.write(frame)
            self.frames.append((len(frame), self.filled))
            self.buffer, self.filled, self.written = [], 0, self.written + len(frame)

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + FOOTER.pack(len(self.frames), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.sink.close()


def seek_table(source, size: int) -> list[tuple[int, int]]:
    """(offset, compressed size) of each frame, from the footer."""
    source.seek(size - FOOTER.size)
    n, flags, magic = FOOTER.unpack(source.read(FOOTER.size))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    source.seek(size - FOOTER.size - 8 * n)
    sizes = [struct.unpack("<II", source.read(8))[0] for _ in range(n)]
    offsets = [0]
    for s in sizes:
        offsets.append(offsets[-1] + s)
    return list(zip(offsets, sizes))  # noqa: B905


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the folder's path in it, for the names that Spark's file systems go by.

    s3a and s3n are s3, dbfs is its mount; local folders, s3, gs, abfs(s) and hdfs are known as they are.
    """
    scheme, _, rest = folder.partition(":")
    if scheme in ("s3a", "s3n"):
        folder = f"s3:{rest}"
    elif scheme == "dbfs":
        folder = "/dbfs/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def mark_revisits(pages: DataFrame, min_bytes: int = 0, max_broadcast_rows: int = 200_000, salts: int = 32) -> DataFrame:
    """(page_id, url, payload, record_type, refers_to): payload is binary, refers_to the page_id of the response.

    Of equal payloads of at least ``min_bytes`` bytes the smallest page_id is the response; rows that tie with it are
    responses too. Where no equal payload has an id, all are responses. Other columns are left out, whatever their names.

    Payloads meet only the digests that stand twice or more. These go to all tasks if they are few (counted), so that
    payloads don't move; else each stands in ``salts`` parts, so that a page that very many rows have is spread.
    """
    named = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    named = named.withColumn("_sha", F.unhex(F.sha1("payload")))
    first = named.where(F.octet_length("payload") >= min_bytes).groupBy(F.col("_sha").alias("_k")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    again = common.materialise(first.where("_n > 1").select("_k", "_first"))
    if again.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        joined = named.join(F.broadcast(again), F.col("_sha") == F.col("_k"), "left")
    else:
        spread = again.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = named.withColumn("_t", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(spread, (F.col("_sha") == F.col("_k")) & (F.col("_t") == F.col("_s")), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"))


#: The first 64 bits of record ids: a custom UUID (version 8) whose last bits hold a page_id, or none.
NAMED, NAMELESS = 0x70616765_0000_8000, 0x70616765_0001_8000


def record_name(page_id: int | None) -> str:
    """The record id of a page; all pages without an id share one."""
    high = NAMELESS if page_id is None else NAMED
    low = (page_id or 0) & (1 << 64) - 1
    # the two variant bits of a UUID go between the page_id's first two bits and the rest
    return f"<urn:uuid:{uuid.UUID(int=(high | low >> 62) << 64 | 2 << 62 | low & (1 << 62) - 1)}>"


def page_of(record_id: str) -> int | None:
    """The page_id in a record id of ``record_name``."""
    number = uuid.UUID(record_id[len("<urn:uuid:") : -1]).int
    if number >> 66 << 2 == NAMELESS:
        return None
    low = (number >> 64 & 3) << 62 | number & (1 << 62) - 1
    return low - (1 << 64) if low >> 63 else low


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, frame_bytes: int = 256 << 10, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) to archives in ``folder`` and return the index.

    Each task writes its own archives, new ones after ``archive_bytes`` of records, under names that no other attempt
    uses; the index names only those of attempts that succeeded. The index (INDEX) maps every record to its archive,
    frame, frame offset and offset in the frame; it is stored in ``folder`` too, so archives are written once.

    Null html is an empty payload, a null url leaves its header out, null ids are written as any other; repeated rows
    give records of the same id; other columns are not archived; an empty table gives an empty index.
    """
    spark = pages.sparkSession
    folder = folder or common.scratch_dir(spark)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        bundle, name, room, rows = None, "", 0, []
        for batch in batches:
            for part in common.slices([batch], "payload"):
                for page, url, payload, kind, refers in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if bundle is None:
                        name, room = f"part-{uuid.uuid4().hex}.warc.zst", archive_bytes
                        fs.create_dir(root, recursive=True)
                        bundle = BundleWriter(fs.open_output_stream(f"{root}/{name}", compression=None), frame_bytes)
                    record = warc_record(record_name(page), kind, url, payload, digest32(payload), record_name(refers) if kind == "revisit" else None)
                    rows.append((name, record_name(page), page, *bundle.add(record), len(record)))
                    room -= len(record)
                    if room <= 0:
                        bundle.close()
                        bundle = None
            yield _index_batch(rows)
            rows = []
        if bundle is not None:
            bundle.close()

    index = mark_revisits(pages, min_bytes).mapInArrow(write, INDEX)
    path = f"{folder}/index"
    index.write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) if rows else [()] * 7  # noqa: B905
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])  # noqa: B905


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)  # noqa: B905
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])


def read_warc(index: DataFrame, folder: str) -> DataFrame:
    """Read the records that ``index`` names: columns of RECORDS; refers_to is the page_id in the record id referred to.

    An archive's footer gives its frames; only frames that hold wanted records are read and decompressed. Payloads of
    responses are checked against their digests; a revisit's payload is null, as its response has it. Index rows
    meet by archive and frame range, so a task holds one frame at a time.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        archive, frame, source, table, raw = None, -1, None, [], b""
        decompressor = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, held = [], 0
            for a in range(0, batch.num_rows, 256):
                for x in batch.slice(a, 256).to_pylist():
                    if x["archive"] != archive:
                        if source is not None:
                            source.close()
                        archive, frame = x["archive"], -1
                        source = fs.open_input_file(f"{root}/{archive}")
                        table = seek_table(source, source.size())
                    if x["frame"] != frame:
                        frame = x["frame"]
                        offset, size = table[frame]
                        if offset != x["frame_offset"]:
                            raise ValueError("index and seek table disagree")
                        source.seek(offset)
                        raw = decompressor.decompress(source.read(size))
                    got = parse_record(raw[x["record_offset"] : x["record_offset"] + x["record_length"]])
                    digest, kind = got["warc-payload-digest"].removeprefix("sha1:"), got["warc-type"]
                    if got["warc-record-id"] != x["record_id"] or kind == "response" and (digest32(got["payload"]) != digest or len(got["payload"]) != got["payload_bytes"]):
                        raise ValueError("damaged record")
                    refers = got.get("warc-refers-to")
                    payload = got["payload"] if kind == "response" else None
                    rows.append((x["page_id"], x["record_id"], kind, digest, got["payload_bytes"], payload, refers, refers and page_of(refers)))
                    held += len(payload or b"")
                    if held >= 1 << 22:
                        yield _record_batch(rows)
                        rows, held = [], 0
            yield _record_batch(rows)
        if source is not None:
            source.close()

    dealt = index.repartition("archive", F.floor(F.col("frame") / 64)).sortWithinPartitions("archive", "frame", "record_offset")
    return dealt.mapInArrow(read, RECORDS)
