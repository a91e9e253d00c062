"""Versions of a stored table: immutable folders of data, and one small manifest a version that names them.

A writer puts its data into new folders first and commits by moving a finished manifest to the next number. Readers take
the manifest with the greatest number, so that they never see half a write; what a failed write leaves is named by no
manifest and goes with ``vacuum``. Of two writers that started from one version the second gets ``Conflict``. The move
must not replace a file that exists: so on HDFS and local folders; on object stores let one writer at a time commit.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since this one read its version; read again and repeat."""


class Versions:
    """Manifests (JSON objects) in ``folder/versions``, data in ``folder/data``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str) -> tuple[Any, Any]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, name: str) -> list[str]:
        fs, path = self._path(name)
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def numbers(self) -> list[int]:
        """Numbers of the committed versions, the oldest first."""
        return sorted(int(n.removesuffix(".json")) for n in self._names("versions") if n.endswith(".json") and not n.startswith((".", "_")))

    def manifest(self, number: int | None = None) -> tuple[int, dict[str, Any]]:
        """(number, manifest) of a version, of the latest where none is named; (0, {}) before the first."""
        if number is None:
            number = max(self.numbers(), default=0)
        if not number:
            return 0, {}
        fs, path = self._path(f"versions/{number:012d}.json")
        stream = fs.open(path)
        try:
            return number, json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, after: int, manifest: dict[str, Any]) -> int:
        """The number of the new version; ``after`` is the version that the writer started from."""
        fs, draft = self._path(f"versions/_{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        finally:
            stream.close()
        _, final = self._path(f"versions/{after + 1:012d}.json")
        # local folders replace a file that exists, so it is asked for first
        if max(self.numbers(), default=0) != after or fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {after + 1} of {self.folder} was committed by another writer")
        return after + 1

    def new_data(self) -> str:
        """The name of a new folder below ``data``."""
        return uuid.uuid4().hex

    def data(self, name: str) -> str:
        return f"{self.folder}/data/{name}"

    def sizes(self, name: str) -> tuple[dict[str, int], dict[str, int]]:
        """Bytes, and files, of each bucket in a folder with a folder ``bucket=b`` for each."""
        fs, _ = self._path(name)
        told = {b.removeprefix("bucket="): fs.getContentSummary(self._path(f"{name}/{b}")[1]) for b in self._names(name) if b.startswith("bucket=")}
        return {b: c.getLength() for b, c in told.items()}, {b: c.getFileCount() for b, c in told.items()}

    def bytes_of(self, stored: DataFrame) -> int:
        """Bytes of the files that ``stored``, a table as it was read, has."""
        folders = {f.rsplit("/", 1)[0] for f in stored.inputFiles()}
        fs = [self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f) for f in sorted(folders)]
        return sum(p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for p in fs)

    def vacuum(self, used: Any, keep: int = 1) -> list[str]:
        """Deletes all but the newest ``keep`` versions, and data folders that ``used(manifest)`` of none of them names.

        Not to be run beside a writer, whose folders no manifest names yet. Returns the names of deleted data folders.
        """
        numbers = self.numbers()
        kept = {n for number in numbers[-keep:] for n in used(self.manifest(number)[1])}
        for number in numbers[:-keep]:
            fs, path = self._path(f"versions/{number:012d}.json")
            fs.delete(path, False)
        gone = [n for n in self._names("data") if n not in kept]
        for name in gone:
            fs, path = self._path(f"data/{name}")
            fs.delete(path, True)
        return gone
