"""Files of capture runs as rows: a Python data source that lists run folders on the executors, and hashes taken there in pieces.

``read_run_hashes`` sees every file below ``root/run_id=<id>/``: hidden, empty and very large ones too, which Spark's own readers pass over or
can't hold. The driver plans a number of shares and lists nothing. A task lists the run folders' names and walks those of its share; the
listing is then dealt anew by file, so the files of one run are hashed by many tasks, each read in pieces of ``PIECE`` bytes.

Defined cases: symbolic links and line breaks in names are errors, since a manifest can't name such files safely; files that vanish between
listing and hashing are errors; what the file system's own writers leave (``_SUCCESS`` and checksums of a file beside them) is no content; a
root without run folders gives no row; files outside run folders are not read.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PIECE = 1 << 20
SHARES = 64
ROWS = 4096
PREFIX = "run_id="
LISTED = "run_id string, path string, size long, location string"
HASHED = "run_id string, path string, size long, sha256 string"


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    store, path = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else os.path.abspath(root))
    return store, path.rstrip("/")


def plain_name(path: str) -> str:
    """``path`` itself, if a manifest line can name it."""
    if "\n" in path or "\r" in path:
        raise ValueError(f"line breaks in a file name: {path!r}")
    return path


def _left_by_writers(name: str, beside: set[str]) -> bool:
    return name == "_SUCCESS" or (name.startswith(".") and name.endswith(".crc") and (name[1:-4] in beside or name[1:-4] == "_SUCCESS"))


def _local_files(top: str) -> Iterator[tuple[str, int]]:
    folders = [top]
    while folders:
        with os.scandir(folders.pop()) as entries:
            found = sorted(entries, key=lambda e: e.name)
        beside = {e.name for e in found}
        for entry in found:
            if entry.is_symlink():
                raise ValueError(f"symbolic links can't be checked: {entry.path!r}")
            if entry.is_dir():
                folders.append(entry.path)
            elif entry.is_file() and not _left_by_writers(entry.name, beside):
                yield entry.path, entry.stat().st_size


def _stored_files(store: fs.FileSystem, top: str) -> Iterator[tuple[str, int]]:
    folders = [top]
    while folders:
        found = store.get_file_info(fs.FileSelector(folders.pop()))
        beside = {f.base_name for f in found}
        for info in found:
            if info.type == fs.FileType.Directory:
                folders.append(info.path)
            elif info.type == fs.FileType.File and not _left_by_writers(info.base_name, beside):
                yield info.path, info.size


def run_folders(store: fs.FileSystem, root: str) -> list[str]:
    """Paths of the folders ``run_id=...`` right below ``root``."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(root) as entries:
            found = [e for e in entries if e.name.startswith(PREFIX)]
        linked = [e.path for e in found if e.is_symlink()]
        if linked:
            raise ValueError(f"symbolic links can't be checked: {linked[0]!r}")
        return sorted(e.path for e in found if e.is_dir())
    return sorted(i.path for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and i.base_name.startswith(PREFIX))


class Share(InputPartition):
    """The run folders whose hashed name falls on ``value[0]`` of ``value[1]``."""


class RunFilesReader(DataSourceReader):
    def __init__(self, root: str, shares: int):
        self.root, self.shares = root, shares

    def partitions(self) -> list[Share]:
        return [Share((i, self.shares)) for i in range(self.shares)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        number, shares = partition.value
        store, root = opened(self.root)
        rows: list[tuple[str, str, int, str]] = []
        for folder in run_folders(store, root):
            name = folder.rsplit("/", 1)[-1]
            if zlib.crc32(name.encode()) % shares != number:
                continue
            run = plain_name(unquote(name[len(PREFIX):]))
            for path, size in (_local_files(folder) if isinstance(store, fs.LocalFileSystem) else _stored_files(store, folder)):
                rows.append((run, plain_name(path[len(folder) + 1:]), size, path))
                if len(rows) == ROWS:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, str, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows)], ["run_id", "path", "size", "location"])


class RunFiles(DataSource):
    """``spark.read.format("run_files").option("root", ...).load()``: the files of all runs, without their content."""

    @classmethod
    def name(cls) -> str:
        return "run_files"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        if not self.options.get("root"):
            raise ValueError("option root is missing")
        return RunFilesReader(self.options["root"], max(1, int(self.options.get("shares", SHARES))))


def list_run_files(spark: SparkSession, root: str, shares: int = SHARES) -> DataFrame:
    """``run_id, path, size, location`` of every file below the run folders of ``root``."""
    spark.dataSource.register(RunFiles)
    return spark.read.format("run_files").option("root", root).option("shares", shares).load()


def digest_of(store: fs.FileSystem, path: str) -> str:
    digest = hashlib.sha256()
    with store.open_input_stream(path, buffer_size=0) as stream:
        while piece := stream.read(PIECE):
            digest.update(piece)
    return digest.hexdigest()


def _hasher(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(root)
        for batch in batches:
            hashes = [digest_of(store, path) for path in batch.column("location").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("run_id", "path", "size")), pa.array(hashes, pa.string())],
                                             ["run_id", "path", "size", "sha256"])
    return run


def read_run_hashes(spark: SparkSession, root: str, shares: int = SHARES) -> DataFrame:
    """``run_id, path, size, sha256`` of every file below the run folders of ``root``; only names and sizes are shuffled."""
    dealt = list_run_files(spark, root, shares).repartition(shares, F.xxhash64("run_id", "path"))
    return dealt.mapInArrow(_hasher(root), HASHED)


def write_run_files(rows: DataFrame, root: str) -> DataFrame:
    """Writes ``run_id, path, content`` to ``root/run_id=<id>/<path>`` in the tasks; returns the paths, and runs when they are read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(root)
        for batch in batches:
            for run_id, path, content in zip(*(batch.column(c).to_pylist() for c in ("run_id", "path", "content"))):
                target = f"{top}/{PREFIX}{run_id.replace('%', '%25').replace('/', '%2F')}/{path}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(target) as stream:
                    stream.write(content)
            yield batch.select(["run_id", "path"])
    return rows.select("run_id", "path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "run_id string, path string")
