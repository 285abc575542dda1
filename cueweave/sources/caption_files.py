"""Caption files as a data source of its own, in batch and as a stream.

Spark's file sources pass over files of no bytes, but an empty upload is a recording without
a transcript and must be seen.  This source lists files itself, with the file systems that
Arrow knows (local, HDFS, S3, GCS): every file with a caption suffix gives a row, an empty one
an empty text, bad bytes are replaced, and batch and stream give the same rows.

    spark.dataSource.register(CaptionFiles)
    spark.read.format("caption_files").load(folder)
    spark.readStream.format("caption_files").load(folder)
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from cueweave.sources.subtitles import TRANSCRIPT_SUFFIXES

BYTES_PER_TASK, FILES_PER_TASK = 32 << 20, 1000
#: A stream leaves files alone that were changed so short a time ago.
SETTLE_SECONDS = 1.0
_KIND = pa.schema([("path", pa.string()), ("length", pa.int64()), ("text", pa.string())])


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def _listed(folder: str) -> list:
    """The caption files under a folder, by path."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if urlparse(folder).scheme else (fs.LocalFileSystem(), folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    named = lambda f: f.is_file and not f.base_name.startswith(("_", ".")) and f".{f.extension}".lower() in TRANSCRIPT_SUFFIXES
    return sorted((f for f in found if named(f)), key=lambda f: f.path)


def _dealt(found: list) -> list[Files]:
    """Files in tasks of bounded bytes and number."""
    tasks, size = [], 0
    for f in found:
        if not tasks or size + f.size > BYTES_PER_TASK or len(tasks[-1]) >= FILES_PER_TASK:
            tasks, size = [*tasks, []], 0
        tasks[-1].append(f.path)
        size += f.size
    return [Files(paths) for paths in tasks] or [Files([])]


def _rows(folder: str, paths: list[str]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    parts = urlparse(folder)
    system = fs.FileSystem.from_uri(folder)[0] if parts.scheme else fs.LocalFileSystem()
    for path in paths:
        with system.open_input_stream(path) as stream:
            data = stream.read()
        yield pa.RecordBatch.from_pylist([{"path": path, "length": len(data), "text": data.decode("utf-8", "replace")}], _KIND)


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Files]:
        return _dealt(_listed(self.folder))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _rows(self.folder, partition.paths)


class _StreamReader(DataSourceStreamReader):
    """Offsets are times of change in nanoseconds: a batch has the files changed after its start, up to its end."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"changed": 0}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(SETTLE_SECONDS * 1e9)
        return {"changed": max((f.mtime_ns for f in _listed(self.folder) if f.mtime_ns <= until), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _dealt([f for f in _listed(self.folder) if start["changed"] < f.mtime_ns <= end["changed"]])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _rows(self.folder, partition.paths)


class CaptionFiles(DataSource):
    """(path, length, text) of caption files; the folder is the path that is loaded."""

    @classmethod
    def name(cls) -> str:
        return "caption_files"

    def schema(self) -> str:
        return "path string, length long, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])


def caption_files(spark: SparkSession, folder: str, *, stream: bool = False) -> DataFrame:
    """(rec_id, path, text) of the caption files in a folder, empty ones too; rec_id is a hash of the path."""
    spark.dataSource.register(CaptionFiles)
    files = (spark.readStream if stream else spark.read).format("caption_files").load(folder)
    return files.select(F.xxhash64("path").alias("rec_id"), "path", "text")
