"""Transcript files of many folders, listed and read by tasks: a batch source, a stream and a sink.

Spark's own file sources list every file on the driver first. Here the driver knows only the folders, one
line each in a manifest, or the names it is given; what lies in a folder is listed by the task that reads
it. A folder with very many files is shared by ``splits`` tasks, each of which takes the names of its share
of hash values.

A stream's offset is a point in time, whatever the number of files: a batch has the files whose
modification time lies after the last offset and not after the next one, which is ``settle`` seconds
ago. So a file has to be complete within that time, and one that is put in place with an older time
is not seen. Files are reached through ``pyarrow.fs``, which knows local, HDFS, S3 and GCS paths.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)

from .transcripts import decode_transcripts

NAME = "folder_files"
SCHEMA = "file_id string, file_name string, user_folder_id string, modified_at timestamp, content binary"
BYTES = 4 << 20  # of content that leave a task at a time


def _opened(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """File system, path in it, and what stands before a path in Spark's names of files."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), uri, "file:"
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/"), "file:"
    found, path = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return found, path, uri[: uri.rindex(path)] if path in uri else f"{scheme}://"


@dataclass
class Share(InputPartition):
    """The files of a folder whose names fall to one of ``of`` tasks and whose time is in a range."""

    folder: str
    number: int
    of: int
    after: int = -1
    until: int | None = None


def _files(share: Share) -> Iterator[pa.RecordBatch]:
    found, path, prefix = _opened(share.folder)
    rows, size = [], 0
    for info in found.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True)):
        name = info.base_name
        if info.type != pafs.FileType.File or name.startswith((".", "_")):
            continue
        if zlib.crc32(info.path.encode()) % share.of != share.number:
            continue
        when = info.mtime_ns or 0
        if when <= share.after or (share.until is not None and when > share.until):
            continue
        with found.open_input_stream(info.path, compression=None) as file:
            content = file.read()
        parent = info.path.rsplit("/", 2)[-2]
        rows.append((prefix + info.path, name, parent, datetime.fromtimestamp(when / 1e9, timezone.utc), content))
        size += len(content)
        if size >= BYTES:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.string(), pa.string(), pa.timestamp("us", "UTC"), pa.binary()]
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


class FolderReader(DataSourceReader):
    def __init__(self, folders: list[str], splits: int):
        self.folders, self.splits = folders, splits

    def partitions(self) -> list[InputPartition]:
        return [Share(f, i, self.splits) for f in self.folders for i in range(self.splits)] or [Share("", 0, 0)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return _files(partition) if partition.of else iter(())


class FolderStream(DataSourceStreamReader):
    def __init__(self, folders: list[str], splits: int, settle: float):
        self.folders, self.splits, self.settle = folders, splits, settle

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Share(f, i, self.splits, start["until"], end["until"]) for f in self.folders for i in range(self.splits)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return _files(partition)


@dataclass
class Written(WriterCommitMessage):
    files: int


class FolderWriter(DataSourceWriter):
    """A file per row, ``<root>/<user_folder_id>/<file_name>``; a task that is repeated writes the same files."""

    def __init__(self, root: str):
        self.root = root

    def write(self, iterator) -> Written:
        found, root, _ = _opened(self.root)
        made, n = set(), 0
        for row in iterator:
            folder = f"{root}/{row.user_folder_id}"
            if folder not in made:
                found.create_dir(folder)
                made.add(folder)
            with found.open_output_stream(f"{folder}/{row.file_name}", compression=None) as file:
                file.write(bytes(row.content))
            n += 1
        return Written(n)


class FolderFiles(DataSource):
    """Options: ``folders``, a JSON list, or ``manifest``, a file with a folder a line; ``splits``, ``settle``;
    for writing ``path``, the folder above the users' folders."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _folders(self) -> list[str]:
        if "folders" in self.options:
            return json.loads(self.options["folders"])
        found, path, _ = _opened(self.options["manifest"])
        with found.open_input_stream(path) as file:
            return [line for line in file.read().decode().splitlines() if line]

    def reader(self, schema) -> FolderReader:
        return FolderReader(self._folders(), int(self.options.get("splits", 1)))

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(self._folders(), int(self.options.get("splits", 1)), float(self.options.get("settle", 60)))

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options["path"])


def _options(folders: list[str] | str, splits: int) -> dict[str, str]:
    source = {"manifest": folders} if isinstance(folders, str) else {"folders": json.dumps(folders)}
    return {**source, "splits": str(splits)}


def scan_folders(spark: SparkSession, folders: list[str] | str, splits: int = 1) -> DataFrame:
    """The transcripts below the folders of a list or of a manifest file, with the columns of
    ``scan_transcripts``; files of zero bytes are there too."""
    spark.dataSource.register(FolderFiles)
    return decode_transcripts(spark.read.format(NAME).options(**_options(folders, splits)).load())


def stream_folders(spark: SparkSession, folders: list[str] | str, splits: int = 1, settle: float = 60) -> DataFrame:
    """The same as a stream of what is new."""
    spark.dataSource.register(FolderFiles)
    options = {**_options(folders, splits), "settle": str(settle)}
    return decode_transcripts(spark.readStream.format(NAME).options(**options).load())


def write_folders(df: DataFrame, path: str) -> None:
    """Write ``user_folder_id, file_name, content`` as files below ``path``, one for each row."""
    df.sparkSession.dataSource.register(FolderFiles)
    df.select("user_folder_id", "file_name", "content").write.format(NAME).mode("append").option("path", path).save()
