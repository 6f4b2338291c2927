"""Batches that count as written only when their manifest is there.

A batch is several tables, and no file system moves several folders in one step. So every try writes
its tables to folders of its own, ``<root>/<table>/batch=<batch>/attempt=<attempt>``, and at last one manifest,
``<root>/_published/<batch>.json``, which names the try that counts. The manifest gets its name in one
step and never another content. Readers go by the manifests: what a failed try has left is not read,
and what is tried again is not there twice.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MANIFESTS = "_published"


def exists(spark: SparkSession, path: str) -> bool:
    fs, found = _file_system(spark, path)
    return fs.exists(found)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, found = _file_system(spark, path)
    return fs.exists(found) and fs.getFileStatus(found).isFile()


def _file_system(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder; nothing if there is no such folder."""
    fs, found = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(found)) if fs.exists(found) else []


def put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step, in the place of one of this name."""
    _renamed(spark, path, text, overwrite=True)


def put_new(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file in one step; an error if there is one of this name."""
    _renamed(spark, path, text, overwrite=False)


def _renamed(spark: SparkSession, path: str, text: str, overwrite: bool) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder, name = path.rsplit("/", 1)
    fs, draft = _file_system(spark, f"{folder}/_{name}.{uuid.uuid4().hex}")
    out = fs.create(draft)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, int(overwrite))
    if overwrite:
        options[0] = rename.OVERWRITE
    try:
        context.rename(draft, jvm.org.apache.hadoop.fs.Path(path), options)
    except Exception as error:
        fs.delete(draft, False)
        if exists(spark, path):
            raise FileExistsError(path) from error
        raise


def manifest_path(root: str, batch: str) -> str:
    return f"{root}/{MANIFESTS}/{quote(batch, safe='')}.json"


def is_published(spark: SparkSession, root: str, batch: str) -> bool:
    return exists(spark, manifest_path(root, batch))


def attempts(spark: SparkSession, root: str) -> dict[str, str]:
    """The try that counts of every published batch; a line per batch passes the driver."""
    folder = f"{root}/{MANIFESTS}"
    if not any(n.endswith(".json") and not n.startswith("_") for n in names(spark, folder)):
        return {}
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("batch", "attempt")])
    return {r.batch: r.attempt for r in spark.read.schema(schema).json(f"{folder}/*.json").collect()}


@dataclass
class Attempt:
    """One try at writing a batch below ``root``."""

    spark: SparkSession
    root: str
    batch: str
    name: str = ""

    def __post_init__(self):
        self.name = self.name or f"a{uuid.uuid4().hex}"

    def folder(self, table: str) -> str:
        return _folder(self.root, table, self.batch, self.name)

    def publish(self, **facts) -> None:
        """The batch is what this try has written; an error if another one was first."""
        manifest = {"batch": self.batch, "attempt": self.name, **facts}
        put_new(self.spark, manifest_path(self.root, self.batch), json.dumps(manifest, sort_keys=True))


def _folder(root: str, table: str, batch: str, attempt: str) -> str:
    return f"{root}/{table}/batch={quote(batch, safe='')}/attempt={attempt}"


def published_folders(spark: SparkSession, root: str, table: str, batch: str | None = None) -> list[str]:
    """Folders of a table's published batches, or of one of them."""
    found = attempts(spark, root)
    chosen = found if batch is None else {b: a for b, a in found.items() if b == batch}
    folders = [_folder(root, table, b, a) for b, a in sorted(chosen.items())]
    return [f for f in folders if exists(spark, f)]


def read_published(
    spark: SparkSession, root: str, table: str, schema: T.StructType, batch: str | None = None, source: str = "parquet", **options: str
) -> DataFrame:
    """The rows of a table's published batches; ``schema`` has its columns."""
    folders = published_folders(spark, root, table, batch)
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read.format(source).schema(schema).options(**options)
    return reader.option("basePath", f"{root}/{table}").load(folders).select(schema.fieldNames())
