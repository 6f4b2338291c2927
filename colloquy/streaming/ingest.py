"""New files as a stream."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.published import is_file
from ..sources.summaries import reply_files, unwrapped
from ..sources.transcripts import laid_out

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def incremental_ingest(
    spark: SparkSession,
    path: str,
    source: str = "binaryFile",
    schema: T.StructType = BINARY_FILE,
    **options: str,
) -> DataFrame:
    """Files below ``path`` that the query's checkpoint has not seen, as a stream.

    Where ``path`` is itself a file, that one: Spark streams folders only.
    """
    if is_file(spark, path):
        path, name = path.rsplit("/", 1)
        options = {**options, "pathGlobFilter": re.sub(r"([][{}*?\\])", r"\\\1", name)}
    return spark.readStream.format(source).schema(schema).options(**options).load(path)


def archive_on_commit(
    spark: SparkSession,
    path: str,
    archive_dir: str,
    source: str = "binaryFile",
    schema: T.StructType = BINARY_FILE,
    **options: str,
) -> DataFrame:
    """The same stream, whose finished files move to ``archive_dir``.

    The files of a run's last batch move in the next run. What is done is therefore known
    from the checkpoint, not from the folder. ``archive_dir`` must not lie below ``path``.
    """
    return incremental_ingest(
        spark, path, source, schema, cleanSource="archive", sourceArchiveDir=archive_dir, **options
    )


def run_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append everything that is there to a Parquet table and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def land_transcripts(spark: SparkSession, path: str, out: str, checkpoint: str, **options: str) -> DataFrame:
    """Many small transcript files become rows of one table; returns the table.

    Each run takes in the files that are new. Listing and opening files is done once for each;
    later jobs read the table, whose files hold many transcripts, by the same ``file_id``.
    """
    options = {"recursiveFileLookup": "true", **options}
    run_available(laid_out(incremental_ingest(spark, path, **options)), out, checkpoint)
    return spark.read.parquet(out)


def land_summaries(spark: SparkSession, path: str, out: str, checkpoint: str, **options: str) -> DataFrame:
    """Many small reply files become rows of one table, as ``read_summaries`` gives them: ``file_id, raw, v``.

    Each run takes in the files that are new.
    """
    text = T.StructType([T.StructField("value", T.StringType())])
    options = {"wholetext": "true", "recursiveFileLookup": "true", **options}
    run_available(reply_files(incremental_ingest(spark, path, "text", text, **options)), out, checkpoint)
    return unwrapped(spark.read.parquet(out))
