"""Stored replies and summaries."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json import summary_unwrap


def reply_files(files: DataFrame) -> DataFrame:
    """Whole files of the ``text`` source, from a table or a stream, as ``file_id, raw``.

    The id is the file's plain path, written as ``scan_transcripts`` writes it.
    """
    return files.select(
        F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("file_id"),
        F.col("value").alias("raw"),
    )


def unwrapped(replies: DataFrame) -> DataFrame:
    """Adds ``v``, what each reply says."""
    return replies.withColumn("v", summary_unwrap(F.col("raw")))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Stored replies, one per file: ``file_id, raw, v``.

    Every file is listed and opened by each query; ``streaming.land_summaries`` does that once.
    """
    return unwrapped(reply_files(spark.read.text(path, wholetext=True, recursiveFileLookup=True)))


def write_summaries(df: DataFrame, path: str) -> None:
    """Append summaries, one folder per user; names may repeat and nothing is overwritten.

    The rebalance hint splits the rows of a large user over several files and packs those
    of small users together.
    """
    (
        df.hint("rebalance", "user_folder_id")
        .write.mode("append")
        .partitionBy("user_folder_id")
        .parquet(path)
    )
