"""Transcript bodies: one row per file."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_transcripts(files: DataFrame, content: str = "content") -> DataFrame:
    """Bytes to ``text``; bytes that are not UTF-8 give a null text and a false flag."""
    body = F.col(content).cast("string")
    return (
        files.withColumn("is_valid_utf8", F.is_valid_utf8(body))
        .withColumn("text", F.when(F.col("is_valid_utf8"), body))
        .drop(content)
    )


def scan_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Whole transcript files below ``path``, laid out as ``<user folder>/<file name>``.

    Spark's readers pass over files of zero bytes; ``attach_texts`` keeps those that are listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return laid_out(files)


def laid_out(files: DataFrame) -> DataFrame:
    """Files of the ``binaryFile`` source, from a table or a stream, as transcripts."""
    parts = F.split("path", "/")
    return decode_transcripts(
        files.select(
            F.col("path").alias("file_id"),
            F.element_at(parts, -1).alias("file_name"),
            F.element_at(parts, -2).alias("user_folder_id"),
            F.col("modificationTime").alias("modified_at"),
            "content",
        )
    )


def attach_texts(listed: DataFrame, bodies: DataFrame) -> DataFrame:
    """Every listed file with its text; null where there is no body for it.

    The bodies are the side that Spark need not move if the list is short; the files without
    one are found by their ids alone.
    """
    texts = bodies.select("file_id", "text")
    met = texts.join(listed, "file_id")
    lost = listed.join(texts.select("file_id"), "file_id", "left_anti")
    columns = [*listed.columns, "text"]
    return met.select(columns).unionByName(lost.withColumn("text", F.lit(None).cast("string")).select(columns))


def write_transcript_text(df: DataFrame, path: str, per_file: bool = False) -> None:
    """Store transcripts: Parquet by default, one text folder per file only when asked.

    ``per_file`` is the small-scale export: it makes as many folders as there are files.
    """
    if per_file:
        df.select("file_id", "text").write.mode("append").partitionBy("file_id").text(path)
    else:
        df.select("file_id", "text").write.mode("append").parquet(path)
