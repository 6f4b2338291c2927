"""Job logs, as one text or as numbered lines."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..skew import carried
from ..schemas import NO_LOG


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_job_log(spark: SparkSession, path: str, default: str = NO_LOG) -> DataFrame:
    """Each log file whole: ``log_file, text``. A missing log is one row with ``default``.

    This is for logs that fit in a cell; ``read_log_lines`` reads logs of any size. A log of
    zero bytes is passed over by Spark's readers.
    """
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.range(1).select(F.lit(path).alias("log_file"), F.lit(default).alias("text"))
    return files.select(F.col("_metadata.file_path").alias("log_file"), F.col("value").alias("text"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the logs, numbered from 1 per file: ``log_file, line_no, line``.

    A big file is read by many tasks. Each task knows where its block starts and numbers
    the lines inside it; what comes before the block is the sum over the earlier blocks.

    A line's place in its block is the distance of its row id from the block's least one: a task reads the
    lines of a block one after the other, also if it has several blocks or small files. The ids are taken
    by two reads of the same files, which Spark deals out alike; files that grow meanwhile are
    for ``streaming.number_stream``.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("log_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    )
    blocks = lines.groupBy("log_file", "block").agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("n")
    )
    before = carried(blocks, ["log_file"], "block", F.sum("n"), "lines_before", 0)
    return lines.join(before.drop("n"), ["log_file", "block"]).select(
        "log_file",
        (F.col("seq") - F.col("first_seq") + F.col("lines_before") + 1).alias("line_no"),
        "line",
    )
