"""Job logs to runs, step times and report texts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.logs import (
    daily_durations,
    log_runs,
    parse_log,
    run_report_lines,
    scheduler_outcomes,
    step_duration_stats,
    step_pairs,
)
from ..sources.logfiles import read_log_lines
from ..sources.published import Attempt, read_published

DURATIONS = T.StructType(
    [
        T.StructField("day", T.DateType()),
        T.StructField("step", T.StringType()),
        T.StructField("calls", T.LongType()),
        T.StructField("total", T.DoubleType()),
        T.StructField("longest", T.DoubleType()),
        T.StructField("sketch", T.BinaryType()),
    ]
)


def analyse_logs(spark: SparkSession, path: str, out: str) -> dict[str, DataFrame]:
    """All tables about the logs below ``path``.

    The typed lines are written to ``out`` first: every table reads them there, and the
    log text is parsed once.
    """
    lines = read_log_lines(spark, path)
    parse_log(lines).write.mode("overwrite").parquet(f"{out}/lines")
    logs = spark.read.parquet(f"{out}/lines")
    return {
        "runs": log_runs(logs),
        "pairs": step_pairs(logs),
        "durations": step_duration_stats(logs),
        "scheduler": scheduler_outcomes(logs),
        "reports": run_report_lines(logs.select("log_file", "line_no", "line")),
    }


def store_durations(logs: DataFrame, out: str, batch: str) -> None:
    """Add the daily durations of a batch of typed lines to the table below ``out``, once per batch."""
    attempt = Attempt(logs.sparkSession, out, batch)
    daily_durations(logs).select(DURATIONS.fieldNames()).write.parquet(attempt.folder("durations"))
    attempt.publish()


def stored_durations(spark: SparkSession, out: str) -> DataFrame:
    """The daily durations of all batches; a day may have rows of several."""
    return read_published(spark, out, "durations", DURATIONS)
