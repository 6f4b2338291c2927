"""Summaries and ledger rows, batch by batch."""

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import batch_id
from ..operators.outcome import ledger_row
from ..plans.summarise import outcomes
from .steps import BatchSteps, StepListener


KEYS = ["run_id", "batch_id"]


def _put(df: DataFrame, path: str, run: str, number: int) -> None:
    """Write one batch's partition; a repeated batch takes the place of its first try.

    Batch numbers start again with a new checkpoint, so they count within the run.
    """
    (
        df.withColumns({"run_id": F.lit(run), "batch_id": F.lit(number).cast("long")})
        .write.mode("overwrite")
        .partitionBy(*KEYS)
        .option("partitionOverwriteMode", "dynamic")
        .parquet(path)
    )


def ledger_stream(
    stream: DataFrame,
    enrich: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    moved_at: Column,
    batch_time: Column | None = None,
    steps: str | None = None,
) -> StreamingQuery:
    """Run ``enrich`` on what is new, then write replies, summaries and ledger of the batch.

    The tables lie below ``out``, partitioned by run and batch. The run is the query's id, which
    lives in the checkpoint: whoever starts again without it begins a new run and leaves the rows
    of earlier ones as they are. The archive batch is named by ``batch_time``, by default the time
    at which the batch was tried. Start it on a stream of transcripts; it stops when everything
    available is done. ``steps`` names the folder of a table (``read_steps``) that gets the times and
    rows of each batch's steps.
    """
    session = stream.sparkSession

    def process(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        started = F.lit(datetime.now(timezone.utc)) if batch_time is None else batch_time
        enriched = outcomes(enrich(batch)).drop("v").withColumn("archive_batch_id", batch_id(started))
        times = BatchSteps(run, number)
        with times.step("replies", enriched) as rows:
            _put(rows, f"{out}/replies", run, number)
        # The schema is given, as an empty batch writes no file to take it from.
        keys = [T.StructField("run_id", T.StringType()), T.StructField("batch_id", T.LongType())]
        stored = spark.read.schema(T.StructType([*enriched.schema.fields, *keys])).parquet(f"{out}/replies")
        done = stored.where((F.col("run_id") == run) & (F.col("batch_id") == number)).drop(*KEYS)
        accepted = done.where(F.col("status") == "success").select(
            "file_id", "user_folder_id", "json_content", "output_filename", "archive_batch_id"
        )
        with times.step("summaries", accepted) as rows:
            _put(rows, f"{out}/summaries", run, number)
        with times.step("ledger", ledger_row(done, moved_at)) as rows:
            _put(rows, f"{out}/ledger", run, number)
        if steps:
            times.save(spark, steps, "own")

    listener = StepListener(session, steps) if steps else None
    if listener:
        session.streams.addListener(listener)
    query = (
        stream.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        if listener:
            listener.finish(query)
    return query
