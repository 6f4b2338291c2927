"""Transcripts to summaries and ledger rows."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.json import build_messages
from ..functions.text import empty_transcript_guard
from ..operators.crosscheck import unprocessed
from ..operators.enrich import enrich_with_retry
from ..operators.outcome import accept_replies, batch_status_counts, classify_outcome, ledger_row
from ..schemas import ARCHIVE_FAILED, DOWNLOAD_FAILED, LEDGER, SUMMARY_FAILED, UPLOAD_FAILED
from ..sources.inventory import list_transcripts
from ..sources.ledger import CSV, append_ledger
from ..sources.published import Attempt, exists, is_published, names, read_published
from ..sources.summaries import write_summaries
from ..sources.transcripts import attach_texts

KEEP = ("file_name", "user_folder_id")


def requests(transcripts: DataFrame, system: str) -> DataFrame:
    """Adds ``request``: the chat messages as JSON, null for an empty transcript."""
    messages = F.to_json(build_messages(system, F.col("text")))
    return transcripts.withColumn(
        "request", F.when(~empty_transcript_guard(F.col("text")), messages)
    )


def outcomes(replies: DataFrame) -> DataFrame:
    """Accepted summary, status and error of each reply.

    Columns ``upload_error`` and ``archive_error``, where there are any, say what became of an
    accepted summary later; null is no error.
    """

    def later(name: str, message: Column) -> list[tuple[Column, Column]]:
        return [(F.col(name).isNotNull(), message)] if name in replies.columns else []

    place = F.concat(F.lit(f"{ARCHIVE_FAILED} "), F.col("file_name"), F.lit(" ("), F.col("file_id"), F.lit("): "))
    return classify_outcome(
        accept_replies(replies),
        [
            # An empty transcript is reported twice over, as the ledger has always had it.
            (F.col("attempts") == 0, F.lit(f"{DOWNLOAD_FAILED}: {DOWNLOAD_FAILED}")),
            (F.col("output_filename").isNull(), F.lit(SUMMARY_FAILED)),
            *later("upload_error", F.concat(F.lit(f"{UPLOAD_FAILED}: "), "upload_error")),
            *later("archive_error", F.concat(place, F.col("archive_error"))),
        ],
    )


def to_summarise(
    inventory: DataFrame, folders: DataFrame, ledger: DataFrame | None, bodies: DataFrame
) -> DataFrame:
    """List, skip, read: documents of the folders that the ledger does not show as done, with texts.

    Folders and ledger are met with ids and names only; the bodies are read for what is left.
    """
    listed = list_transcripts(inventory, folders).select(
        F.col("id").alias("file_id"), F.col("name").alias("file_name"), F.col("parent_id").alias("user_folder_id")
    )
    return attach_texts(listed if ledger is None else unprocessed(listed, ledger), bodies)


SUMMARIES = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("file_id", "user_folder_id", "json_content", "output_filename", "archive_batch_id")
    ]
)


def stage_requests(spark: SparkSession, todo: Callable[[], DataFrame], path: str, slices: int) -> tuple[str, int]:
    """The table of a batch's requests that are open, partitioned into ``slices``; its folder and number.

    The requests are worked out and written once, whatever the number of slices: later starts read
    them from here. Is the batch started again with another number of slices, the requests without a
    stored reply are dealt out anew; those with one are left as they are.
    """
    done = [n.split("-") for n in names(spark, f"{path}/requests") if exists(spark, f"{path}/requests/{n}/_SUCCESS")]
    runs = sorted((int(run.removeprefix("run=")), int(k)) for run, k in done)
    if runs and runs[-1][1] == slices:
        return f"{path}/requests/run={runs[-1][0]}-{slices}", runs[-1][0]
    if runs:
        number = runs[-1][0] + 1
        last = spark.read.parquet(f"{path}/requests/run={runs[-1][0]}-{runs[-1][1]}").drop("slice")
        stored = stored_slices(spark, path)
        if stored:
            asked = spark.read.parquet(*stored).select(F.col("file_id").alias("_asked")).distinct()
            last = last.join(asked, F.col("file_id").eqNullSafe(F.col("_asked")), "left_anti")
        open_ = last
    else:
        number, open_ = 0, todo()
    dealt = open_.withColumn("slice", F.pmod(F.xxhash64("file_id"), F.lit(slices)))
    folder = f"{path}/requests/run={number}-{slices}"
    dealt.hint("rebalance", "slice").write.mode("overwrite").partitionBy("slice").parquet(folder)
    return folder, number


def stored_slices(spark: SparkSession, path: str) -> list[str]:
    """Folders of the replies of a batch that are complete."""
    found = [f"{path}/{n}" for n in names(spark, path) if n.startswith("slice=")]
    return [folder for folder in found if exists(spark, f"{folder}/_SUCCESS")]


def summarise_batch(
    spark: SparkSession,
    transcripts: DataFrame,
    ledger: DataFrame | None,
    fn: Callable[[str], str],
    out: str,
    batch: str,
    moved_at: Column,
    system: str = "",
    slices: int = 1,
    **calls,
) -> DataFrame:
    """Summarise what the ledger does not show as done; returns the counts per folder.

    What is to be asked is written once (``stage_requests``). The replies are stored slice by slice, with
    what was accepted of them: each transcript is read once and costs one model call. Summaries and
    ledger are written from there and published together (``sources.published``). Wherever it
    fails, the same call goes on where it stopped, with as many slices or another number of them, and
    nothing is asked, stored or published twice. A published batch cannot be written again. Run it
    without speculative tasks.
    """
    if is_published(spark, out, batch):
        raise FileExistsError(f"batch {batch} is done")
    path = f"{out}/replies/archive_batch_id={batch}"

    def asked() -> DataFrame:
        todo = transcripts if ledger is None else unprocessed(transcripts, ledger)
        return requests(todo, system).select("file_id", *KEEP, "request")

    staged, number = stage_requests(spark, asked, path, slices)
    for i in range(slices):
        replies = f"{path}/slice={number}-{i}"
        if exists(spark, f"{staged}/slice={i}") and not exists(spark, f"{replies}/_SUCCESS"):
            part = spark.read.parquet(f"{staged}/slice={i}")
            called = enrich_with_retry(part, fn, keep=KEEP, text="request", **calls)
            outcomes(called).drop("v").write.mode("overwrite").parquet(replies)

    attempt, stored = Attempt(spark, out, batch), stored_slices(spark, path)
    if stored:
        done = spark.read.parquet(*stored).withColumn("archive_batch_id", F.lit(batch))
        accepted = done.where(F.col("status") == "success").select(SUMMARIES.fieldNames())
        write_summaries(accepted, attempt.folder("summaries"))
        append_ledger(ledger_row(done, moved_at), attempt.folder("ledger"))
    attempt.publish()
    rows = read_published(spark, out, "ledger", LEDGER, batch, "csv", **CSV).na.fill("")
    return batch_status_counts(rows)
