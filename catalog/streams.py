"""Streams over the given tables, run until nothing new is there."""

from pyspark.sql import functions as F

from colloquy import work_dir
from colloquy.operators import enrich_with_retry, log_error_windows, log_runs
from colloquy.streaming import (
    archive_on_commit,
    incremental_ingest,
    land_transcripts,
    ledger_stream,
    number_stream,
    numbered_pairs,
    read_steps,
    run_available,
)

from .columns import MOVED_AT
from .logs import log_lines
from .registry import ORACLE, query, table
from .replies import Model, no_wait


def table_stream(spark, sf, name):
    """A table as a stream of its files, whether it is one file or a folder of them."""
    return incremental_ingest(spark, f"{sf}/{name}.parquet", "parquet", table(spark, sf, name).schema)


def document_stream(spark, sf):
    return table_stream(spark, sf, "documents")


@query("select doc_id, md5(text) as text_md5 from documents")
def streamed_transcripts(spark, sf):
    out, checkpoint = work_dir(spark, "ingest"), work_dir(spark, "ingest-checkpoint")
    rows = document_stream(spark, sf).select("doc_id", F.md5("text").alias("text_md5"))
    run_available(rows, out, checkpoint)
    # A second run finds nothing new.
    run_available(rows, out, checkpoint)
    return spark.read.parquet(out)


@query("select 'item ' || item_id as user_folder_id, true as is_valid_utf8, md5(text || chr(10)) as text_md5 from benchmark")
def landed_transcripts(spark, sf):
    """A file per benchmark item, in a folder with a blank in its name, read into one table in two runs."""
    inbox, out, checkpoint = work_dir(spark, "files"), work_dir(spark, "landed"), work_dir(spark, "landed-checkpoint")
    items = table(spark, sf, "benchmark").select(
        "item_id", F.concat(F.lit("item "), "item_id").alias("folder"), F.col("text").alias("value")
    )
    for turn in range(2):
        some = items.where(F.col("item_id") % 2 == turn).drop("item_id")
        some.write.mode("append").partitionBy("folder").text(inbox)
        landed = land_transcripts(spark, inbox, out, checkpoint, pathGlobFilter="*.txt")
    folder = F.url_decode(F.regexp_extract("user_folder_id", "folder=(.*)", 1))
    return landed.select(folder.alias("user_folder_id"), "is_valid_utf8", F.md5("text").alias("text_md5"))


@query(
    """select source, count(*) as rows, count(*) as seen, sum(length(text))::bigint as chars, true as archived
    from documents group by source"""
)
def archived_transcripts(spark, sf):
    """A copy of the documents, one folder per source, streamed a few files at a time and archived.

    Every file is then in the archive or still in the inbox, and what lies there is what was seen.
    """
    inbox, archive = work_dir(spark, "inbox"), work_dir(spark, "archive")
    out, checkpoint = work_dir(spark, "archived"), work_dir(spark, "archived-checkpoint")
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    docs.hint("rebalance", "source").write.partitionBy("source").parquet(inbox)
    stream = archive_on_commit(spark, inbox, archive, "parquet", docs.schema, maxFilesPerTrigger="7")
    for _ in range(2):
        run_available(stream.select("source", F.length("text").alias("n")), out, checkpoint)
    seen = spark.read.parquet(out).groupBy("source").agg(F.count("*").alias("seen"))
    source = F.url_decode(F.regexp_extract("_metadata.file_path", "source=([^/]*)/", 1)).alias("source")

    def rows(folder):
        files = spark.read.schema("doc_id long, text string").option("recursiveFileLookup", "true").parquet(folder)
        return files.select(source, "text")

    moved = rows(archive)
    kept = moved.union(rows(inbox)).groupBy("source").agg(
        F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")
    )
    return kept.join(seen, "source").withColumn("archived", F.lit(not moved.isEmpty()))


@query(
    f"""select doc_id::varchar as original_file_id, 'talk ' || doc_id as file_name,
      '{MOVED_AT}' as date_moved, 'processed-transcripts_20310509-040506' as archive_batch_id,
      source as user_folder_id,
      case when length(text) % 4 < 3 then 'success' else 'failed' end as status,
      case when length(text) % 4 < 3 then '' else 'Summary generation failed (see logs for detail)'
        end as error,
      case when length(text) % 4 < 3 then '2024_03_01_Notes_of_' || length(text)
        || '_characters.json' end as output_filename
    from documents"""
)
def streamed_ledger(spark, sf):
    """Ledger and summaries of a stream of documents, joined again by file."""
    out, checkpoint = work_dir(spark, "stream"), work_dir(spark, "stream-checkpoint")
    stream = document_stream(spark, sf).select(
        F.col("doc_id").cast("string").alias("file_id"),
        F.concat(F.lit("talk "), F.col("doc_id")).alias("file_name"),
        F.col("source").alias("user_folder_id"),
        "text",
    )

    def enrich(batch):
        return enrich_with_retry(
            batch, Model(), sleep=no_wait, keep=("file_name", "user_folder_id")
        )

    started = F.lit("2031-05-09 04:05:06").cast("timestamp")
    ledger_stream(stream, enrich, out, checkpoint, F.lit(MOVED_AT), started)
    ledger = spark.read.parquet(f"{out}/ledger").drop("run_id", "batch_id")
    names = spark.read.parquet(f"{out}/summaries").select(
        F.col("file_id").alias("original_file_id"), "output_filename"
    )
    return ledger.join(names, "original_file_id", "left")


@query(
    """with w as (select time_bucket(interval '6 hours', ts) as s, count(*) as n from events
      where event_type = 'error' group by all)
    select strftime(s, '%Y-%m-%d %H:%M') as window_start, n as errors from w
    where s + interval '6 hours' <= (select max(ts) from events) - interval '2 hours'"""
)
def streamed_error_windows(spark, sf):
    """Windows of a stream that are closed: those that end before the watermark."""
    out, checkpoint = work_dir(spark, "windows"), work_dir(spark, "windows-checkpoint")
    windows = log_error_windows(table_stream(spark, sf, "events"), "6 hours", "2 hours", F.col("event_type") == "error")
    run_available(windows, out, checkpoint)
    return spark.read.parquet(out).select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "errors"
    )


# What a task of a stream holds of a log is at most a lot.
LOT = 1_000_000


def line_lots(lines, size=LOT, least=5):
    """Conditions that cut lines by their numbers into lots of about ``size`` lines, in order; ``least`` or more."""
    n = max(least, -(-lines.count() // size))
    ranks = [i / n for i in range(1, n)]
    # Ranks are right to a ten-thousandth of the lines, or of a lot where there are more.
    cuts = lines.agg(F.percentile_approx("line_no", ranks, max(10_000, 10 * n))).first()[0] or []
    cuts = sorted(set(cuts))
    line = F.col("line_no")
    lots = [(line > low) & (line <= high) for low, high in zip(cuts, cuts[1:])]
    return [line <= cuts[0], *lots, line > cuts[-1]] if cuts else [line.isNotNull()]


def numbered_lines(spark, sf):
    """The job logs in lots, each taken in by a new run of one stream with a state per log."""
    inbox, out = work_dir(spark, "log-lots"), work_dir(spark, "log-numbered")
    lines = log_lines(spark, sf)
    for lot in line_lots(lines):
        lines.where(lot).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(lines.schema).parquet(inbox)
        run_available(number_stream(stream), f"{out}/table", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table")


@query(ORACLE["log_run_table"])
def streamed_log_runs(spark, sf):
    runs = log_runs(numbered_lines(spark, sf))
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS") for c in ("started_at", "ended_at")}
    return runs.withColumns(times)


@query(ORACLE["step_pairing"])
def streamed_step_pairs(spark, sf):
    places = {c: F.col(c).cast("string") for c in ("start_line", "end_line")}
    return numbered_pairs(numbered_lines(spark, sf)).withColumns(places).drop("seconds")


@query(
    """select batch, step, case step when 'summaries' then done else n end as rows, true as timed
    from (select 0::bigint as batch, count(*) as n, count(*) filter (where length(text) % 4 < 3) as done from documents),
      (select unnest(['replies', 'summaries', 'ledger', 'addBatch']) as step)"""
)
def streamed_step_times(spark, sf):
    """What each step of a streamed run took and how many rows it had."""
    out = work_dir(spark, "timed")
    stream = document_stream(spark, sf).select(
        F.col("doc_id").cast("string").alias("file_id"),
        F.lit("talk").alias("file_name"),
        F.col("source").alias("user_folder_id"),
        "text",
    )

    def enrich(batch):
        return enrich_with_retry(batch, Model(), sleep=no_wait, keep=("file_name", "user_folder_id"))

    ledger_stream(stream, enrich, out, f"{out}/checkpoint", F.lit(MOVED_AT), steps=f"{out}/steps")
    steps = read_steps(spark, f"{out}/steps")
    wanted = steps.where(F.col("step").isin("replies", "summaries", "ledger", "addBatch"))
    return wanted.select("batch", "step", "rows", (F.col("seconds") > 0).alias("timed"))
