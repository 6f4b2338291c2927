"""Whole jobs over the given tables: from a listing to counts, and from log files to reports."""

import json

from pyspark.sql import functions as F

from colloquy import work_dir
from colloquy.plans import analyse_logs, summarise_batch, to_summarise
from colloquy.schemas import DOCUMENT_MIME

from .columns import MOVED_AT
from .joins import label_ledger
from .logs import RUNS_SQL, log_lines
from .registry import query, transcripts
from .replies import no_wait

BATCH = "processed-transcripts_20310509-040506"


class RequestModel:
    """Stands in for a chat model: transcripts with a length of 3 modulo 4 never get a reply."""

    def __call__(self, request):
        text = json.loads(request)[-1]["content"]
        if len(text) % 4 == 3:
            raise RuntimeError("no reply")
        return f'{{"title": "Notes of {len(text)}", "date": "2031-05-09"}}'


@query(
    f"""select source as user_folder_id, '{BATCH}' as archive_batch_id,
      count(*) filter (where length(text) % 4 < 3) as succeeded,
      count(*) filter (where length(text) % 4 = 3) as failed
    from documents where lang = 'en' and doc_id % 17 <> 0 and source <> 'src4'
      and doc_id not in (select doc_id from labels where quality = 1) group by source"""
)
def batch_job(spark, sf):
    """List the folders, skip what is done, read the rest, call, store, count."""
    docs = transcripts(spark, sf)
    inventory = docs.select(
        F.col("file_id").alias("id"),
        F.col("file_name").alias("name"),
        F.when(F.col("lang") == "en", DOCUMENT_MIME).otherwise("text/plain").alias("mime_type"),
        (F.col("doc_id") % 17 == 0).alias("trashed"),
        F.col("user_folder_id").alias("parent_id"),
    )
    folders = docs.where("user_folder_id <> 'src4'").select("user_folder_id")
    todo = to_summarise(inventory, folders, label_ledger(spark, sf), docs.select("file_id", "text"))
    return summarise_batch(
        spark,
        todo,
        None,
        RequestModel(),
        work_dir(spark, "batch-job"),
        BATCH,
        F.lit(MOVED_AT),
        system="Summarise.",
        slices=2,
        sleep=no_wait,
    )


@query(
    f"""with r as ({RUNS_SQL}), m as (select *, row_number() over (
        partition by log_file, run, step, event_type order by line_no) as n
      from r where event_type in ('view', 'click')),
    p as (select log_file, run, step, n, count(*) as k from m group by all)
    select r.log_file, count(distinct run) as runs, count(*) as lines,
      count(*) filter (where event_type = 'error') as errors,
      (select count(*) filter (where k = 2) from p where p.log_file = r.log_file) as pairs
    from r group by r.log_file"""
)
def log_job(spark, sf):
    """Log files read by offset, typed and numbered once, and the tables about them."""
    path = work_dir(spark, "log-job")
    lines = log_lines(spark, sf).repartition("log_file").sortWithinPartitions("log_file", "line_no")
    lines.select("log_file", F.col("line").alias("value")).write.partitionBy("log_file").text(f"{path}/in")
    found = analyse_logs(spark, f"{path}/in", f"{path}/out")
    name = F.regexp_extract("log_file", "log_file=([^/]*)/", 1)
    runs = found["runs"].groupBy(name.alias("log_file")).agg(
        F.count("*").alias("runs"), F.sum("lines").alias("lines"), F.sum("errors").alias("errors")
    )
    pairs = found["pairs"].groupBy(name.alias("log_file")).agg(F.count_if(F.col("outcome") == "completed").alias("pairs"))
    return runs.join(pairs, "log_file")
