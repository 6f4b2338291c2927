"""Model replies of every awkward kind, made from the transcripts."""

import threading

from pyspark.sql import functions as F

from colloquy import functions as fn
from colloquy.operators import (
    accept_replies,
    batch_status_counts,
    enrich_with_retry,
    observe_batch,
)
from colloquy.plans import outcomes
from colloquy.schemas import DOCUMENT_MIME, SUMMARY_FAILED
from colloquy.sources import list_transcripts

from .columns import sanitized
from .registry import ESCAPED, escaped, query, transcripts

# What each tenth of the documents gets as a reply; {o} stands for a good JSON object.
KINDS = (
    "{o}",
    "Here you are: {o} -- that is all.",
    "```json\n{o}\n```",
    "There was nothing to summarise.",
    "{o} and {o}",
    '{{"title": "cut off",}}',
    '{{"title": null, "date": "2024"}}',
    '{{"date": "2024-02-30"}}',
    '{{"title": "numbered", "date": 20240101}}',
    "{o},{o}",
)


def replies(spark, sf):
    """One reply per transcript: ``file_id, user_folder_id, reply``."""
    docs = transcripts(spark, sf)
    good = F.concat(
        F.lit('{"title": "Talk -- '),
        "file_id",
        F.lit('", "date": "2024-02-'),
        F.lpad((F.col("doc_id") % 29 + 1).cast("string"), 2, "0"),
        F.lit('", "content": "'),
        escaped(F.col("text")),
        F.lit('"}'),
    )
    reply = F.lit("")
    for number, kind in reversed(list(enumerate(KINDS))):
        # The braces of the kinds are doubled, as for a format string.
        parts = [p.replace("{{", "{").replace("}}", "}") for p in kind.split("{o}")]
        pieces = [F.lit(parts[0])]
        for part in parts[1:]:
            pieces += [good, F.lit(part)]
        reply = F.when(F.col("doc_id") % 10 == number, F.concat(*pieces)).otherwise(reply)
    return docs.select("doc_id", "file_id", "file_name", "user_folder_id", reply.alias("reply"))


def _replies_sql() -> str:
    cases = []
    for number, kind in enumerate(KINDS):
        text = kind.replace("{{", "{").replace("}}", "}")
        quoted = "'" + text.replace("\n", "' || chr(10) || '").replace("{o}", "' || good || '") + "'"
        cases.append(f"when {number} then {quoted}")
    return f"""
    select doc_id, doc_id::varchar as file_id, 'talk ' || doc_id as file_name,
      source as user_folder_id, case doc_id % 10 {' '.join(cases)} end as reply
    from (select *, '{{"title": "Talk -- ' || doc_id || '", "date": "2024-02-'
      || lpad((doc_id % 29 + 1)::varchar, 2, '0') || '", "content": "' || {ESCAPED} || '"}}' as good
      from documents)"""


REPLIES = _replies_sql()
BLOCKS = rf"""
select *, nullif(regexp_extract(reply, '\{{.*\}}', 0, 's'), '') as block from ({REPLIES})"""
# DuckDB takes a comma before the closing brace; JSON does not.
# json_type of a key that is absent is null; of a null value it is 'NULL'.
CHECKED = f"""
select *, coalesce(try(json_type(good_block, '$.title')), 'VARCHAR') as title_type,
  coalesce(try(json_type(good_block, '$.date')), 'VARCHAR') as date_type
from (select *, case when json_valid(block) and not regexp_matches(block, ',\\s*\\}}')
    then block end as good_block from ({BLOCKS}))"""
NAMED = f"""
select *, good_block is not null and title_type = 'VARCHAR' and date_type = 'VARCHAR' as accepted,
  coalesce(good_block ->> '$.title', 'untitled') as title,
  coalesce(good_block ->> '$.date', 'undated') as date
from ({CHECKED})"""


@query(f"select file_id, md5(block) as block_md5, length(block)::int as block_chars from ({BLOCKS})")
def extract_json_block(spark, sf):
    block = fn.extract_json_block(F.col("reply"))
    return replies(spark, sf).select(
        "file_id", F.md5(block).alias("block_md5"), F.length(block).alias("block_chars")
    )


@query(
    f"""select file_id, good_block is not null as is_object,
    md5(good_block ->> '$.content') as content_md5 from ({CHECKED})"""
)
def parse_summary_strict(spark, sf):
    parsed = replies(spark, sf).withColumn(
        "v", fn.parse_summary_strict(fn.extract_json_block(F.col("reply")))
    )
    return parsed.select(
        "file_id",
        F.col("v").isNotNull().alias("is_object"),
        F.md5(F.try_variant_get("v", "$.content", "string")).alias("content_md5"),
    )


@query(
    f"""select file_id, not accepted as failed,
    case when good_block is not null and title_type = 'VARCHAR' then title end as title,
    case when good_block is not null and date_type = 'VARCHAR' then date end as date
    from ({NAMED})"""
)
def title_date_defaults(spark, sf):
    parsed = replies(spark, sf).withColumn(
        "v", fn.parse_summary_strict(fn.extract_json_block(F.col("reply")))
    )
    title, date, failed = fn.title_date_defaults(F.col("v"))
    return parsed.select(
        "file_id", title.alias("title"), date.alias("date"), failed.alias("failed")
    )


ACCEPTED = f"""
select file_id, file_name, user_folder_id, case when accepted then block end as json_content,
  case when accepted then {sanitized('date')} || '_' || {sanitized('title')} || '.json' end
  as output_filename
from ({NAMED})"""


@query(f"select file_id, output_filename, md5(json_content) as json_md5 from ({ACCEPTED})")
def accepted_replies(spark, sf):
    return accept_replies(replies(spark, sf)).select(
        "file_id", "output_filename", F.md5("json_content").alias("json_md5")
    )


class Model:
    """Stands in for a chat model. A transcript fails as many calls as its length modulo 4."""

    def __init__(self):
        self.tries = {}  # by thread: the text it is at, and how often that has failed

    def __call__(self, text):
        at, failed = self.tries.get(threading.get_ident(), (None, 0))
        failed = failed if at == text else 0
        if failed < len(text) % 4:
            # After its last try a text is done with, even if the next one is the same.
            self.tries[threading.get_ident()] = (text, failed + 1) if failed < 2 else (None, 0)
            raise RuntimeError(f"call {failed + 1} failed")
        self.tries[threading.get_ident()] = (None, 0)
        return f'Done. {{"title": "Notes of {len(text)} characters", "date": "2024-03-01"}}'


def no_wait(seconds):
    """Sleep of the stand-in model."""


@query(
    """select doc_id::varchar as file_id, least(length(text) % 4 + 1, 3)::int as attempts,
    case when length(text) % 4 < 3 then 'Done. {"title": "Notes of ' || length(text)
      || ' characters", "date": "2024-03-01"}' end as reply,
    case when length(text) % 4 = 3 then 'call 3 failed' end as call_error from documents"""
)
def enrich_retries(spark, sf):
    return enrich_with_retry(transcripts(spark, sf), Model(), sleep=no_wait)


SLICE = f"""
with listed as (select doc_id, source, length(text) as n from documents where lang = 'en'),
done as (select source, n, n % 4 < 3 as ok from listed)
select source as user_folder_id, 'processed-transcripts_20240301-040000' as archive_batch_id,
  count(*) filter (where ok) as succeeded, count(*) filter (where not ok) as failed
from done group by source"""


@query(SLICE)
def folder_results(spark, sf):
    """List, call, cut, parse, name, classify and count: how each folder's run went."""
    docs = transcripts(spark, sf)
    inventory = docs.select(
        F.col("file_id").alias("id"),
        F.col("file_name").alias("name"),
        "mime_type",
        F.lit(False).alias("trashed"),
        F.col("user_folder_id").alias("parent_id"),
        "text",
    )
    folders = docs.select("user_folder_id").distinct()
    listed = list_transcripts(inventory, folders, DOCUMENT_MIME, keep=("text",)).select(
        F.col("id").alias("file_id"),
        F.col("name").alias("file_name"),
        F.col("parent_id").alias("user_folder_id"),
        "text",
    )
    called = enrich_with_retry(listed, Model(), sleep=no_wait, keep=("file_name", "user_folder_id"))
    return batch_status_counts(
        outcomes(called).withColumn(
            "archive_batch_id", F.lit("processed-transcripts_20240301-040000")
        )
    )


@query(
    f"""select user_folder_id, count(*) filter (where json_content is not null) as succeeded,
    count(*) filter (where json_content is null) as failed,
    max(case when json_content is null then '{SUMMARY_FAILED}' else '' end) as last_error
    from ({ACCEPTED}) group by user_folder_id"""
)
def reply_outcomes(spark, sf):
    done = outcomes(replies(spark, sf).withColumn("attempts", F.lit(1)))
    return done.groupBy("user_folder_id").agg(
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.max("error").alias("last_error"),
    )


@query(
    f"""select count(*) as observed_rows, count(*) filter (where accepted) as succeeded,
    count(*) filter (where not accepted) as failed from ({NAMED})"""
)
def observe_batch_counts(spark, sf):
    done = outcomes(replies(spark, sf).withColumn("attempts", F.lit(1)))
    seen, observation = observe_batch(done, "batch")
    seen.write.format("noop").mode("overwrite").save()
    counts = observation.get
    return spark.range(1).select(
        F.lit(counts["rows"]).cast("long").alias("observed_rows"),
        F.lit(counts["succeeded"]).cast("long").alias("succeeded"),
        F.lit(counts["failed"]).cast("long").alias("failed"),
    )
