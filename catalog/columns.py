"""Scalar expressions over whole tables."""

from pyspark.sql import functions as F

from colloquy import functions as fn
from colloquy.functions.text import WS
from colloquy.operators import classify_outcome, document_type_filter, ledger_row, run_report
from colloquy.schemas import ARCHIVE_FAILED, DOWNLOAD_FAILED, SUMMARY_FAILED, UPLOAD_FAILED

from .registry import query, table, transcripts


def sanitized(column: str) -> str:
    """SQL of a sanitized file name."""
    return (
        rf"left(regexp_replace(regexp_replace({column}, '[^\p{{L}}\p{{N}}_{WS}-]', '', 'g'), "
        rf"'[{WS}-]+', '_', 'g'), 80)"
    )


@query(f"select doc_id, {sanitized('text')} as name from documents")
def sanitize_filename(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", fn.sanitize_filename(F.col("text")).alias("name"))


@query(
    f"""select doc_id, {sanitized("source || ' -- ' || lang")} || '_' || {sanitized('text')}
    || '.json' as output_filename from documents"""
)
def summary_filename(spark, sf):
    date = F.concat_ws(" -- ", "source", "lang")
    name = fn.summary_filename(date, F.col("text")).alias("output_filename")
    return table(spark, sf, "documents").select("doc_id", name)


@query(
    """select doc_id, case when lang = 'en' then md5(text) end as text_md5,
    lang <> 'en' as unsupported from documents"""
)
def document_type(spark, sf):
    kept = document_type_filter(transcripts(spark, sf))
    return kept.select("doc_id", F.md5("text").alias("text_md5"), "unsupported")


@query(
    """select source, count(*) filter (where lang = 'es') as empty,
    count(*) filter (where lang <> 'es') as usable
    from documents group by source"""
)
def empty_transcript_guard(spark, sf):
    # Spanish texts are emptied, French ones turned into a blank, which is not empty.
    text = F.when(F.col("lang") == "es", "").when(F.col("lang") == "fr", " ").otherwise(F.col("text"))
    guarded = table(spark, sf, "documents").withColumn("empty", fn.empty_transcript_guard(text))
    return guarded.groupBy("source").agg(
        F.count_if("empty").alias("empty"), F.count_if(~F.col("empty")).alias("usable")
    )


CLASSIFIED = f"""
select doc_id::varchar as file_id, 'talk ' || doc_id as file_name, source as user_folder_id,
  case when n_chars < 300 then '{DOWNLOAD_FAILED}: {DOWNLOAD_FAILED}'
       when lang = 'de' then '{SUMMARY_FAILED}'
       when source = 'src3' then '{UPLOAD_FAILED}: quota "' || source || '", full'
       when text like '%ing.%' then '{ARCHIVE_FAILED} talk ' || doc_id || ' (' || doc_id || '): busy'
       else '' end as error
from documents"""


def classified(spark, sf):
    """Transcripts whose stages fail by what the table says about them."""
    return classify_outcome(
        transcripts(spark, sf),
        [
            (F.col("n_chars") < 300, F.lit(f"{DOWNLOAD_FAILED}: {DOWNLOAD_FAILED}")),
            (F.col("lang") == "de", F.lit(SUMMARY_FAILED)),
            (
                F.col("user_folder_id") == "src3",
                F.concat(F.lit(f'{UPLOAD_FAILED}: quota "'), "user_folder_id", F.lit('", full')),
            ),
            (
                F.col("text").contains("ing."),
                F.concat(
                    F.lit(f"{ARCHIVE_FAILED} "), "file_name", F.lit(" ("), "file_id", F.lit("): busy")
                ),
            ),
        ],
    )


@query(
    f"""with c as ({CLASSIFIED}) select file_id, error,
    case when error = '' then 'success' else 'failed' end as status from c"""
)
def classify_outcomes(spark, sf):
    return classified(spark, sf).select("file_id", "error", "status")


MOVED_AT = "2024-03-01T04:00:00.000001"
BATCH = "processed-transcripts_20240301-040000"

LEDGER_SQL = f"""
with c as ({CLASSIFIED}) select file_id as original_file_id, file_name,
  '{BATCH}' as archive_batch_id, '{MOVED_AT}' as date_moved, user_folder_id,
  case when error = '' then 'success' else 'failed' end as status, error
from c"""


def ledger(spark, sf):
    """Ledger rows of the classified transcripts."""
    rows = classified(spark, sf).withColumn("archive_batch_id", F.lit(BATCH))
    return ledger_row(rows, F.lit(MOVED_AT))


@query(
    f"""select * replace (case when user_folder_id = 'src5' then '' else file_name end as file_name)
    from ({LEDGER_SQL}) where user_folder_id <> 'src4'"""
)
def ledger_rows(spark, sf):
    # Folder src4 has lost its file ids, folder src5 its file names.
    rows = (
        classified(spark, sf)
        .withColumn("archive_batch_id", F.lit(BATCH))
        .withColumn("file_id", F.when(F.col("user_folder_id") != "src4", F.col("file_id")))
        .withColumn("file_name", F.when(F.col("user_folder_id") != "src5", F.col("file_name")))
    )
    return ledger_row(rows, F.lit(MOVED_AT))


@query(
    """select o_orderkey, 'processed-transcripts_' || strftime(o_orderdate, '%Y%m%d-%H%M%S')
    as archive_batch_id from orders"""
)
def batch_id(spark, sf):
    name = fn.batch_id(F.col("o_orderdate")).alias("archive_batch_id")
    return table(spark, sf, "orders").select("o_orderkey", name)


@query(
    """select doc_id, length(right(text, 6000))::int as tail_chars, md5(right(text, 6000)) as tail_md5
    from documents"""
)
def log_tail(spark, sf):
    tail = fn.log_tail(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.length(tail).alias("tail_chars"), F.md5(tail).alias("tail_md5")
    )


@query(
    """with c as (select doc_id, text, len(regexp_extract_all(text, 'en')) as errors from documents)
    select doc_id, errors::bigint as errors,
      md5('The transcript notes were completed with: ' || errors || ' error(s).' || chr(10) || chr(10)
      || '---- Log Tail (last 6000 characters) ----' || chr(10) || right(text, 6000)) as report_md5
    from c"""
)
def run_reports(spark, sf):
    reports = run_report(table(spark, sf, "documents").select("doc_id", "text"), needle="en")
    return reports.select(
        "doc_id", F.col("errors").cast("long").alias("errors"), F.md5("report").alias("report_md5")
    )


@query(
    """select source, sum(len(regexp_extract_all(text, 'on')))::bigint as occurrences
    from documents group by source"""
)
def error_count(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.groupBy("source").agg(
        F.sum(fn.error_count(F.col("text"), "on")).alias("occurrences")
    )


@query(
    """select doc_id, case lang when 'en' then lang || '@mail.example' when 'es' then '- ' || source
    end as email from documents"""
)
def null_marker_cleanup(spark, sf):
    written = (
        F.when(F.col("lang") == "de", " N/A ")
        .when(F.col("lang") == "fr", "Not provided")
        .when(F.col("lang") == "es", F.concat(F.lit("- "), "source"))
        .otherwise(F.concat("lang", F.lit("@mail.example")))
    )
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", fn.null_marker_cleanup(written).alias("email"))


@query(
    """select doc_id, 'system' as first_role, 'user' as second_role,
    length('Summarise the meeting.')::int as system_chars, md5(text) as user_md5 from documents"""
)
def chat_messages(spark, sf):
    messages = F.col("messages")
    docs = table(spark, sf, "documents").select(
        "doc_id", fn.build_messages("Summarise the meeting.", F.col("text")).alias("messages")
    )
    return docs.select(
        "doc_id",
        messages[0]["role"].alias("first_role"),
        messages[1]["role"].alias("second_role"),
        F.length(messages[0]["content"]).alias("system_chars"),
        F.md5(messages[1]["content"]).alias("user_md5"),
    )
