"""Listings, anti joins, reconciliation and counts."""

from pyspark.sql import functions as F

from colloquy import work_dir
from colloquy.operators import (
    add_done,
    batch_status_counts,
    citation_check,
    files_of_folders,
    first_match,
    found_count,
    grounding_check,
    latest_summary,
    merged_done,
    stage_reconcile,
    unprocessed,
    unprocessed_by_filter,
)

from .columns import LEDGER_SQL, ledger
from .registry import ORACLE, query, table, transcripts


def label_ledger(spark, sf):
    """Labels as a ledger: good quality means that the transcript was summarised."""
    return table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("original_file_id"),
        F.when(F.col("quality") == 1, "success").otherwise("failed").alias("status"),
    )


@query(
    """select doc_id::varchar as file_id, source as user_folder_id from documents
    where doc_id not in (select doc_id from labels where quality = 1)"""
)
def unprocessed_transcripts(spark, sf):
    files = transcripts(spark, sf).select("file_id", "user_folder_id")
    return unprocessed(files, label_ledger(spark, sf))


@query(ORACLE["unprocessed_transcripts"])
def filtered_transcripts(spark, sf):
    """The same by way of a filter that three batches of the ledger have added to."""
    files = transcripts(spark, sf).select("file_id", "user_folder_id")
    ledger, out = label_ledger(spark, sf), work_dir(spark, "done")
    for lot in range(3):
        add_done(ledger.where(F.length("original_file_id") % 3 == lot), out, f"lot {lot}")
    return unprocessed_by_filter(files, merged_done(spark, out), ledger)


@query(
    """select doc_id::varchar as file_id, 'talk ' || doc_id as file_name, source as user_folder_id
    from documents where source in (select source from documents where lang = 'de' and n_chars > 6000)"""
)
def folder_files(spark, sf):
    docs = transcripts(spark, sf)
    folders = docs.where((F.col("lang") == "de") & (F.col("n_chars") > 6000)).select("user_folder_id")
    # A folder without any file leaves no trace.
    folders = folders.union(spark.sql("select 'no such folder'"))
    return files_of_folders(docs.select("file_id", "file_name", "user_folder_id"), folders)


@query(
    """select coalesce(d.file_id, l.doc_id::varchar) as file_id, coalesce(lang = 'en', false) as has_media,
      coalesce(n_chars > 1000, false) as has_transcript, l.doc_id is not null as has_summary,
      coalesce(l.toxic = 0, false) as has_ledger
    from (select doc_id, doc_id::varchar as file_id, lang, n_chars from documents) d
    full join labels l on d.doc_id = l.doc_id
    where lang = 'en' or n_chars > 1000 or l.doc_id is not null"""
)
def stage_presence(spark, sf):
    docs = transcripts(spark, sf)
    labels = table(spark, sf, "labels").withColumn("file_id", F.col("doc_id").cast("string"))
    return stage_reconcile(
        docs.where(F.col("lang") == "en"),
        docs.where(F.col("n_chars") > 1000),
        labels,
        labels.where(F.col("toxic") == 0),
    )


@query(
    """with p as (select doc_id, text, unnest([lower(split_part(text, ' ', 1)),
      'Zed ' || doc_id, right(text, 25), '']) as name from documents)
    select doc_id::varchar as file_id, name, contains(lower(text), lower(name)) as grounded
    from p where name <> ''"""
)
def grounded_names(spark, sf):
    # Three people per summary: the first word, someone invented, and the last words.
    docs = transcripts(spark, sf)
    names = [
        F.lower(F.split_part("text", F.lit(" "), F.lit(1))),
        F.concat(F.lit("Zed "), "file_id"),
        F.right("text", F.lit(25)),
        F.lit(""),
    ]
    people = F.array(*[F.struct(n.alias("name")) for n in names]).alias("people")
    return grounding_check(docs.select("file_id", people), docs.select("file_id", "text"))


@query(
    """with b as (select item_id, text as passage, 'item ' || item_id as title from benchmark)
    select doc_id::varchar as file_id, passage as name,
      contains(lower(text), lower(passage)) as grounded
    from documents join b on item_id = doc_id"""
)
def grounded_passages(spark, sf):
    # A benchmark passage is quoted by the summary of the transcript with the same number.
    quoted = table(spark, sf, "benchmark").select(
        F.col("item_id").cast("string").alias("file_id"),
        F.array(F.struct(F.col("text").alias("name"))).alias("people"),
    )
    return grounding_check(quoted, transcripts(spark, sf).select("file_id", "text"))


@query(
    f"""select user_folder_id, archive_batch_id, count(*) filter (where status = 'success') as succeeded,
    count(*) filter (where status = 'failed') as failed from ({LEDGER_SQL}) group by all"""
)
def batch_counts(spark, sf):
    return batch_status_counts(ledger(spark, sf))


@query(
    r"""with i as (
      select doc_id::varchar as file_id, text, replace(left(text, 20), '"', ' ') as q, doc_id % 7 as k, doc_id % 9 as x,
        len(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')) as n from documents),
    c as (select *, case k when 0 then 'Para ' || x when 1 then 'see "' || q || '"' when 2 then 'para. 2, "no such words"'
        when 3 then 'Para 1 and Para ' || x when 4 then '"' || q || '" and "no such words"'
        when 5 then 'Paragraph 1: "' || q || '", "' || left(q, 4) || '"' else 'context' end as citation from i)
    select file_id, citation, case k when 0 then x when 2 then 2 when 3 then 1 when 5 then 1 end::varchar as paragraph, k < 6 as cited,
      case k when 0 then x between 1 and n when 1 then contains(lower(text), lower(q)) when 3 then n >= 1 and x between 1 and n
        when 5 then n >= 1 and contains(lower(text), lower(q)) and contains(lower(text), lower(left(q, 4))) else false end as grounded
    from c"""
)
def cited_passages(spark, sf):
    """Items that cite paragraphs by number, the first words, words that are not there, two of these, or nothing."""
    docs, kind = transcripts(spark, sf), F.col("doc_id") % 7
    words, x = F.replace(F.left("text", F.lit(20)), F.lit('"'), F.lit(" ")), F.col("doc_id") % 9

    def said(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    citation = (
        F.when(kind == 0, said("Para ", x))
        .when(kind == 1, said('see "', words, '"'))
        .when(kind == 2, 'para. 2, "no such words"')
        .when(kind == 3, said("Para 1 and Para ", x))
        .when(kind == 4, said('"', words, '" and "no such words"'))
        .when(kind == 5, said('Paragraph 1: "', words, '", "', F.left(words, F.lit(4)), '"'))
        .otherwise("context")
    )
    checked = citation_check(docs.select("file_id", citation.alias("citation")), docs.select("file_id", "text"))
    return checked.withColumn("paragraph", F.col("paragraph").cast("string"))


@query("select source as user_folder_id, count(*) as found from documents group by source")
def found_counts(spark, sf):
    return found_count(transcripts(spark, sf))


@query(
    """select user_id, event_id, event_type, value from events
    qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1"""
)
def latest_summaries(spark, sf):
    newest = latest_summary(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])
    return newest.select("user_id", "event_id", "event_type", "value")


@query(
    """select c_nationkey, c_mktsegment, arg_min(c_custkey, (c_acctbal, c_custkey)) as c_custkey
    from customer group by all"""
)
def first_matches(spark, sf):
    customers = table(spark, sf, "customer")
    return first_match(
        customers, ["c_nationkey", "c_mktsegment"], ["c_acctbal", "c_custkey"], "c_custkey"
    )
