"""Sources and sinks. What is written goes to the cluster's shared folder and is read back."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from colloquy import work_dir
from colloquy.functions import error_count
from colloquy.operators import archive_processed, ledger_union
from colloquy.schemas import DOCUMENT_MIME, INVENTORY, NO_LOG
from colloquy.sources import (
    Attempt,
    append_ledger,
    inventory_report,
    list_transcripts,
    read_job_log,
    read_ledger,
    read_log_lines,
    read_summaries,
    scan_folders,
    scan_ledger,
    stream_folders,
    write_folders,
    write_summaries,
    write_transcript_text,
)
from colloquy.sources import scan_transcripts as read_transcripts
from colloquy.streaming import land_summaries, run_available

from .columns import LEDGER_SQL, ledger
from .logs import LINES_SQL, log_lines
from .registry import query, table, transcripts
from .replies import ACCEPTED, accept_replies, replies


FILES_SQL = """select doc_id::varchar as file_id, source as user_folder_id, lang <> 'fr' as is_valid_utf8,
case when lang <> 'fr' then md5(text) end as text_md5 from documents"""


def transcript_files(spark, sf):
    """Transcripts as files of their users' folders; those in French get a broken tail."""
    content = F.encode("text", "utf-8")
    broken = F.concat(content, F.unhex(F.lit("C3")))
    return transcripts(spark, sf).select(
        "doc_id",
        "user_folder_id",
        F.concat("file_id", F.lit(".txt")).alias("file_name"),
        F.when(F.col("lang") == "fr", broken).otherwise(content).alias("content"),
    )


def as_read(files):
    return files.select(
        F.replace("file_name", F.lit(".txt"), F.lit("")).alias("file_id"),
        "user_folder_id",
        "is_valid_utf8",
        F.md5("text").alias("text_md5"),
    )


def user_folders(spark, sf, path):
    """A manifest of the users' folders."""
    folders = transcripts(spark, sf).select(F.concat(F.lit(f"{path}/"), "user_folder_id").alias("value")).distinct()
    return [r.value for r in folders.collect()]


@query(FILES_SQL)
def scan_transcripts(spark, sf):
    path = work_dir(spark, "files")
    write_folders(transcript_files(spark, sf), path)
    return as_read(read_transcripts(spark, path))


@query(FILES_SQL)
def scanned_folders(spark, sf):
    """The same files, listed and read folder by folder by the tasks."""
    path = work_dir(spark, "files")
    write_folders(transcript_files(spark, sf), path)
    return as_read(scan_folders(spark, user_folders(spark, sf, path), splits=4))


@query(f"select *, 1::bigint as copies from ({FILES_SQL})")
def streamed_folders(spark, sf):
    """Files that come in two lots, each taken in by a run of one stream: every file once."""
    path, out = work_dir(spark, "files"), work_dir(spark, "landed")
    files, folders = transcript_files(spark, sf), user_folders(spark, sf, path)
    for lot in (0, 1):
        write_folders(files.where(F.col("doc_id") % 2 == lot), path)
        run_available(stream_folders(spark, folders, settle=0), f"{out}/table", f"{out}/checkpoint")
    landed = as_read(spark.read.parquet(f"{out}/table"))
    copies = F.count("*").over(Window.partitionBy("file_id"))
    return landed.withColumn("copies", copies)


def inventory(spark, sf):
    docs = transcripts(spark, sf)
    return docs.select(
        F.col("file_id").alias("id"),
        F.col("file_name").alias("name"),
        "mime_type",
        (F.col("n_chars") % 2 == 1).alias("trashed"),
        F.col("user_folder_id").alias("parent_id"),
    )


@query(
    """select doc_id::varchar as id, 'talk ' || doc_id as name, source as parent_id from documents
    where lang = 'en' and n_chars % 2 = 0
      and source in (select source from documents where lang = 'fr' and n_chars > 8000)"""
)
def listed_transcripts(spark, sf):
    long_french = (F.col("lang") == "fr") & (F.col("n_chars") > 8000)
    folders = transcripts(spark, sf).where(long_french).select("user_folder_id")
    return list_transcripts(inventory(spark, sf), folders, DOCUMENT_MIME)


def customer_files(spark, sf):
    """Customers as files of their nation's folder, with owners and permissions."""

    def person(address, role=None):
        fields = [] if role is None else [role.alias("role")]
        return F.struct(*fields, address.alias("emailAddress"))

    address = F.concat("c_name", F.lit("@mail.example"))
    none = F.lit(None).cast("string")
    debt = F.col("c_acctbal") < 0
    columns = {
        "id": F.col("c_custkey").cast("string"),
        "name": F.col("c_name"),
        "mime_type": F.col("c_mktsegment"),
        "trashed": F.col("c_mktsegment") == "MACHINERY",
        "parent_id": F.col("c_nationkey").cast("string"),
        # Those in debt have a second owner, whose address the furniture segment lacks.
        "owners": F.when(
            debt,
            F.array(
                person(address),
                person(F.when(F.col("c_mktsegment") != "FURNITURE", F.lit("bank@mail.example"))),
            ),
        ).otherwise(F.array(person(address))),
        "permissions": F.array(
            person(address, F.lit("writer")), person(none, F.lit("reader")), person(address, none)
        ),
    }
    files = table(spark, sf, "customer").select(*[c.alias(n) for n, c in columns.items()])
    return files.select(F.from_json(F.to_json(F.struct("*")), INVENTORY).alias("f")).select("f.*")


@query(
    """select c_custkey::varchar as id, c_name as name, c_mktsegment as mime_type,
      case when c_acctbal >= 0 then c_name || '@mail.example'
        when c_mktsegment <> 'FURNITURE' then c_name || '@mail.example,bank@mail.example' end as owners,
      'writer:' || c_name || '@mail.example,reader:,:' || c_name || '@mail.example' as perms,
      c_acctbal < 0 and c_mktsegment = 'FURNITURE' as listing_error
    from customer join nation on c_nationkey = n_nationkey
    where c_mktsegment <> 'MACHINERY' and n_regionkey in (0, 2, 4)"""
)
def inventory_listing(spark, sf):
    folders = (
        table(spark, sf, "nation")
        .where(F.col("n_regionkey").isin(0, 2, 4))
        .select(F.col("n_nationkey").cast("string").alias("user_folder_id"))
    )
    return inventory_report(customer_files(spark, sf), folders)


@query(f"select *, 2::bigint as copies from ({LEDGER_SQL})")
def ledger_round_trip(spark, sf):
    # Appended twice: nothing is rewritten or merged.
    path = work_dir(spark, "ledger")
    rows = ledger(spark, sf)
    append_ledger(rows, path)
    append_ledger(rows, path)
    stored = read_ledger(spark, path)
    return stored.groupBy(*stored.columns).agg(F.count("*").alias("copies"))


FILE_ROWS = 1_000_000

# An error in three has line breaks and quotes.
NOISY_LEDGER_SQL = f"""
select original_file_id, file_name, archive_batch_id, date_moved, user_folder_id, status,
  error || case when length(original_file_id) % 3 = 0 then chr(10) || '"again",' || chr(10) || chr(10) || file_name else '' end as error
from ({LEDGER_SQL})"""


@query(NOISY_LEDGER_SQL)
def scanned_ledger(spark, sf):
    """A ledger in files of up to about a million rows, whose values hold line breaks, read in pieces."""
    path = work_dir(spark, "ledger")
    files = 1 + table(spark, sf, "documents").count() // FILE_ROWS
    more = F.concat(F.lit('\n"again",\n\n'), "file_name")
    noisy = F.when(F.length("original_file_id") % 3 == 0, more).otherwise("")
    # The texts are read by many tasks; only the ledger's rows meet in the one that writes a file.
    append_ledger(ledger(spark, sf).withColumn("error", F.concat("error", noisy)).repartition(files), path)
    return scan_ledger(spark, path)


@query(f"select * from ({LEDGER_SQL}) where status = 'success' union all select * from ({LEDGER_SQL}) where status = 'failed'")
def published_batches(spark, sf):
    """Two batches, each written by a try that was given up and one that was published, beside an unpublished one."""
    root, rows = work_dir(spark, "published"), ledger(spark, sf)
    for status in ("success", "failed"):
        own = rows.where(F.col("status") == status)
        append_ledger(own, Attempt(spark, root, f"batch {status}").folder("ledger"))
        kept = Attempt(spark, root, f"batch {status}")
        append_ledger(own, kept.folder("ledger"))
        kept.publish()
    append_ledger(rows, Attempt(spark, root, "not yet").folder("ledger"))
    return read_ledger(spark, f"{root}/ledger")


@query(
    f"""select * from ({LEDGER_SQL}) where status = 'failed'
    union all select * from ({LEDGER_SQL})"""
)
def ledger_unions(spark, sf):
    rows = ledger(spark, sf)
    return ledger_union(rows.where(F.col("status") == "failed"), rows)


@query(
    f"""select original_file_id, user_folder_id, archive_batch_id,
    'transcript_archive/' || archive_batch_id || '/' || file_name as archive_path
    from ({LEDGER_SQL}) where status = 'success'"""
)
def archive_marks(spark, sf):
    return archive_processed(ledger(spark, sf))


@query(
    f"""select file_id, user_folder_id, md5(json_content) as json_md5, output_filename, 'b1' as batch
    from ({ACCEPTED}) where json_content is not null"""
)
def write_summaries_back(spark, sf):
    path = work_dir(spark, "summaries")
    kept = accept_replies(replies(spark, sf)).where(F.col("json_content").isNotNull())
    summaries = kept.select(
        "file_id", "user_folder_id", "json_content", "output_filename", F.lit("b1").alias("batch")
    )
    write_summaries(summaries, path)
    stored = spark.read.parquet(path)
    return stored.select(
        "file_id", "user_folder_id", F.md5("json_content").alias("json_md5"), "output_filename", "batch"
    )


@query("select doc_id::varchar as file_id, md5(text) as text_md5 from documents")
def write_transcripts_back(spark, sf):
    path = work_dir(spark, "transcripts")
    write_transcript_text(transcripts(spark, sf), path)
    return spark.read.parquet(path).select("file_id", F.md5("text").alias("text_md5"))


REPLIES_SQL = """select s_suppkey, 'Visit of ' || s_name as title, n_name as place
from supplier join nation on s_nationkey = n_nationkey"""


def supplier_replies(spark, sf):
    """A reply per supplier, as replies are stored, in the folder of its nation."""
    suppliers = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    raw = F.concat(
        F.lit('{\n    "response": ```json\n{\n  "title": "Visit of '),
        "s_name",
        F.lit('",\n  "supplier": '),
        F.col("s_suppkey").cast("string"),
        F.lit(',\n  "content": "\nWhere:\n- '),
        "n_name",
        F.lit('\n"\n}\n```\n}'),
    )
    name = F.concat(F.col("s_suppkey").cast("string"), F.lit(".json"))
    return suppliers.select(
        F.col("s_nationkey").cast("string").alias("user_folder_id"), name.alias("file_name"), F.encode(raw, "utf-8").alias("content")
    )


def as_visits(found):
    content = F.try_variant_get("v", "$.content", "string")
    return found.select(
        F.try_variant_get("v", "$.supplier", "bigint").alias("s_suppkey"),
        F.try_variant_get("v", "$.title", "string").alias("title"),
        F.regexp_extract(content, r"- ([^\n]*)", 1).alias("place"),
    )


@query(REPLIES_SQL)
def stored_replies(spark, sf):
    """Replies that come as files in two lots, landed in one table and unwrapped."""
    inbox, out = work_dir(spark, "replies"), work_dir(spark, "replies-landed")
    replies = supplier_replies(spark, sf)
    for lot in (0, 1):
        write_folders(replies.where(F.length("user_folder_id") % 2 == lot), inbox)
        landed = land_summaries(spark, inbox, f"{out}/table", f"{out}/checkpoint")
    return as_visits(landed)


@query(REPLIES_SQL)
def reply_files(spark, sf):
    """The same replies, each file read whole."""
    path = work_dir(spark, "replies")
    write_folders(supplier_replies(spark, sf), path)
    return as_visits(read_summaries(spark, path))


@query(
    f"""with l as ({LINES_SQL}) select log_file, sum(length(line) + 1)::bigint as chars,
    sum(case when contains(line, 'ERROR') then 1 else 0 end)::bigint as errors from l group by log_file
    union all select 'missing', {len(NO_LOG)}, 0"""
)
def job_logs(spark, sf):
    """Logs written per log name and read back whole; a log that is not there has a fixed text."""
    path = work_dir(spark, "joblog")
    log_lines(spark, sf).select("log_file", F.col("line").alias("value")).write.partitionBy(
        "log_file"
    ).text(path)
    folder = F.regexp_extract("log_file", "log_file=([^/]*)/", 1)
    found = read_job_log(spark, path).withColumn("log_file", folder)
    absent = read_job_log(spark, f"{path}/absent").withColumn("log_file", F.lit("missing"))
    return (
        found.unionByName(absent)
        .groupBy("log_file")
        .agg(
            F.sum(F.length("text")).alias("chars"),
            F.sum(error_count(F.col("text"))).alias("errors"),
        )
    )


@query(
    f"""with l as ({LINES_SQL}) select log_file, count(*) as lines, true as numbered
    from l group by log_file"""
)
def log_line_numbers(spark, sf):
    """Lines read back by offset and numbered without gaps in every file."""
    path = work_dir(spark, "loglines")
    lines = log_lines(spark, sf).select("log_file", F.col("line").alias("value"))
    lines.write.partitionBy("log_file").text(path)
    per_file = (
        read_log_lines(spark, path)
        .groupBy("log_file")
        .agg(
            F.count("*").alias("lines"),
            F.min("line_no").alias("first_no"),
            F.max("line_no").alias("last_no"),
            F.sum("line_no").alias("total"),
        )
    )
    n = F.col("lines")
    return (
        per_file.withColumn("log_file", F.regexp_extract("log_file", "log_file=([^/]*)/", 1))
        .groupBy("log_file")
        .agg(
            F.sum("lines").alias("lines"),
            F.bool_and(
                (F.col("first_no") == 1)
                & (F.col("last_no") == n)
                & (F.col("total") * 2 == n * (n + 1))
            ).alias("numbered"),
        )
    )
