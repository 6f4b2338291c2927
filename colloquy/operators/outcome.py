"""What became of each transcript, and the ledger rows that say so."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import extract_json_block, parse_summary_strict, title_date_defaults
from ..functions.text import summary_filename
from ..schemas import ARCHIVE_ROOT, DOCUMENT_MIME, LEDGER
from ..skew import computed_once


def document_type_filter(df: DataFrame, mime: str = DOCUMENT_MIME) -> DataFrame:
    """Only documents have a text; for other types it is null and ``unsupported`` is true."""
    is_document = F.coalesce(F.col("mime_type") == mime, F.lit(False))
    return df.withColumn("text", F.when(is_document, F.col("text"))).withColumn(
        "unsupported", ~is_document
    )


def accept_replies(replies: DataFrame) -> DataFrame:
    """Cut, parse and name each reply: adds ``json_content, v, output_filename``.

    All three are null where the reply holds no acceptable summary.
    """
    cut = replies.withColumn("_json", extract_json_block(F.col("reply")))
    parsed = cut.withColumn("_v", parse_summary_strict(F.col("_json")))
    title, date, failed = title_date_defaults(F.col("_v"))
    checked = parsed.withColumn("_ok", ~failed).withColumn("_title", title).withColumn("_date", date)
    name = summary_filename(F.col("_date"), F.col("_title"))
    return computed_once(
        checked,
        replies.columns,
        {
            "json_content": F.when(F.col("_ok"), F.col("_json")),
            "v": F.when(F.col("_ok"), F.col("_v")),
            "output_filename": F.when(F.col("_ok"), name),
        },
    )


def classify_outcome(df: DataFrame, stages: list[tuple[Column, Column]]) -> DataFrame:
    """Adds ``status`` and ``error``: the message of the first stage that failed, in order.

    ``stages`` holds (failed, message) pairs.
    """
    error = F.lit("")
    for failed, message in reversed(stages):
        error = F.when(failed, message).otherwise(error)
    return df.withColumn("error", error).withColumn(
        "status", F.when(F.col("error") == "", "success").otherwise("failed")
    )


def ledger_row(df: DataFrame, moved_at: Column) -> DataFrame:
    """The seven ledger columns; a missing value is '', a row without file id is dropped."""
    stamped = df.where(F.col("file_id").isNotNull()).withColumns(
        {"original_file_id": F.col("file_id"), "date_moved": moved_at}
    )
    return stamped.select(
        *[
            (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in stamped.columns else F.lit(""))
            .alias(c)
            for c in LEDGER.fieldNames()
        ]
    )


def batch_status_counts(ledger: DataFrame) -> DataFrame:
    """Successes and failures of each folder's batches."""
    return ledger.groupBy("user_folder_id", "archive_batch_id").agg(
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def found_count(files: DataFrame) -> DataFrame:
    """Transcripts found per folder."""
    return files.groupBy("user_folder_id").agg(F.count("*").alias("found"))


def archive_processed(ledger: DataFrame, root: str = ARCHIVE_ROOT) -> DataFrame:
    """Archive marks: where each transcript went. A failed one stays where it is."""
    return ledger.where(F.col("status") == "success").select(
        "original_file_id",
        "user_folder_id",
        "archive_batch_id",
        F.concat_ws("/", F.lit(root), "archive_batch_id", "file_name").alias("archive_path"),
    )


def ledger_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows and new rows with the fixed columns; nothing is merged."""
    return old.select(LEDGER.fieldNames()).unionByName(new.select(LEDGER.fieldNames()))


def latest_summary(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row per key; ``order`` must tell the rows of a key apart.

    An aggregate, so each input partition keeps one row per key before the shuffle.
    """
    rest = [c for c in df.columns if c not in key and c not in order]
    newest = F.max_by(F.struct(*order, *rest), F.struct(*order)).alias("newest")
    return df.groupBy(*key).agg(newest).select(*key, "newest.*").select(df.columns)


def first_match(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The first ``value`` per key in a stated order."""
    first = F.min(F.struct(*order, F.col(value).alias("_value")))["_value"]
    return df.groupBy(*keys).agg(first.alias(value))
