"""Joins between transcripts, ledger and summaries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import paragraphs


def unprocessed(transcripts: DataFrame, ledger: DataFrame) -> DataFrame:
    """Transcripts without a successful ledger row; failed ones are taken up again.

    Give it a listing rather than texts: every file that was ever listed goes through this join.
    """
    done = (
        ledger.where(F.col("status") == "success")
        .select(F.col("original_file_id").alias("file_id"))
        .distinct()
    )
    return transcripts.join(done, "file_id", "left_anti")


def files_of_folders(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files of the given folders; a folder without files gives nothing."""
    return files.join(folders.select("user_folder_id").distinct(), "user_folder_id")


def stage_reconcile(
    media: DataFrame, transcripts: DataFrame, summaries: DataFrame, ledger: DataFrame
) -> DataFrame:
    """Which items have media, a transcript, a summary and a ledger row.

    A union and one aggregate do what three full outer joins would, with one shuffle;
    repeated keys shrink to one row before it.
    """
    sides = {
        "has_media": media,
        "has_transcript": transcripts,
        "has_summary": summaries,
        "has_ledger": ledger,
    }
    marked = [
        df.select("file_id", *[F.lit(flag == side).alias(flag) for flag in sides])
        for side, df in sides.items()
    ]
    return (
        reduce(DataFrame.unionAll, marked)
        .groupBy("file_id")
        .agg(*[F.bool_or(flag).alias(flag) for flag in sides])
    )


def grounding_check(summary_norm: DataFrame, transcripts: DataFrame) -> DataFrame:
    """For each person of a summary: does the name occur in the summary's own transcript?

    The names of a file stay in one array until they are tested, so a transcript is not
    repeated for each name. The transcripts are the side that need not be moved: a few summaries
    are sent to them. A summary without a transcript has no grounded name.
    """
    names = summary_norm.select(
        "file_id",
        F.filter(
            F.transform("people", lambda p: p["name"]), lambda n: n.isNotNull() & (n != "")
        ).alias("names"),
    )
    texts = transcripts.select("file_id", F.lower("text").alias("text"))
    lost = names.join(texts.select("file_id"), "file_id", "left_anti").withColumn("text", F.lit(""))
    met = texts.join(names, "file_id").select("file_id", "names", "text").unionByName(lost)
    tested = met.select(
        "file_id",
        F.transform(
            "names",
            lambda n: F.struct(
                n.alias("name"),
                F.coalesce(F.col("text").contains(F.lower(n)), F.lit(False)).alias("grounded"),
            ),
        ).alias("tested"),
    )
    return tested.select("file_id", F.inline("tested"))


def citation_check(items: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Does what an item cites stand in its transcript? ``items`` with ``paragraph, cited, grounded``.

    Every ``Para X`` of a citation must be one of the transcript's paragraphs, and every text between
    double quotes must occur in it; one that does not hold makes the item ungrounded. ``paragraph`` is
    the first number. ``cited`` is false where a citation has neither. An item without a transcript
    is not grounded. Of the transcripts only the number of paragraphs and the quotes found go on.
    """
    number, quote = r"(?i)\bpara(?:graph)?\.? *([0-9]{1,9})\b", r'"([^"]+)"'
    numbers = F.regexp_extract_all("citation", F.lit(number), F.lit(1)).cast("array<int>")
    quotes = F.regexp_extract_all(F.lower("citation"), F.lit(quote), F.lit(1))
    none = F.array().cast("array<string>")
    cites = items.withColumns({"_numbers": F.coalesce(numbers, none.cast("array<int>")), "_quotes": F.coalesce(quotes, none)})
    asked = cites.groupBy("file_id").agg(F.array_distinct(F.flatten(F.collect_set("_quotes"))).alias("_asked"))
    text = F.lower("text")
    read = transcripts.join(asked, "file_id").select(
        "file_id",
        F.size(paragraphs(F.col("text"))).alias("_paragraphs"),
        F.filter("_asked", lambda q: text.contains(q)).alias("_found"),
    )
    met = cites.join(read, "file_id", "left")
    there = F.forall("_numbers", lambda n: F.coalesce(n.between(1, F.col("_paragraphs")), F.lit(False)))
    said = F.forall("_quotes", lambda q: F.coalesce(F.array_contains("_found", q), F.lit(False)))
    cited = (F.size("_numbers") > 0) | (F.size("_quotes") > 0)
    checked = met.withColumns({"paragraph": F.get("_numbers", F.lit(0)), "cited": cited, "grounded": cited & there & said})
    return checked.drop("_numbers", "_quotes", "_paragraphs", "_found")
