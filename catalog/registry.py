"""Registration of queries, and views of the given tables in the package's layouts."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import configure
from colloquy.schemas import DOCUMENT_MIME

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that gives the same rows."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(configure(spark), sf)

        QUERIES[fn.__name__] = run
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """``documents`` as transcripts: the source is the user's folder."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("file_id"),
        F.concat(F.lit("talk "), F.col("doc_id")).alias("file_name"),
        F.col("source").alias("user_folder_id"),
        F.when(F.col("lang") == "en", DOCUMENT_MIME).otherwise("text/plain").alias("mime_type"),
        "lang",
        "n_chars",
        "doc_id",
        "text",
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """``conversations`` as turns: the role is the speaker."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("file_id"),
        "turn",
        F.col("role").alias("speaker"),
        "text",
    )


BREAKS = (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def escaped(text: Column, breaks=BREAKS) -> Column:
    """Text as it stands between the quotes of a JSON string; without ``breaks``, line
    breaks are left as they are."""
    for plain, written in (("\\", "\\\\"), ('"', '\\"'), *breaks):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


# The same in SQL, for a column named text.
ESCAPED = (
    r"""replace(replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), """
    r"""chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"""
)

# Sentences and words as the package cuts them, for a column named text.
SENTENCES = (
    r"list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), "
    r"lambda s: trim(s)), lambda s: s <> '')"
)
