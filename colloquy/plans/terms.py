"""Key terms of a collection that grows and whose files are replaced, batch by batch.

Each batch stores the counted terms of its own files, and what they change in the number of files that
have a term: one more for the terms of the new text, one less for those of the text that it takes the
place of. The old text is not read for that, its stored terms are. Sums over all batches give the
frequencies of a full run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.mining import counted_file_terms, weighted_terms
from ..skew import top_per_key
from ..sources.published import Attempt, read_published

COUNTED = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))
TERMS = T.StructType(
    [T.StructField("file_id", T.StringType()), T.StructField("terms", COUNTED), T.StructField("batch", T.StringType())]
)
# A row without a term counts the files.
DELTAS = T.StructType([T.StructField("term", T.StringType()), T.StructField("delta", T.LongType())])


def counted_terms(texts: DataFrame) -> DataFrame:
    """``file_id, terms``: how often each term occurs in each file, a row per file."""
    return counted_file_terms(texts.select("file_id", "text").repartition("file_id"))


def update_terms(spark: SparkSession, texts: DataFrame, out: str, batch: str) -> None:
    """Take in the files of a batch: ``file_id, text``, an id once; a null text takes a file's terms away.

    Names of batches sort in the order of the batches. A published batch cannot be taken in again,
    and what a failed one has left is not read.
    """
    attempt = Attempt(spark, out, batch)
    counted_terms(texts).write.parquet(attempt.folder("terms"))
    new = spark.read.schema(T.StructType(TERMS.fields[:2])).parquet(attempt.folder("terms"))
    # Of the old files only the names of their terms are moved.
    names = F.transform("terms", lambda t: t["term"]).alias("names")
    before = read_published(spark, out, "terms", TERMS).select("file_id", "batch", names)
    replaced = before.join(new.select("file_id"), "file_id", "left_semi")
    old = replaced.groupBy("file_id").agg(F.max_by("names", "batch").alias("names"))

    def change(files: DataFrame, by: int) -> DataFrame:
        terms = F.concat("names", F.array(F.lit(None).cast("string")))
        return files.select(F.explode(terms).alias("term"), F.lit(by).cast("long").alias("delta"))

    both = change(new.select(names), 1).union(change(old, -1)).groupBy("term").agg(F.sum("delta").alias("delta"))
    both.where(F.col("delta") != 0).write.parquet(attempt.folder("frequencies"))
    attempt.publish()


def stored_frequency(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """In how many files each term occurs, ``term, df``, and the number of files, ``n``."""
    sums = read_published(spark, out, "frequencies", DELTAS).groupBy("term").agg(F.sum("delta").alias("df"))
    files = sums.where(F.col("term").isNull()).agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"))
    return sums.where(F.col("term").isNotNull() & (F.col("df") > 0)), files


def stored_key_terms(spark: SparkSession, out: str, k: int) -> DataFrame:
    """``key_terms`` of all files as they are now, from the stored terms: no text is read.

    Every stored text is cut to its k terms first, so that what tells the latest one from those it has
    replaced moves k rows a text and not all of its terms.
    """
    stored = read_published(spark, out, "terms", TERMS)
    latest = stored.groupBy("file_id").agg(F.max("batch").alias("batch"))
    terms = stored.select("file_id", "batch", F.inline("terms"))
    frequency, files = stored_frequency(spark, out)
    scored = weighted_terms(terms, frequency, files.scalar()).select(
        "file_id", "batch", "term", F.round(F.col("tf") * F.col("idf"), 6).alias("score")
    )
    top = top_per_key(scored, ["file_id", "batch"], [F.desc("score"), F.asc("term")], k, "rank").alias("t")
    same = F.col("t.file_id").eqNullSafe(F.col("l.file_id")) & (F.col("t.batch") == F.col("l.batch"))
    return top.join(latest.alias("l"), same, "left_semi").drop("batch")
