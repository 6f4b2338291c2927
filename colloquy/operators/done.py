"""Which listed files may be done already, from a Bloom filter that each ledger batch adds to.

A listing has every file that ever was; what is new in it is little. The filter says of most new files
for certain that they are new, so only the others meet the ledger. It is a table of ``buckets`` bitmaps
of 32,768 bits each; an id's hash names its bucket, and ``HASHES`` further ones its bits there, so an id looks
at one row. Batches store their own bitmaps, which are merged by "or". About 2,000 ids a bucket leave one
new file in a thousand to the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.published import Attempt, read_published
from .crosscheck import unprocessed

BITS = 32_768  # of a bitmap, as Spark's bitmap functions have it
HASHES = 4
BUCKETS = 4096
DONE = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("bits", T.BinaryType())])


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def _places(key: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(j)), F.lit(BITS)) for j in range(1, HASHES + 1)])


def _has(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte.cast("long"), (place % 8).cast("int")) == 1


def done_bits(ledger: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, bits`` of the files that the rows of a ledger show as done."""
    ids = ledger.where((F.col("status") == "success") & F.col("original_file_id").isNotNull())
    key = F.col("original_file_id")
    places = ids.select(_bucket(key, buckets).alias("bucket"), F.explode(_places(key)).alias("place"))
    return places.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def add_done(ledger: DataFrame, out: str, batch: str, buckets: int = BUCKETS) -> None:
    """Store the bitmaps of a batch's ledger rows below ``out``, once per batch."""
    attempt = Attempt(ledger.sparkSession, out, batch)
    done_bits(ledger, buckets).write.parquet(attempt.folder("done"))
    attempt.publish(buckets=buckets)


def merged_done(spark: SparkSession, out: str) -> DataFrame:
    """The filter over all batches."""
    return read_published(spark, out, "done", DONE).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def maybe_done(listed: DataFrame, done: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``maybe_done``: false for files that are in no batch for certain."""
    key = F.col("file_id")
    bits = done.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    met = listed.withColumn("_bucket", _bucket(key, buckets)).join(bits, "_bucket", "left")
    found = F.forall(_places(key), lambda place: _has(F.col("_bits"), place))
    return met.withColumn("maybe_done", F.coalesce(key.isNotNull() & found, F.lit(False))).select(*listed.columns, "maybe_done")


def unprocessed_by_filter(listed: DataFrame, done: DataFrame, ledger: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``unprocessed``: what the filter does not know is new, the rest is held against the ledger."""
    tested = maybe_done(listed, done, buckets)
    new = tested.where(~F.col("maybe_done")).select(listed.columns)
    return new.unionByName(unprocessed(tested.where("maybe_done").select(listed.columns), ledger))
