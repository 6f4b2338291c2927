"""Tables in the shared work folder, and the hash that folds are dealt by."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.session import work_dir


class Scratch:
    """Tables of one operator call below the shared folder of ``spark.checkpoint.dir``.

    A written table cuts the lineage: what was worked out survives the loss of executors, and
    later steps read only the columns they need.
    """

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.root = spark, work_dir(spark, purpose)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(path, True)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % folds


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front of it what no column of ``df`` is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
