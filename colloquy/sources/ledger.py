"""The ledger as an append-only CSV table."""

from pyspark.sql import DataFrame, SparkSession

from ..schemas import LEDGER
from .published import attempts, names, published_folders
from .records import read_csv_records

# The error text may hold quotes, commas and line breaks. Empty text stays empty text.
CSV = {
    "header": "true",
    "multiLine": "true",
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _paths(spark: SparkSession, path: str) -> list[str] | None:
    """What of the ledger counts, or None if it has no batches: rows that were appended and
    those of published batches. What an unfinished batch has left does not count."""
    root, slash, table = path.rstrip("/").rpartition("/")
    root = root if slash else "."
    if not attempts(spark, root) and not any(n.startswith("batch=") for n in names(spark, path)):
        return None
    return [f"{path}/{n}" for n in names(spark, path) if n.endswith(".csv")] + published_folders(spark, root, table)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All ledger rows; every column is text, and a missing value is the empty text.

    Each file is read by one task; ``scan_ledger`` reads files of any size.
    """
    paths = _paths(spark, path)
    if paths == []:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).options(**CSV).csv(path if paths is None else paths).na.fill("")


def scan_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``read_ledger``, from ledger files of any size: a file is read by many tasks."""
    paths = _paths(spark, path)
    if paths == []:
        return spark.createDataFrame([], LEDGER)
    return read_csv_records(spark, path if paths is None else paths, LEDGER, CSV).na.fill("")


def append_ledger(df: DataFrame, path: str) -> None:
    """Add rows to the ledger; what is there is neither read nor written again."""
    df.select(LEDGER.fieldNames()).write.mode("append").options(**CSV).csv(path)
