"""Stream lists written by a media probe."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json import STRICT
from ..schemas import PROBE


def read_probe(df: DataFrame, col: str = "probe_json") -> DataFrame:
    """Adds ``streams``; null where the text is no JSON object or lacks the key."""
    return df.withColumn("streams", F.from_json(F.col(col), PROBE, STRICT)["streams"])
