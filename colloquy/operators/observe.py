"""Counts taken while a job runs."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observe_batch(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, and counts of them that are ready after the first action.

    The counts come with the job's own pass over the data; no second scan is made.
    """
    observation = Observation(name)
    counts = [F.count(F.lit(1)).alias("rows")]
    if "status" in df.columns:
        counts += [
            F.count_if(F.col("status") == "success").alias("succeeded"),
            F.count_if(F.col("status") == "failed").alias("failed"),
        ]
    return df.observe(observation, *counts), observation
