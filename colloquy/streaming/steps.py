"""How long each step of a stream's batches took, and how many rows it had, as a table.

Steps of a batch are timed where they run, and their rows counted by the writing job itself. The
engine's own steps come from a listener. Each puts one small file per batch below the table's folder, so
a batch that is repeated leaves one entry, its last.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.published import put

STEPS = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("step", T.StringType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("rows", T.LongType()),
    ]
)


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """``run, batch, step, seconds, rows``."""
    return spark.read.schema(STEPS).option("recursiveFileLookup", "true").json(path)


class BatchSteps:
    """The steps of one batch; ``save`` puts them into the table."""

    def __init__(self, run: str, batch: int):
        self.run, self.batch, self.entries = run, batch, []

    @contextmanager
    def step(self, name: str, df: DataFrame) -> Iterator[DataFrame]:
        """Time what is done with the rows of ``df``, and count them as they pass."""
        counted, begun = Observation(), time.perf_counter()
        yield df.observe(counted, F.count(F.lit(1)).alias("rows"))
        self.add(name, time.perf_counter() - begun, counted.get["rows"])

    def add(self, name: str, seconds: float, rows: int) -> None:
        values = (self.run, self.batch, name, round(seconds, 6), rows)
        self.entries.append(dict(zip(STEPS.fieldNames(), values)))

    def save(self, spark: SparkSession, path: str, part: str) -> None:
        lines = "".join(json.dumps(entry) + "\n" for entry in self.entries)
        put(spark, f"{path}/{self.run}/{self.batch}-{part}.json", lines)


class StepListener(StreamingQueryListener):
    """Puts the engine's steps of each batch of one query into the table at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ended = spark, path, threading.Event()
        self.query: str | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if self.query in (None, str(progress.id)) and progress.numInputRows:
            steps = BatchSteps(str(progress.id), progress.batchId)
            for name, milliseconds in progress.durationMs.items():
                steps.add(name, milliseconds / 1000, progress.numInputRows)
            steps.save(self.spark, self.path, "engine")

    def onQueryTerminated(self, event) -> None:
        if self.query in (None, str(event.id)):
            self.ended.set()

    def finish(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Wait until the last batch of a query that has ended is in the table."""
        self.query = str(query.id)
        self.ended.wait(seconds)
        self.spark.streams.removeListener(self)
