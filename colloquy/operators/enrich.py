"""The call of a model per transcript: the one place where Python runs on the rows."""

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT = [
    T.StructField("attempts", T.IntegerType()),
    T.StructField("reply", T.StringType()),
    T.StructField("call_error", T.StringType()),
]


def check_reply(reply: str) -> None:
    """Raise where a reply is worth another try: broken JSON, or a title or date that is no text.

    A reply without any braces is final, and passes.
    """
    first, last = reply.find("{"), reply.rfind("}")
    if not 0 <= first < last:
        return
    summary = json.loads(reply[first : last + 1])
    for key in ("title", "date"):
        if not isinstance(summary.get(key, ""), str):
            raise TypeError(f"{key} is not a text")


def call_with_retry(fn, text, validate, retries, backoff, sleep):
    """(attempts, reply, error) of one transcript; waits grow by ``backoff`` per try."""
    if not text:
        return 0, None, None
    error = None
    for attempt in range(1, retries + 1):
        try:
            reply = fn(text)
            if validate is not None:
                validate(reply)
            return attempt, reply, None
        except Exception as raised:  # the callable is the user's and may raise anything
            error = str(raised)
            if attempt < retries:
                sleep(backoff * attempt)
    return retries, None, error


def enrich_with_retry(
    df: DataFrame,
    fn: Callable[[str], str],
    validate: Callable[[str], None] | None = check_reply,
    retries: int = 3,
    backoff: float = 10,
    sleep: Callable[[float], None] = time.sleep,
    concurrency: int = 5,
    partitions: int | None = None,
    rows_out: int = 50,
    keep: tuple[str, ...] = (),
    text: str = "text",
) -> DataFrame:
    """Call ``fn`` with every transcript: ``file_id, *keep, attempts, reply, call_error``.

    An empty transcript is not worth a call: it has no reply after 0 attempts. Both callables
    are shipped to the workers, where ``concurrency`` threads of a task call ``fn`` at once; the
    calls of a job are that times the tasks that run. Rows leave a task ``rows_out`` at a time.
    ``partitions`` deals the rows out by file id, so that a task and what its failure repeats stay
    small; without it the input's partitions are used. Only the columns that are needed travel to
    Python.
    """
    rows = df.select("file_id", *keep, F.col(text).alias("text"))
    if partitions:
        rows = rows.repartition(partitions, "file_id")
    schema = T.StructType([f for f in rows.schema if f.name != "text"] + RESULT)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(body):
            return call_with_retry(fn, body, validate, retries, backoff, sleep)

        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                for start in range(0, len(batch), rows_out):
                    part = batch.iloc[start : start + rows_out]
                    results = list(pool.map(one, part["text"]))
                    out = part.drop(columns="text")
                    out[[f.name for f in RESULT]] = pd.DataFrame(
                        results, columns=[f.name for f in RESULT], index=part.index
                    )
                    yield out

    return rows.mapInPandas(call, schema)
