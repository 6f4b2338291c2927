"""Logs that grow: run numbers, carried times and places in a run, with a state per log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.logs import classify_lines, run_starts

ADDED = [
    T.StructField("run", T.LongType()),
    T.StructField("line_ts", T.TimestampNTZType()),
    T.StructField("n", T.LongType()),
    T.StructField("late", T.BooleanType()),
]
# The last line, the run, the carried time in microseconds, and how often each phase of a step was in the run.
STATE = T.StructType(
    [
        T.StructField("line_no", T.LongType()),
        T.StructField("run", T.LongType()),
        T.StructField("micros", T.LongType()),
        T.StructField("phases", T.MapType(T.StringType(), T.LongType())),
    ]
)


def number_stream(lines: DataFrame, start: Column | None = None) -> DataFrame:
    """The rows of ``parse_log`` as a stream, with ``n`` and ``late``.

    ``lines`` is a stream of ``log_file, line_no, line``. ``n`` counts the starts, or the completions, of a step
    within its run: the n-th start belongs to the n-th completion. State is kept per log: the last line,
    the run, the carried time and the counts of the current run's steps. The lines of a log have to
    come in order from batch to batch; within a batch they may be in any order and are held together,
    so limit the files of a batch. A line that comes after later ones of its log is numbered as if
    it were the next one, and ``late``.
    """
    typed = classify_lines(lines).withColumn("_start", run_starts(start))
    columns = [c for c in typed.columns if c != "_start"]
    schema = T.StructType([typed.schema[c] for c in columns] + ADDED)

    def number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run, micros, phases = state.get if state.exists else (None, 0, None, {})
        phases = dict(phases)
        rows = pd.concat(list(batches)).sort_values("line_no", kind="stable")
        added = []
        for line_no, begins, ts, step, phase in zip(rows["line_no"], rows["_start"], rows["ts"], rows["step"], rows["phase"]):
            late = last is not None and line_no <= last
            last = line_no if last is None else max(last, line_no)
            if begins:
                run, phases = run + 1, {}
            if not pd.isna(ts):
                micros = pd.Timestamp(ts).value // 1000
            n = None
            if phase is not None:
                place = f"{phase} {step}"
                n = phases[place] = phases.get(place, 0) + 1
            added.append((run, None if micros is None else pd.Timestamp(micros, unit="us"), n, bool(late)))
        state.update((int(last), int(run), micros, phases))
        out = rows[columns].reset_index(drop=True)
        more = pd.DataFrame(added, columns=[f.name for f in ADDED])
        out["run"], out["late"] = more["run"].astype("int64"), more["late"]
        out["line_ts"] = pd.to_datetime(more["line_ts"])
        out["n"] = more["n"].astype("Int64")
        yield out

    return typed.groupBy("log_file").applyInPandasWithState(
        number, schema, STATE, "append", GroupStateTimeout.NoTimeout
    )


def numbered_pairs(numbered: DataFrame) -> DataFrame:
    """``step_pairs`` of the stored lines of ``number_stream``: their places are known already."""
    keys, start, complete = ["log_file", "run", "step"], F.col("phase") == "start", F.col("phase") == "complete"
    pairs = numbered.where(F.col("phase").isNotNull()).groupBy(*keys, "n").agg(
        F.max(F.when(start, F.col("line_no"))).alias("start_line"),
        F.max(F.when(complete, F.col("line_no"))).alias("end_line"),
        F.max("seconds").alias("seconds"),
    )
    unfinished, unstarted = F.col("end_line").isNull(), F.col("start_line").isNull()
    return pairs.withColumn("outcome", F.when(unfinished, "unfinished").when(unstarted, "unstarted").otherwise("completed"))
