"""Logs that grow, step times, and durations added up over days."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.operators import (
    classify_lines,
    enrich_with_retry,
    log_runs,
    merged_durations,
    number_runs,
    parse_log,
    step_pairs,
)
from colloquy.plans import store_durations, stored_durations
from colloquy.schemas import RUN_START
from colloquy.streaming import incremental_ingest, ledger_stream, number_stream, numbered_pairs, read_steps, run_available

from test_logs import LOG

LINES = "log_file string, line_no long, line string"


def lines_of(n, seed):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        at = f"2031-02-0{1 + i * 8 // n} 08:{i // 60 % 60:02}:{i % 60:02},{rng.randrange(1000):03} - "
        step = rng.choice("ab")
        made.append(
            rng.choice(
                [
                    f"{at}INFO - run_all - {RUN_START} again",
                    f"{at}DEBUG - w - Starting '{step}'",
                    f"{at}DEBUG - w - Starting '{step}'",
                    f"{at}DEBUG - w - Completed '{step}' in {rng.randrange(900) / 100:.2f}s",
                    f"{at}ERROR - w - bad",
                    "printed",
                ]
            )
        )
    return made


def fed(spark, tmp_path, logs, cuts):
    """The rows of ``logs`` (name -> lines) through the stream, a batch and a start for each range of lines."""
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(name, i, line) for name, own in logs.items() for i, line in enumerate(own, 1)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        some = [r for r in rows if a <= r[1] < b]
        random.Random(a).shuffle(some)
        spark.createDataFrame(some, LINES).write.mode("append").parquet(inbox)
        run_available(number_stream(spark.readStream.schema(LINES).parquet(inbox)), out, str(tmp_path / "cp"))
    return spark.createDataFrame(rows, LINES), spark.read.parquet(out)


def rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_five_batches_give_the_batch_tables(spark, tmp_path):
    logs = {"a.log": LOG, "b.log": lines_of(120, 1), "c.log": lines_of(90, 2)}
    plain, numbered = fed(spark, tmp_path, logs, [1, 9, 10, 40, 80, 1000])
    typed = classify_lines(plain)
    columns = parse_log(plain).columns
    assert rows(numbered, columns) == rows(parse_log(plain), columns)
    assert rows(log_runs(numbered), ["*"]) == rows(log_runs(number_runs(typed)), ["*"])
    names = ["log_file", "run", "step", "n", "start_line", "end_line", "seconds", "outcome"]
    assert rows(numbered_pairs(numbered), names) == rows(step_pairs(number_runs(typed)), names)
    assert numbered.where("late").count() == 0


def test_a_line_that_comes_late_is_marked(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    own = lines_of(20, 3)
    for numbers in ([1, 2, 5], [3, 6], [4]):
        spark.createDataFrame([("a", i, own[i]) for i in numbers], LINES).write.mode("append").parquet(inbox)
        run_available(number_stream(spark.readStream.schema(LINES).parquet(inbox)), out, str(tmp_path / "cp"))
    got = {r.line_no: r.late for r in spark.read.parquet(out).collect()}
    assert got == {1: False, 2: False, 5: False, 3: True, 6: False, 4: True}


def test_durations_of_days_and_batches(spark, tmp_path):
    rng, out = random.Random(8), str(tmp_path / "out")
    values = {"a": [round(rng.expovariate(1), 2) for _ in range(6000)], "b": [1.5] * 50}
    made = [(f"2031-02-0{rng.randrange(1, 9)} 08:00:00,000 - DEBUG - w - Completed '{s}' in {v:.2f}s", s) for s, own in values.items() for v in own]
    rng.shuffle(made)
    for k in range(4):
        part = [("log", i, line) for i, (line, _) in enumerate(made) if i % 4 == k]
        store_durations(classify_lines(spark.createDataFrame(part, LINES)), out, f"b{k}")
    with pytest.raises(FileExistsError):  # a batch counts once
        store_durations(classify_lines(spark.createDataFrame([("log", 1, made[0][0])], LINES)), out, "b0")
    daily = stored_durations(spark, out)
    assert daily.select("day").distinct().count() == 8
    for r in merged_durations(daily).collect():
        own = sorted(values[r.step])
        assert (r.calls, r.max_seconds, r.mean_seconds) == (len(own), own[-1], pytest.approx(sum(own) / len(own), abs=1e-4))
        for q, rank in ((r.p50_seconds, 0.5), (r.p95_seconds, 0.95)):
            assert sum(x < q for x in own) / len(own) <= rank + 0.02 and sum(x <= q for x in own) / len(own) >= rank - 0.02


def test_steps_of_every_batch(spark, tmp_path):
    schema = "file_id string, file_name string, user_folder_id string, text string"
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")

    def model(text):
        return "no" if text == "bad" else '{"title": "t", "date": "2024"}'

    def run():
        stream = incremental_ingest(spark, inbox, "parquet", spark.createDataFrame([], schema).schema, maxFilesPerTrigger="1")
        enrich = lambda b: enrich_with_retry(b, model, backoff=0, keep=("file_name", "user_folder_id"))
        ledger_stream(stream, enrich, out, str(tmp_path / "cp"), F.lit("t"), steps=f"{out}/steps")

    for lot in ([("1", "a"), ("2", "bad")], [("3", "b")]):
        frame = spark.createDataFrame([(i, "n", "u", t) for i, t in lot], schema)
        frame.coalesce(1).write.mode("append").parquet(inbox)
    run()
    spark.createDataFrame([(str(i), "n", "u", "x") for i in range(10, 14)], schema).coalesce(1).write.mode("append").parquet(inbox)
    run()
    steps = read_steps(spark, f"{out}/steps").collect()
    ledger = spark.read.parquet(f"{out}/ledger").groupBy("run_id", "batch_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("ok"))
    assert ledger.count() == 3
    for r in ledger.collect():
        own = {s.step: s for s in steps if (s.run, s.batch) == (r.run_id, r.batch_id)}
        assert (own["replies"].rows, own["ledger"].rows, own["summaries"].rows) == (r.n, r.n, r.ok)
        assert own["addBatch"].seconds >= own["replies"].seconds + own["ledger"].seconds
        assert all(s.seconds >= 0 for s in own.values()) and "triggerExecution" in own
    assert len({(s.run, s.batch, s.step) for s in steps}) == len(steps)
