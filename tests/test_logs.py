from datetime import datetime

import pytest

from colloquy.operators import (
    classify_lines,
    log_error_windows,
    log_runs,
    number_runs,
    parse_log,
    run_report,
    run_report_lines,
    scheduler_outcomes,
    step_duration_stats,
    step_pairs,
)
from colloquy.plans import analyse_logs
from colloquy.sources import read_job_log, read_log_lines

LOG = """\
Traceback (most recent call last):
2031-02-03 08:15:00,250 - INFO - run_all - ==== Gathering all transcripts
2031-02-03 08:15:02,000 - DEBUG - wrapper - Starting 'list'
2031-02-03 08:15:05,500 - DEBUG - wrapper - Completed 'list' in 3.25s
2031-02-03 08:15:05,750 - DEBUG - wrapper - Starting 'list'
2031-02-03 08:15:06,000 - DEBUG - wrapper - Starting 'ask'
2031-02-03 08:15:07,125 - WARNING - <module> - odd reply: [
"a - b - c"
]
2031-02-03T08:14:59.000007: On allowed public IP (198.51.100.7); running batch job.
2031-02-03 08:15:09,000 - ERROR - process - ERROR after ERROR
Nothing left to do.
2031-02-04T23:59:59.75: Not on allowed IP (198.51.100.8); aborting job.
2031-02-05T00:00:00: Main script exited with error code 4
2031-02-05 07:30:00,000 - INFO - run_all - ==== Gathering all transcripts
2031-02-05 07:30:01,000 - DEBUG - wrapper - Completed 'list' in 11.50s
2031-02-05 07:30:02,000 - DEBUG - wrapper - Starting 'don't stop'
2031-02-05T07:31:00.000001: Log notification email sent successfully.
2031-02-05T07:31:00.5: notify failed with code 9
2031-02-05T07:31:00.5: Failed to run notify: gone
2031-02-05T07:31:00.5: Failed to run main script: gone
""".splitlines()


@pytest.fixture(scope="module")
def lines(spark):
    rows = [("a.log", i, line) for i, line in enumerate(LOG, 1)]
    return spark.createDataFrame(rows, "log_file string, line_no long, line string")


def test_kinds_and_fields(lines):
    rows = {r.line_no: r for r in classify_lines(lines).collect()}
    assert [rows[i].kind[:2] for i in range(1, 22)] == (
        "pl st st st st st st pl pl sc st pl sc sc st st st sc sc sc sc".split()
    )
    assert rows[10].ts == datetime(2031, 2, 3, 8, 14, 59, 7)
    assert rows[4].ts == datetime(2031, 2, 3, 8, 15, 5, 500000)
    assert (rows[4].level, rows[4].func, rows[4].phase) == ("DEBUG", "wrapper", "complete")
    assert (rows[4].step, rows[4].seconds) == ("list", 3.25)
    assert rows[7].func == "<module>" and rows[7].message == "odd reply: ["
    assert rows[8].ts is None and rows[8].message == LOG[7]
    assert rows[17].step == "don't stop"
    assert rows[10].message == "On allowed public IP (198.51.100.7); running batch job."


def test_times_are_carried_forward(lines):
    rows = {r.line_no: r for r in parse_log(lines).collect()}
    assert rows[1].line_ts is None
    assert rows[8].line_ts == rows[9].line_ts == rows[7].ts
    # A scheduler line may be older than the line before it.
    assert rows[10].line_ts == datetime(2031, 2, 3, 8, 14, 59, 7) < rows[9].line_ts
    assert [rows[i].run for i in (1, 2, 14, 15, 21)] == [0, 1, 1, 2, 2]


def test_runs(lines):
    runs = {r.run: r for r in log_runs(number_runs(classify_lines(lines))).collect()}
    assert {n: (r.first_line, r.last_line, r.lines, r.errors) for n, r in runs.items()} == {
        0: (1, 1, 1, 0),
        1: (2, 14, 13, 1),
        2: (15, 21, 7, 0),
    }


def test_pairs(lines):
    pairs = step_pairs(number_runs(classify_lines(lines))).collect()
    got = {(p.run, p.step, p.n): (p.start_line, p.end_line, p.outcome) for p in pairs}
    assert got == {
        (1, "list", 1): (3, 4, "completed"),
        (1, "list", 2): (5, None, "unfinished"),
        (1, "ask", 1): (6, None, "unfinished"),
        (2, "list", 1): (None, 16, "unstarted"),
        (2, "don't stop", 1): (17, None, "unfinished"),
    }


def test_durations(lines):
    (row,) = step_duration_stats(classify_lines(lines)).collect()
    assert (row.step, row.calls, row.mean_seconds, row.max_seconds) == ("list", 2, 7.375, 11.5)
    assert (row.p50_seconds, row.p95_seconds) == (7.375, 11.0875)


def test_scheduler(lines):
    rows = scheduler_outcomes(classify_lines(lines)).collect()
    assert {(str(r.day), r.outcome): r.n for r in rows} == {
        ("2031-02-03", "started"): 1,
        ("2031-02-04", "refused"): 1,
        ("2031-02-05", "failed"): 2,
        ("2031-02-05", "mailed"): 1,
        ("2031-02-05", "mail_failed"): 2,
    }


@pytest.mark.parametrize("n", [6000, 50, 1])
def test_reports_from_text_and_from_lines_agree(spark, lines, n):
    text = "".join(f"{line}\n" for line in LOG)
    whole = run_report(spark.createDataFrame([(text,)], "text string"), n=n).first()
    by_line = run_report_lines(lines, n=n).first()
    assert whole.report == by_line.report and whole.errors == by_line.errors == 3
    assert whole.report == (
        "The transcript notes were completed with: 3 error(s).\n\n"
        f"---- Log Tail (last {n} characters) ----\n{text[-n:]}"
    )


def test_files(spark, tmp_path):
    (tmp_path / "one.log").write_text("\n".join(LOG) + "\n")
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "long.log").write_text("".join(f"line {i} {'x' * (i % 90)}\n" for i in range(5000)))
    whole = {r.log_file.split("/")[-1]: r.text for r in read_job_log(spark, str(tmp_path)).collect()}
    assert whole["one.log"] == "\n".join(LOG) + "\n"
    missing = read_job_log(spark, str(tmp_path / "none")).collect()
    assert [r.text for r in missing] == ["Job complete—no log file found!"]

    # Small splits, so that a file is read by many tasks.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = read_log_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        rows = sorted((r.log_file.split("/")[-1], r.line_no, r.line) for r in read.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [("long.log", i + 1, f"line {i} {'x' * (i % 90)}") for i in range(5000)]
    assert rows == want + [("one.log", i, line) for i, line in enumerate(LOG, 1)]


def test_analysis(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(LOG) + "\n")
    found = analyse_logs(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert {k: v.count() for k, v in found.items()} == {
        "runs": 3,
        "pairs": 5,
        "durations": 1,
        "scheduler": 5,
        "reports": 1,
    }


def test_windows(lines):
    rows = log_error_windows(classify_lines(lines), "1 hour", "10 minutes").collect()
    assert [(r.window_start, r.errors) for r in rows] == [(datetime(2031, 2, 3, 8), 1)]


@pytest.mark.parametrize("size", [1 << 27, 3000, 100])
def test_several_files_in_a_task_and_several_tasks_for_a_file(spark, tmp_path, size):
    for k in range(40):
        (tmp_path / f"{k}.log").write_text("".join(f"{k} {i}\n" for i in range(k * k % 37 * 10)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = read_log_lines(spark, str(tmp_path))
        got = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    found = {(r.line, r.line_no) for r in got}
    assert found == {(f"{k} {i}", i + 1) for k in range(40) for i in range(k * k % 37 * 10)} and len(got) == len(found)
