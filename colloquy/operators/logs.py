"""Job logs: typed lines, runs, step times, reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import error_count, log_tail
from ..schemas import REPORT_HEAD, REPORT_RULE, RUN_START
from ..skew import computed_once, running

# The line formats of the log.
STRUCTURED = r"^[0-9-]{10} [0-9:]{8},[0-9]{3} - [A-Z]+ - \S+ - "
SCHEDULER = r"^[0-9-]{10}T[0-9:]{8}(\.[0-9]{1,6})?: "
STARTING = r"^Starting '(.*)'$"
COMPLETED = r"^Completed '(.*)' in ([0-9]+\.[0-9]{2})s$"

# How the scheduler words what happened. The first pattern that fits counts.
OUTCOMES = {
    "started": r"^On allowed .*; running batch job\.$",
    "refused": r"^(Not on allowed .*|Could not retrieve public IP); aborting job\.$",
    "check_failed": r"^IP check failed: ",
    "completed": r"^Main script completed successfully\.$",
    "failed": r"^(Main script exited with error code |Failed to run main script: )",
    "mailed": r"^Log notification email sent successfully\.$",
    "mail_failed": r"^(\S+ failed with code |Failed to run )",
}


def classify_lines(lines: DataFrame) -> DataFrame:
    """Adds ``kind, ts, level, func, message, step, phase, seconds`` to lines of a log."""
    kind = (
        F.when(F.regexp_like("line", F.lit(STRUCTURED)), "structured")
        .when(F.regexp_like("line", F.lit(SCHEDULER)), "scheduler")
        .otherwise("plain")
    )
    structured, scheduler = F.col("kind") == "structured", F.col("kind") == "scheduler"
    # No field before the message can hold the text between the fields.
    parts = F.when(structured, F.split("line", " - ", 4)).when(
        scheduler, F.split("line", ": ", 2)
    )
    cut = lines.withColumn("kind", kind).withColumn("_parts", parts)
    part = F.col("_parts")
    message = F.when(structured, part[3]).when(scheduler, part[1]).otherwise(F.col("line"))
    worded = cut.withColumn("message", message)
    starting = structured & F.startswith("message", F.lit("Starting '"))
    completed = structured & F.startswith("message", F.lit("Completed '"))
    phase = F.when(starting & F.regexp_like("message", F.lit(STARTING)), "start").when(
        completed & F.regexp_like("message", F.lit(COMPLETED)), "complete"
    )
    phased = worded.withColumn("phase", phase)
    start, complete = F.col("phase") == "start", F.col("phase") == "complete"
    return computed_once(
        phased,
        [*lines.columns, "kind", "message", "phase"],
        {
            "ts": F.translate(part[0], ",", ".").try_cast("timestamp_ntz"),
            "level": F.when(structured, part[1]),
            "func": F.when(structured, part[2]),
            "step": F.when(start, F.regexp_extract("message", STARTING, 1)).when(
                complete, F.regexp_extract("message", COMPLETED, 1)
            ),
            # Two decimals, as the log writes them.
            "seconds": F.when(complete, F.regexp_extract("message", COMPLETED, 2)).try_cast(
                "double"
            ),
        },
    )


def run_starts(start: Column | None) -> Column:
    """1 for a line that begins a run, else 0."""
    begins = F.startswith(F.col("message"), F.lit(RUN_START)) if start is None else start
    return F.when(begins, 1).otherwise(0)


def parse_log(lines: DataFrame, start: Column | None = None) -> DataFrame:
    """Typed lines, each with its ``run`` and ``line_ts``: its own time, else that of the line
    before it.

    Needs ``log_file, line_no, line``. The lines are moved once for both.
    """
    return running(
        classify_lines(lines),
        ["log_file"],
        "line_no",
        sums={"run": run_starts(start)},
        lasts={"line_ts": F.col("ts")},
    )


def log_runs(numbered: DataFrame, error: Column | None = None) -> DataFrame:
    """One row per run: number, first and last line, time span, lines and errors.

    ``numbered`` has the run of each line, as ``parse_log`` and ``number_runs`` give it.
    """
    is_error = F.col("level") == "ERROR" if error is None else error
    return numbered.groupBy("log_file", "run").agg(
        F.min("line_no").alias("first_line"),
        F.max("line_no").alias("last_line"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        F.count("*").alias("lines"),
        F.count_if(is_error).alias("errors"),
    )


def number_runs(logs: DataFrame, start: Column | None = None) -> DataFrame:
    """Adds ``run``, the number of run starts up to and including the line.

    A line where ``start`` holds begins a run; lines before the first start are run 0.
    """
    return running(logs, ["log_file"], "line_no", sums={"run": run_starts(start)})


def step_pairs(logs: DataFrame) -> DataFrame:
    """Starts and completions of each step, the n-th with the n-th, per log and run.

    The log names no thread, so this is the only pairing it supports. ``outcome`` is
    'completed', or 'unfinished' and 'unstarted' for what is left over.
    """
    keys = ["log_file", "run", "step"]
    marks = logs.where(F.col("phase").isNotNull()).select(*keys, "phase", "line_no", "seconds")
    counted = running(marks, [*keys, "phase"], "line_no", sums={"n": F.lit(1)})
    start, complete = F.col("phase") == "start", F.col("phase") == "complete"
    # There is one start and one completion per number, so an aggregate brings them together.
    pairs = counted.groupBy(*keys, "n").agg(
        F.max(F.when(start, F.col("line_no"))).alias("start_line"),
        F.max(F.when(complete, F.col("line_no"))).alias("end_line"),
        F.max("seconds").alias("seconds"),
    )
    return pairs.withColumn(
        "outcome",
        F.when(F.col("end_line").isNull(), "unfinished")
        .when(F.col("start_line").isNull(), "unstarted")
        .otherwise("completed"),
    )


def step_duration_stats(logs: DataFrame) -> DataFrame:
    """Count, mean, median, 95th percentile and maximum of the seconds of each step.

    Equal durations are counted first. The log writes two decimals, so what is left of a
    step is at most a hundred values per second of its longest duration, and the exact
    percentiles are taken over those.
    """
    seconds = F.round("seconds", 2)
    values = (
        logs.where(F.col("seconds").isNotNull())
        .groupBy("step", seconds.alias("seconds"))
        .agg(F.count("*").alias("n"))
    )
    return values.groupBy("step").agg(
        F.sum("n").alias("calls"),
        F.round(F.sum(F.col("seconds") * F.col("n")) / F.sum("n"), 4).alias("mean_seconds"),
        F.round(F.percentile("seconds", 0.5, F.col("n")), 4).alias("p50_seconds"),
        F.round(F.percentile("seconds", 0.95, F.col("n")), 4).alias("p95_seconds"),
        F.max("seconds").alias("max_seconds"),
    )


def daily_durations(logs: DataFrame, k: int = 400) -> DataFrame:
    """Durations of each step and day as a row that can be added to others: ``day, step, calls, total,
    longest, sketch``.

    ``sketch`` is a quantile sketch whose ranks are right to about 2.7 / ``k``, however much was added up.
    """
    timed = logs.where(F.col("seconds").isNotNull())
    return timed.groupBy(F.to_date("ts").alias("day"), "step").agg(
        F.count("*").alias("calls"),
        F.sum("seconds").alias("total"),
        F.max("seconds").alias("longest"),
        F.kll_sketch_agg_double(F.col("seconds").cast("double"), k).alias("sketch"),
    )


def merged_durations(daily: DataFrame) -> DataFrame:
    """``step_duration_stats`` over any choice of days, from the rows of ``daily_durations``; no log is read.

    The percentiles are values whose rank is within the sketches' error of the one asked for.
    """
    steps = daily.groupBy("step").agg(
        F.sum("calls").alias("calls"),
        F.round(F.sum("total") / F.sum("calls"), 4).alias("mean_seconds"),
        F.max("longest").alias("max_seconds"),
        F.kll_merge_agg_double("sketch").alias("_sketch"),
    )
    half, most = (F.kll_sketch_get_quantile_double("_sketch", F.lit(rank)) for rank in (0.5, 0.95))
    return steps.select("step", "calls", "mean_seconds", half.alias("p50_seconds"), most.alias("p95_seconds"), "max_seconds")


def scheduler_outcomes(logs: DataFrame) -> DataFrame:
    """What the scheduler reports, counted per day: ``day, outcome, n``."""
    outcome = F.lit("other")
    for name, pattern in reversed(OUTCOMES.items()):
        outcome = F.when(F.regexp_like("message", F.lit(pattern)), name).otherwise(outcome)
    return (
        logs.where(F.col("kind") == "scheduler")
        .groupBy(F.to_date("ts").alias("day"), outcome.alias("outcome"))
        .agg(F.count("*").alias("n"))
    )


def _report_text(errors: Column, tail: Column, n: int) -> Column:
    head, rule = REPORT_HEAD.split("%s"), REPORT_RULE.split("%s")
    return F.concat(
        F.lit(head[0]),
        errors.cast("string"),
        F.lit(head[1] + rule[0] + str(n) + rule[1]),
        tail,
    )


def run_report(df: DataFrame, needle: str = "ERROR", n: int = 6000) -> DataFrame:
    """Report text of each whole log: adds ``errors`` and ``report``."""
    return df.withColumn("errors", error_count(F.col("text"), needle)).withColumn(
        "report", _report_text(F.col("errors"), log_tail(F.col("text"), n), n)
    )


def run_report_lines(lines: DataFrame, needle: str = "ERROR", n: int = 6000) -> DataFrame:
    """The same report from numbered lines, for logs too long for one cell.

    Lines are numbered without gaps and each ends with a line break, so the last n characters
    lie in the last n lines, and only their last n characters matter. An occurrence never spans
    lines. Nothing of a log is sorted but those lines.
    """
    counts = lines.groupBy("log_file").agg(
        F.sum(error_count(F.col("line"), needle)).alias("errors"),
        F.max("line_no").alias("_end"),
    )
    ends = lines.select("log_file", "line_no", log_tail(F.col("line"), n).alias("line"))
    last = ends.join(counts.select("log_file", "_end"), "log_file").where(F.col("line_no") > F.col("_end") - n)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    tails = last.groupBy("log_file").agg(
        F.concat(
            F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("\n")
        ).alias("tail")
    )
    return counts.join(tails, "log_file").select(
        "log_file",
        "errors",
        _report_text(F.col("errors"), log_tail(F.col("tail"), n), n).alias("report"),
    )


def log_error_windows(
    logs: DataFrame, width: str, delay: str, error: Column | None = None
) -> DataFrame:
    """ERROR lines per tumbling window, for a table or a stream: ``window_start, errors``.

    A stream gives each window once, when no line of it is expected any more: time goes on with
    every line that has one, whether it is an error or not.
    """
    is_error = F.col("level") == "ERROR" if error is None else error
    stamped = logs.select(F.col("ts").cast("timestamp").alias("ts"), is_error.alias("is_error"))
    return (
        stamped.where(F.col("ts").isNotNull())
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"))
        .agg(F.count_if("is_error").alias("errors"))
        .where(F.col("errors") > 0)
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "errors",
        )
    )
