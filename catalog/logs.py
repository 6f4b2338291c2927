"""The event table as job logs, rendered to lines and read back."""

from pyspark.sql import functions as F

from colloquy import work_dir
from colloquy.operators import (
    classify_lines,
    log_error_windows,
    log_runs,
    merged_durations,
    number_runs,
    parse_log,
    run_report_lines,
    scheduler_outcomes,
    step_duration_stats,
    step_pairs,
)

from colloquy.plans import store_durations, stored_durations

from .registry import query, table


def log_lines(spark, sf):
    """Events as lines of a log per type of user: ``log_file, line_no, line``.

    Sign-ups begin runs, views and clicks start and complete steps, errors are ERROR lines,
    and purchases are printed without a time.
    """
    events = table(spark, sf, "events")
    step = F.concat(F.lit("step"), F.col("event_id") % 3)
    seconds = F.format_string("%.2f", "value")
    kind = F.col("event_type")
    rest = (
        F.when(kind == "signup", F.lit("INFO - run_all - ==== Gathering all transcripts"))
        .when(kind == "view", F.concat(F.lit("DEBUG - wrapper - Starting '"), step, F.lit("'")))
        .when(
            kind == "click",
            F.concat(
                F.lit("DEBUG - wrapper - Completed '"), step, F.lit("' in "), seconds, F.lit("s")
            ),
        )
        .otherwise(F.concat(F.lit("ERROR - process - failed for user "), F.col("user_id")))
    )
    stamped = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - "), rest)
    plain = F.concat(F.lit("Found "), F.col("user_id"), F.lit(" transcript file(s)"))
    return events.select(
        F.concat(F.lit("log"), F.col("user_id") % 7).alias("log_file"),
        F.col("event_id").alias("line_no"),
        F.when(kind == "purchase", plain).otherwise(stamped).alias("line"),
    )


LINES_SQL = """
select 'log' || (user_id % 7) as log_file, event_id as line_no, event_type, value, user_id, ts,
  'step' || (event_id % 3) as step,
  case event_type when 'purchase' then 'Found ' || user_id || ' transcript file(s)'
  else strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' - ' || case event_type
    when 'signup' then 'INFO - run_all - ==== Gathering all transcripts'
    when 'view' then 'DEBUG - wrapper - Starting ''step' || (event_id % 3) || ''''
    when 'click' then 'DEBUG - wrapper - Completed ''step' || (event_id % 3) || ''' in '
      || printf('%.2f', value) || 's'
    else 'ERROR - process - failed for user ' || user_id end end as line
from events"""

MILLIS = "%Y-%m-%d %H:%M:%S.%g"


@query(
    f"""with l as ({LINES_SQL}) select log_file, line_no,
      case event_type when 'purchase' then 'plain' else 'structured' end as kind,
      case event_type when 'signup' then 'INFO' when 'purchase' then null when 'error' then 'ERROR'
        else 'DEBUG' end as level,
      case event_type when 'signup' then 'run_all' when 'purchase' then null
        when 'error' then 'process' else 'wrapper' end as func,
      case event_type when 'view' then 'start' when 'click' then 'complete' end as phase,
      case when event_type in ('view', 'click') then step end as step,
      case when event_type = 'click' then printf('%.2f', value) end as seconds,
      strftime(max(case when event_type <> 'purchase' then ts end) over previous, '{MILLIS}') as line_ts
    from l window previous as (partition by log_file order by line_no
      rows between unbounded preceding and current row)"""
)
def parse_logs(spark, sf):
    # The events are in order of time, so the last time so far is the latest.
    parsed = parse_log(log_lines(spark, sf))
    return parsed.select(
        "log_file",
        "line_no",
        "kind",
        "level",
        "func",
        "phase",
        "step",
        F.when(F.col("seconds").isNotNull(), F.format_string("%.2f", "seconds")).alias("seconds"),
        F.date_format("line_ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("line_ts"),
    )


RUNS_SQL = f"""
select *, sum(case when event_type = 'signup' then 1 else 0 end) over (
  partition by log_file order by line_no rows between unbounded preceding and current row)::bigint as run
from ({LINES_SQL})"""


@query(
    f"""select log_file, run, min(line_no) as first_line, max(line_no) as last_line,
      count(*) as lines, count(*) filter (where event_type = 'error') as errors,
      strftime(min(ts) filter (where event_type <> 'purchase'), '{MILLIS}') as started_at,
      strftime(max(ts) filter (where event_type <> 'purchase'), '{MILLIS}') as ended_at
    from ({RUNS_SQL}) group by log_file, run"""
)
def log_run_table(spark, sf):
    runs = log_runs(number_runs(classify_lines(log_lines(spark, sf))))
    return runs.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS") for c in ("started_at", "ended_at")}
    )


@query(
    f"""with m as (select *, row_number() over (
        partition by log_file, run, step, event_type order by line_no) as n
      from ({RUNS_SQL}) where event_type in ('view', 'click')),
    s as (select * from m where event_type = 'view'), e as (select * from m where event_type = 'click')
    select coalesce(s.log_file, e.log_file) as log_file, coalesce(s.run, e.run) as run,
      coalesce(s.step, e.step) as step, coalesce(s.n, e.n) as n,
      s.line_no::varchar as start_line, e.line_no::varchar as end_line,
      case when e.n is null then 'unfinished' when s.n is null then 'unstarted'
        else 'completed' end as outcome
    from s full join e on s.log_file = e.log_file and s.run = e.run and s.step = e.step and s.n = e.n"""
)
def step_pairing(spark, sf):
    numbered = number_runs(classify_lines(log_lines(spark, sf)))
    return step_pairs(numbered).select(
        "log_file",
        "run",
        "step",
        "n",
        F.col("start_line").cast("string").alias("start_line"),
        F.col("end_line").cast("string").alias("end_line"),
        "outcome",
    )


@query(
    f"""select step, count(*) as calls, round(avg(value), 4) as mean_seconds,
      round(quantile_cont(value, 0.5), 4) as p50_seconds,
      round(quantile_cont(value, 0.95), 4) as p95_seconds, max(value) as max_seconds
    from ({LINES_SQL}) where event_type = 'click' group by step"""
)
def step_durations(spark, sf):
    return step_duration_stats(classify_lines(log_lines(spark, sf)))


@query(
    f"""select step, count(*) as calls, round(avg(value), 4) as mean_seconds, max(value) as max_seconds,
      true as p50_close, true as p95_close from ({LINES_SQL}) where event_type = 'click' group by step"""
)
def daily_step_durations(spark, sf):
    """Durations over all days, from sketches that were stored in three batches; ranks are held against the lines."""
    out, logs = work_dir(spark, "durations"), classify_lines(log_lines(spark, sf))
    for lot in range(3):
        store_durations(logs.where(F.col("line_no") % 3 == lot), out, f"lot {lot}")
    merged = merged_durations(stored_durations(spark, out))
    timed = logs.where(F.col("seconds").isNotNull()).select("step", "seconds")
    quantiles = merged.select("step", "p50_seconds", "p95_seconds")

    def share(condition):
        return F.count_if(condition) / F.count("*")

    def close(name, rank):  # the asked rank lies between the shares of what is less and what is not more
        below, upto = share(F.col("seconds") < F.col(name)), share(F.col("seconds") <= F.col(name))
        return (below <= rank + 0.02) & (upto >= rank - 0.02)

    ranks = timed.join(quantiles, "step").groupBy("step").agg(
        close("p50_seconds", 0.5).alias("p50_close"), close("p95_seconds", 0.95).alias("p95_close")
    )
    return merged.drop("p50_seconds", "p95_seconds").join(ranks, "step")


@query(
    """select strftime(ts, '%Y-%m-%d') as day, case event_type when 'view' then 'started'
      when 'click' then 'completed' when 'error' then 'refused' when 'signup' then 'mailed'
      else 'failed' end as outcome, count(*) as n
    from events group by all"""
)
def scheduler_days(spark, sf):
    events = table(spark, sf, "events")
    kind = F.col("event_type")
    message = (
        F.when(kind == "view", "On allowed public IP (10.0.0.1); running batch job.")
        .when(kind == "click", "Main script completed successfully.")
        .when(kind == "error", "Not on allowed IP (10.0.0.2); aborting job.")
        .when(kind == "signup", "Log notification email sent successfully.")
        .otherwise("Main script exited with error code 1")
    )
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit(": "), message)
    counted = scheduler_outcomes(classify_lines(events.select(line.alias("line"))))
    return counted.withColumn("day", F.col("day").cast("string"))


@query(
    f"""select log_file, sum(len(regexp_extract_all(line, 'ERROR')))::bigint as errors,
      md5('The transcript notes were completed with: '
        || sum(len(regexp_extract_all(line, 'ERROR')))::bigint || ' error(s).' || chr(10) || chr(10)
        || '---- Log Tail (last 6000 characters) ----' || chr(10)
        || right(string_agg(line || chr(10), '' order by line_no), 6000)) as report_md5
    from ({LINES_SQL}) group by log_file"""
)
def line_reports(spark, sf):
    reports = run_report_lines(log_lines(spark, sf))
    return reports.select("log_file", "errors", F.md5("report").alias("report_md5"))


@query(
    """select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as errors
    from events where event_type = 'error' group by all"""
)
def error_windows(spark, sf):
    windows = log_error_windows(
        table(spark, sf, "events"), "1 day", "2 hours", F.col("event_type") == "error"
    )
    return windows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "errors")
