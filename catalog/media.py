"""Parts as media files and pages as paths."""

from pyspark.sql import functions as F

from colloquy.operators import (
    media_output_names,
    media_stream_counts,
    split_mode_filter,
    split_plan,
    video_only_plan,
)
from colloquy.plans import media_tasks
from colloquy.sources import read_probe

from .registry import query, table


def media(spark, sf):
    """Parts as media: size decides the number of streams, the type what is wrong with the probe."""
    audio = F.col("p_size") % 4
    streams = F.concat(
        F.lit('{"index":0,"codec_type":"video"}'),
        F.array_join(
            F.transform(
                F.when(audio > 0, F.sequence(F.lit(1), audio)).otherwise(F.array().cast("array<int>")),
                lambda i: F.concat(F.lit(',{"index":'), i, F.lit(',"codec_type":"audio"}')),
            ),
            "",
        ),
    )
    probe = (
        F.when(F.col("p_type") == "SMALL", "{}")
        .when(F.col("p_type") == "LARGE", F.concat(F.lit('{"streams":['), streams))
        .otherwise(F.concat(F.lit('{"streams":['), streams, F.lit("]}")))
    )
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.lit("in/"), "p_name", F.lit("."), F.col("p_partkey"), F.lit(".mp4")).alias("path"),
        probe.alias("probe_json"),
        "p_size",
        "p_brand",
        "p_type",
    )


GOOD = "p_type not in ('SMALL', 'LARGE')"


@query(
    f"""select p_partkey, {GOOD} as readable,
    case when {GOOD} then (p_size % 4 + 1)::varchar end as streams from part"""
)
def probe_streams(spark, sf):
    found = read_probe(media(spark, sf))
    return found.select(
        "p_partkey",
        F.col("streams").isNotNull().alias("readable"),
        F.when(F.col("streams").isNotNull(), F.size("streams").cast("string")).alias("streams"),
    )


@query(
    f"""select p_partkey, case when {GOOD} then (p_size % 4)::varchar end as audio_tracks,
    case when {GOOD} then '1' end as video_tracks from part"""
)
def stream_counts(spark, sf):
    counted = media_stream_counts(media(spark, sf))
    return counted.select(
        "p_partkey", *[F.col(c).cast("string").alias(c) for c in ("audio_tracks", "video_tracks")]
    )


# The text after the last '/', without its last extension unless only dots come before it.
STEM = r"regexp_replace(split_part(path, '/', -1), '^(\.*[^.].*)\.[^.]*$', '\1')"
PATHS = """
select page_id, page_id % 3 + 1 as track, case page_id % 4 when 0 then url
  when 1 then url || '/talk.' || page_id || '.mp4' when 2 then url || '/.hidden'
  else 'talk..' || page_id end as path
from pages"""


@query(
    rf"""select page_id, 'out/' || {STEM} || '_output_audio_track_' || track || '.mp3' as audio_file,
    'out/' || {STEM} || '_output_video_track_' || track || '.mp4' as video_file from ({PATHS})"""
)
def output_names(spark, sf):
    kind = F.col("page_id") % 4
    path = (
        F.when(kind == 0, F.col("url"))
        .when(kind == 1, F.concat("url", F.lit("/talk."), F.col("page_id"), F.lit(".mp4")))
        .when(kind == 2, F.concat("url", F.lit("/.hidden")))
        .otherwise(F.concat(F.lit("talk.."), F.col("page_id")))
    )
    audio, video = media_output_names(F.col("path"), F.col("page_id") % 3 + 1, "out/")
    return (
        table(spark, sf, "pages")
        .withColumn("path", path)
        .select("page_id", audio.alias("audio_file"), video.alias("video_file"))
    )


MODE = (
    "case p_partkey % 4 when 0 then 'Audio' when 1 then 'BOTH' when 2 then 'video' "
    "when 3 then 'both' end"
)


def mode():
    kind = F.col("p_partkey") % 4
    return (
        F.when(kind == 0, "Audio").when(kind == 1, "BOTH").when(kind == 2, "video").otherwise("both")
    )


@query(
    f"""select p_partkey, case when lower({MODE}) in ('audio', 'both') then lower({MODE}) end as mode,
    case when lower({MODE}) not in ('audio', 'both')
      then 'Invalid choice. Please enter ''audio'' or ''both''.' end as mode_error from part"""
)
def split_modes(spark, sf):
    modes = split_mode_filter(table(spark, sf, "part").select("p_partkey"), mode())
    return modes.select("p_partkey", "mode", "mode_error")


@query(
    f"""select p_partkey, t.track::int as track, lower({MODE}) as mode,
      'in/' || p_name || '.' || p_partkey || '_output_audio_track_' || t.track || '.mp3' as audio_file,
      case when lower({MODE}) = 'both' then 'in/' || p_name || '.' || p_partkey
        || '_output_video_track_' || t.track || '.mp4' end as video_file
    from part, unnest(range(1, p_size % 4 + 1)) t(track) where lower({MODE}) in ('audio', 'both')"""
)
def split_plans(spark, sf):
    plan = split_plan(media(spark, sf), F.col("p_size") % 4, mode(), "in")
    return plan.select("p_partkey", "track", "mode", "audio_file", "video_file")


@query(
    """select p_partkey, t.track::int as track,
    'out/output_video_only_track_' || t.track || '.mp4' as video_file
    from part, unnest(range(1, p_size % 3 + 1)) t(track)"""
)
def video_only_plans(spark, sf):
    plan = video_only_plan(table(spark, sf, "part"), F.col("p_size") % 3, "out")
    return plan.select("p_partkey", "track", "video_file")


@query(
    f"""select 'in/' || p_name || '.' || p_partkey || '.mp4' as path, 'both' as mode,
      t.track::int as track,
      'out/' || p_name || '.' || p_partkey || '_output_audio_track_' || t.track || '.mp3' as audio_file,
      'out/' || p_name || '.' || p_partkey || '_output_video_track_' || t.track || '.mp4' as video_file
    from part, unnest(range(1, p_size % 4 + 1)) t(track) where {GOOD}"""
)
def media_task_table(spark, sf):
    return media_tasks(media(spark, sf), F.lit("Both"), "out")
