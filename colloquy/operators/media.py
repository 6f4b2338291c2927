"""Media files: streams and split plans. The codec itself is not part of this."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import AUDIO_NAME, BAD_MODE, SPLIT_MODES, VIDEO_NAME, VIDEO_ONLY_NAME
from ..sources.probe import read_probe


def media_stream_counts(df: DataFrame, col: str = "probe_json") -> DataFrame:
    """Adds ``audio_tracks`` and ``video_tracks``; null where the probe text is no stream list.

    A stream without a type makes both null, as one that cannot be counted.
    """
    probed = read_probe(df, col)
    untyped = F.exists("streams", lambda s: s["codec_type"].isNull())

    def count(kind: str) -> Column:
        chosen = F.filter("streams", lambda s: s["codec_type"] == kind)
        return F.when(F.col("streams").isNotNull() & ~untyped, F.size(chosen))

    return probed.withColumns(
        {"audio_tracks": count("audio"), "video_tracks": count("video")}
    ).drop("streams")


def base_name(path: Column) -> Column:
    """File name without its folders and its last extension; leading dots are no extension."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?s)^(\.*[^.].*)\.[^.]*$", "$1")


def _numbered(form: str, track: Column) -> Column:
    before, after = form.split("%s")
    return F.concat(F.lit(before), track.cast("string"), F.lit(after))


def media_output_names(path: Column, track: Column, directory: str | None = None):
    """(audio file, video file) that track number ``track`` is written to."""

    def name(form: str) -> Column:
        file = F.concat(base_name(path), _numbered(form, track))
        return F.concat(F.lit(directory.rstrip("/") + "/"), file) if directory else file

    return name(AUDIO_NAME), name(VIDEO_NAME)


def split_mode_filter(df: DataFrame, mode: Column) -> DataFrame:
    """Adds ``mode`` in lower case; a mode other than audio or both goes to ``mode_error``."""
    lowered = F.lower(mode)
    known = F.coalesce(lowered.isin(*SPLIT_MODES), F.lit(False))
    return df.withColumn("mode", F.when(known, lowered)).withColumn(
        "mode_error", F.when(~known, F.lit(BAD_MODE))
    )


def _tracks(n: Column) -> Column:
    # sequence(1, 0) would count down.
    return F.explode(F.when(n >= 1, F.sequence(F.lit(1), n.cast("int"))))


def split_plan(df: DataFrame, n: Column, mode: Column, directory: str | None = None) -> DataFrame:
    """One row per audio track to write, with the video file too in mode 'both'."""
    audio, video = media_output_names(F.col("path"), F.col("track"), directory)
    both = F.lower(mode) == "both"
    planned = split_mode_filter(df, mode).where(F.col("mode").isNotNull())
    return (
        planned.withColumn("track", _tracks(n))
        .withColumn("audio_file", audio)
        .withColumn("video_file", F.when(both, video))
        .drop("mode_error")
    )


def video_only_plan(df: DataFrame, n: Column, directory: str | None = None) -> DataFrame:
    """One row per video track to write without sound."""
    file = _numbered(VIDEO_ONLY_NAME, F.col("track"))
    if directory:
        file = F.concat(F.lit(directory.rstrip("/") + "/"), file)
    return df.withColumn("track", _tracks(n)).withColumn("video_file", file)
