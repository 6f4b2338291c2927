"""Probe tables to the files a codec has to write."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.media import media_stream_counts, split_plan


def media_tasks(media: DataFrame, mode: Column, directory: str) -> DataFrame:
    """One row per audio track of every file whose probe text can be read."""
    counted = media_stream_counts(media)
    return split_plan(counted, F.col("audio_tracks"), mode, directory).select(
        "path", "mode", "track", "audio_file", "video_file"
    )
