from pyspark.sql import functions as F

from colloquy.operators import media_stream_counts, split_mode_filter, split_plan, video_only_plan
from colloquy.plans import media_tasks


def probe(spark):
    video, audio = '{"index":0,"codec_type":"video"}', '{"index":1,"codec_type":"audio"}'
    rows = [
        ("a/one.mp4", f'{{"streams":[{video},{audio}]}}', 1, 1),
        ("a/three.mp4", f'{{"streams":[{audio},{audio},{audio}]}}', 3, 0),
        ("a/none.mp4", '{"streams":[]}', 0, 0),
        ("a/empty.mp4", "{}", None, None),
        ("a/broken.mp4", '{"streams":[', None, None),
        ("a/text.mp4", "ffprobe: no such file", None, None),
        ("a/null.mp4", None, None, None),
        ("a/untyped.mp4", '{"streams":[{"index":0}]}', None, None),
    ]
    return rows, spark.createDataFrame(rows, "path string, probe_json string, a int, v int")


def test_stream_counts(spark):
    rows, df = probe(spark)
    got = {r.path: (r.audio_tracks, r.video_tracks) for r in media_stream_counts(df).collect()}
    assert got == {path: (a, v) for path, _, a, v in rows}


def test_plans(spark):
    _, df = probe(spark)
    tasks = media_tasks(df, F.lit("BOTH"), "out").collect()
    assert sorted((t.path, t.track) for t in tasks) == [("a/one.mp4", 1)] + [
        ("a/three.mp4", i) for i in (1, 2, 3)
    ]
    one = next(t for t in tasks if t.path == "a/one.mp4")
    assert one.audio_file == "out/one_output_audio_track_1.mp3"
    assert one.video_file == "out/one_output_video_track_1.mp4"
    audio = split_plan(df, F.col("a"), F.lit("audio")).collect()
    assert len(audio) == 4 and all(t.video_file is None for t in audio)
    assert split_plan(df, F.col("a"), F.lit("neither")).count() == 0
    assert [t.video_file for t in video_only_plan(df, F.col("v")).collect()] == [
        "output_video_only_track_1.mp4"
    ]


def test_modes(spark):
    df = spark.createDataFrame([("Audio",), ("both",), ("x",), (None,)], "m string")
    rows = split_mode_filter(df, F.col("m")).collect()
    assert [r.mode for r in rows] == ["audio", "both", None, None]
    assert [r.mode_error is None for r in rows] == [True, True, False, False]
