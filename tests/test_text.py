import os.path
import unicodedata

from pyspark.sql import functions as F

from colloquy import functions as fn
from colloquy.operators import media_output_names
from rules import file_name as rule


def names(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r.n for r in df.select(fn.sanitize_filename(F.col("t")).alias("n")).collect()]


def test_sanitize_every_old_code_point(spark):
    # Python knows letters that are newer than the JVM's tables, so only the characters of
    # Unicode 3.2 are compared.
    known = unicodedata.ucd_3_2_0
    points = [c for c in range(1, 0x20000) if known.category(chr(c)) not in ("Cn", "Cs")]
    texts = [f"a{chr(c)}b" for c in points]
    ours = names(spark, texts)
    assert [hex(c) for c, t, n in zip(points, texts, ours) if rule(t) != n] == []


def test_sanitize_awkward_texts(spark):
    texts = [
        "",
        "  lead and trail  ",
        "--",
        "a - ! - b",
        "tab\tand\nline",
        "é" * 200,
        "x!" * 200,
        "!" * 500 + "end",
        "word " * 60,
        "a" * 79 + " - ",
        "a" * 80 + " - tail",
        "-" * 300 + "z",
        "😀 smile 😀",
        " sep　arated\x1cby",
    ]
    assert names(spark, texts) == [rule(t) for t in texts]


def test_summary_filename_cuts_each_part(spark):
    df = spark.createDataFrame([("2024-03-01", "t" * 200)], "d string, t string")
    name = df.select(fn.summary_filename(F.col("d"), F.col("t")).alias("n")).first().n
    assert name == "2024_03_01_" + "t" * 80 + ".json"


def test_base_names_like_splitext(spark):
    paths = ["a/b.c.mp4", "a/.hid", "a/noext", "x/..dots", "a..txt", "/a/b/", "…/ü.mp3", "..a.b"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    audio, video = media_output_names(F.col("p"), F.lit(2), "out")
    for row in df.select("p", audio.alias("a"), video.alias("v")).collect():
        base = os.path.splitext(os.path.basename(row.p))[0]
        assert row.a == f"out/{base}_output_audio_track_2.mp3"
        assert row.v == f"out/{base}_output_video_track_2.mp4"


def test_guard_and_markers(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("N/A",), ("Not Provided ",), ("x",)], "t string")
    rows = df.select(
        fn.empty_transcript_guard(F.col("t")).alias("empty"),
        fn.null_marker_cleanup(F.col("t")).alias("clean"),
    ).collect()
    assert [r.empty for r in rows] == [True, True, False, False, False, False]
    assert [r.clean for r in rows] == [None, None, None, None, None, "x"]


def test_tail_and_count(spark):
    text = "ERROR ERRORERROR error " + "ü" * 7000
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(
        fn.log_tail(F.col("t")).alias("tail"), fn.error_count(F.col("t")).alias("n")
    ).first()
    assert row.tail == text[-6000:] and row.n == 3


def test_mentions_whole_words(spark):
    texts = ["Ada Quill agreed.", "adaquill", "ADA, quill", "Nada Quill", "Quill Ada"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select(fn.mentions(fn.spaced_words(F.col("t")), ["Ada Quill"]).alias("m")).collect()
    assert [r.m for r in found] == [True, False, True, False, False]
