"""Six invented replies, one per known layout."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from colloquy.functions import summary_unwrap
from colloquy.operators import (
    grounding_check,
    schema_drift_report,
    summary_normalize,
    summary_quality_flags,
)
from colloquy.sources import read_summaries

BODY = """
The guild met in spring.

Presenters:
- Ann Ash
- Bo Birch

Key Points:
- trees grow
- slowly

Next Steps:
- plant more
- water them
"""

LAYOUTS = {
    "1": '{"title":"One","date":"2023","author":"The Guild","content":"'
    + BODY
    + '","summary":"Short."}',
    "2": json.dumps(
        {
            "title": "Two",
            "date": "2023",
            "hosted_by": ["The Guild"],
            "panelists": [
                {"name": "Cy Cedar", "alias": "C", "background": "taxes"},
                {"name": "Di Dogwood", "alias": "D", "background": "law"},
            ],
            "key_topics": ["roots", "bark"],
            "next_steps": ["look", "see"],
            "editorial_summary": {"intro": "Hello.", "outro": "Bye."},
            "contact_information": {"Cy Cedar": "cy@mail.example"},
        }
    ),
    "3": json.dumps(
        {
            "title": "Three",
            "date": "2024-02-06",
            "authors": [{"name": "Ed Elm", "affiliation": "Elm & Co"}],
            "content": [{"section": "Intro", "text": "Text."}],
            "next_steps": [{"point": "ask"}, {"point": "tell"}],
        }
    ),
    "4": json.dumps(
        {
            "title": "Four",
            "date": "2024-02-30",
            "author": "The Guild",
            "email": "N/A",
            "content": [
                {"heading": "A", "paragraphs": ["one", "two"]},
                {"heading": "B", "paragraphs": []},
            ],
            "presenters": [],
            "key_points": ["k"],
            "next_steps": ["n"],
        }
    ),
    "5": json.dumps(
        {
            "title": "Five",
            "date": "2024-03-01",
            "authors": [{"name": "Flo Fir", "email": "", "background": "islands"}],
            "content": [{"section_title": "S", "section_content": "C"}],
            "next_steps": {"key_points": ["k5"], "tangible_next_steps": ["t5", "u5"]},
        }
    ),
    "6": '{"title":"Six","date":"2023","author":"The Guild","content":"\nLine\n\nline\n","presenters":'
    + json.dumps([{"name": "Gil", "role": "chair", "email": "Not provided"}])
    + ',"key_points":["k6"],"next_steps":["n6"]}',
}


def stored(body):
    return '{\n    "response": ```json\n' + body + "\n```\n}"


@pytest.fixture(scope="module")
def norm(spark):
    rows = [(k, stored(v)) for k, v in LAYOUTS.items()]
    df = spark.createDataFrame(rows, "file_id string, raw string")
    return summary_normalize(df.withColumn("v", summary_unwrap(F.col("raw")))).cache()


def test_people(norm):
    got = {r.file_id: [tuple(p) for p in r.people] for r in norm.collect()}
    assert got == {
        "1": [("Ann Ash", None, None, None), ("Bo Birch", None, None, None)],
        "2": [("Cy Cedar", "taxes", None, "cy@mail.example"), ("Di Dogwood", "law", None, None)],
        "3": [("Ed Elm", None, "Elm & Co", None)],
        "4": [],
        "5": [("Flo Fir", "islands", None, None)],
        "6": [("Gil", "chair", None, None)],
    }


def test_dates(norm):
    got = {r.file_id: (r.date_raw, r.date, r.date_precision) for r in norm.collect()}
    assert got["1"] == ("2023", None, "year")
    assert got["3"] == ("2024-02-06", date(2024, 2, 6), "day")
    assert got["4"] == ("2024-02-30", None, "none")


def test_sections(norm):
    got = {r.file_id: [tuple(s) for s in r.sections] for r in norm.collect()}
    assert got == {
        "1": [("", BODY)],
        "2": [("intro", "Hello."), ("outro", "Bye.")],
        "3": [("Intro", "Text.")],
        "4": [("A", "one\ntwo"), ("B", "")],
        "5": [("S", "C")],
        "6": [("", "\nLine\n\nline\n")],
    }


def test_lists(norm):
    got = {r.file_id: (r.key_points, r.next_steps) for r in norm.collect()}
    assert got == {
        "1": (["trees grow", "slowly"], ["plant more", "water them"]),
        "2": (["roots", "bark"], ["look", "see"]),
        "3": ([], ["ask", "tell"]),
        "4": (["k"], ["n"]),
        "5": (["k5"], ["t5", "u5"]),
        "6": (["k6"], ["n6"]),
    }
    assert norm.where("file_id = '1'").first().abstract == "Short."


def test_single_author_and_items(spark):
    body = json.dumps(
        {"author": "Hal", "email": "hal@mail.example", "next_steps": [{"description": "do it"}]}
    )
    df = spark.createDataFrame([("x", body)], "file_id string, raw string")
    row = summary_normalize(df.withColumn("v", summary_unwrap(F.col("raw")))).first()
    assert [tuple(p) for p in row.people] == [("Hal", "author", None, "hal@mail.example")]
    assert row.next_steps == ["do it"] and row.sections == [] and row.title is None


def test_flags(norm):
    flags = {
        r.file_id: r.flags
        for r in summary_quality_flags(norm, "2024-01-01", "2024-02-29").collect()
    }
    assert flags == {
        "1": ["year_only"],
        "2": ["year_only"],
        "3": [],
        "4": ["no_date", "no_people", "empty_section"],
        "5": ["date_outside"],
        "6": ["year_only"],
    }


def test_grounding(spark, norm):
    texts = spark.createDataFrame(
        [("1", "then ann ash spoke"), ("2", "Nobody was named"), ("3", None)],
        "file_id string, text string",
    )
    got = {(r.file_id, r.name): r.grounded for r in grounding_check(norm, texts).collect()}
    assert got == {
        ("1", "Ann Ash"): True,
        ("1", "Bo Birch"): False,
        ("2", "Cy Cedar"): False,
        ("2", "Di Dogwood"): False,
        ("3", "Ed Elm"): False,
        ("5", "Flo Fir"): False,
        ("6", "Gil"): False,
    }


def test_drift_of_stored_files(spark, tmp_path):
    for name, body in LAYOUTS.items():
        (tmp_path / f"s{name}.json").write_text(stored(body))
    found = read_summaries(spark, str(tmp_path))
    assert found.where("v is null").count() == 0
    drift = {(r.key, r.type): r.summaries for r in schema_drift_report(found).collect()}
    assert drift["title", "STRING"] == 6 and drift["content", "STRING"] == 2
    assert drift["next_steps", "ARRAY<STRING>"] == 3
    assert drift["presenters", "ARRAY<VOID>"] == 1
