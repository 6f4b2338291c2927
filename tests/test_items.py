import json
from datetime import date

import pytest

from colloquy.operators import (
    action_item_rank,
    action_item_report,
    action_item_validate,
    action_items_flatten,
)

NAME = "Ada Quill"


def item(**changes):
    made = {
        "description": "draft the outline",
        "owner": "Mo",
        "due_date": "2031-11-02",
        "urgency_score": "3",
        "priority_score": "7",
        "citation": "Para 4",
        "high_level_topic": "Budget",
    }
    made.update(changes)
    return {k: v for k, v in made.items() if v is not ...}


def flagged(value=True, **changes):
    made = item(**changes)
    if value is not ...:
        made["ada_quill_reference"] = value
    return made


CASES = [
    (item(), "next_steps", []),
    (item(owner=...), "next_steps", ["missing:owner"]),
    (item(note="x"), "next_steps", ["extra:note"]),
    (dict(reversed(item().items())), "next_steps", ["order"]),
    (item(urgency_score="0"), "next_steps", ["urgency_score"]),
    (item(urgency_score="11"), "next_steps", ["urgency_score"]),
    (item(priority_score="1-10"), "next_steps", ["priority_score"]),
    (item(urgency_score=9), "next_steps", []),
    (item(due_date="YYYY-MM-DD"), "next_steps", ["due_date"]),
    (item(due_date="2025-02-30"), "next_steps", ["due_date"]),
    (item(due_date=None), "next_steps", ["due_date"]),
    (flagged(), "next_steps", ["extra:ada_quill_reference"]),
    (flagged(), "ada_quill_actions", []),
    (flagged(False), "ada_quill_actions", []),
    (flagged("true"), "ada_quill_actions", ["ada_quill_reference"]),
    (flagged(...), "ada_quill_actions", ["missing:ada_quill_reference"]),
]


@pytest.mark.parametrize("made, section, broken", CASES)
def test_rules(spark, made, section, broken):
    df = spark.createDataFrame(
        [("f", json.dumps({section: [made]}))], "file_id string, json_content string"
    )
    (row,) = action_item_validate(action_items_flatten(df, NAME), NAME).collect()
    assert row.section == section and row.violations == broken


def test_flatten(spark):
    docs = {
        "all": {
            "next_steps": [item(), item(description="second", due_date="soon")],
            "strategic_initiatives": [],
            "executive_followup": [item(owner="Cy")],
            "ada_quill_actions": [flagged(False)],
            "title": "kept out",
        },
        "empty": {"next_steps": [], "ada_quill_actions": []},
        "none": {"title": "x"},
        "odd": {"next_steps": "call Bo", "executive_followup": [item()]},
        "strings": {"next_steps": ["call Bo", item()]},
    }
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [("broken", "{"), ("null", None)]
    df = spark.createDataFrame(rows, "file_id string, json_content string")
    got = action_items_flatten(df, NAME).collect()
    keys = sorted((r.file_id, r.section, r.pos) for r in got)
    assert keys == [
        ("all", "ada_quill_actions", 0),
        ("all", "executive_followup", 0),
        ("all", "next_steps", 0),
        ("all", "next_steps", 1),
        ("odd", "executive_followup", 0),
        ("strings", "next_steps", 0),
        ("strings", "next_steps", 1),
    ]
    by_key = {(r.file_id, r.section, r.pos): r for r in got}
    first = by_key["all", "next_steps", 0]
    assert (first.owner, first.due_date, first.urgency, first.priority) == (
        "Mo",
        date(2031, 11, 2),
        3,
        7,
    )
    second = by_key["all", "next_steps", 1]
    assert second.due_date is None and second.due_date_raw == "soon"
    assert by_key["all", "ada_quill_actions", 0].assistant_reference is False
    assert by_key["strings", "next_steps", 1].owner == "Mo"


def test_rank_and_report(spark):
    rows = [
        ("f", "s", i, owner, topic, priority, 5, date(2024, 1, 1 + i % 3))
        for i, (owner, topic, priority) in enumerate(
            [("Bo", "x", 3), ("Bo", "y", 9), ("Bo", "y", 9), ("Bo", "x", None), ("Cy", "x", 1)]
        )
    ]
    items = spark.createDataFrame(
        rows,
        "file_id string, section string, pos int, owner string, high_level_topic string, "
        "priority int, urgency int, due_date date",
    )
    ranked = action_item_rank(items, 2).collect()
    assert sorted((r.owner, r.rank, r.pos) for r in ranked) == [
        ("Bo", 1, 1),
        ("Bo", 2, 2),
        ("Cy", 1, 4),
    ]
    report = {
        (r.owner, r.high_level_topic, r.section): (r.level, r["items"], r.mean_priority)
        for r in action_item_report(items).collect()
    }
    assert report[None, None, None] == (3, 5, 5.5)
    assert report["Bo", None, None] == (2, 4, 7.0)
    assert report["Bo", "x", None] == (1, 2, 3.0)
    assert report["Bo", "y", "s"] == (0, 2, 9.0)
