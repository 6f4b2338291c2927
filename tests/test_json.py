import json

import pytest
from pyspark.sql import functions as F

from colloquy import functions as fn
from colloquy.operators import accept_replies
from rules import file_name

REPLIES = [
    '{"title":"x","date":"2024-01-01"}',
    'Here: {"title":"x"} done',
    "```json\n{\"title\":\n\"x\"}\n```",
    "no object",
    "",
    '{"a":1} and {"b":2}',
    '{"a":1},{"b":2}',
    '{"a":1}],[{"b":2}',
    '{"a":1},"x":{"b":2}',
    '{"title":"x",}',
    '{"title":"a","title":"b"}',
    '{"title":"x\ny"}',
    '{"title":"tab\there"}',
    '{"score":NaN,"title":"x"}',
    '{"score":-Infinity}',
    "{'title':'x'}",
    "{title:1}",
    '{"n":01}',
    '{"title":"\\x"}',
    '{"title":"x" /* c */}',
    "{}",
    '{"title":null}',
    '{"title":7}',
    '{"title":{"a":1}}',
    '{"title":""}',
    '{"title":true,"date":"2024"}',
    '{"date":[]}',
    '{"title":"  -- \\u00e9 "}',
    "} reversed {",
]


def block(reply):
    """From the first brace that opens to the last that closes."""
    first, last = reply.find("{"), reply.rfind("}")
    return reply[first : last + 1] if 0 <= first < last else None


def expected(reply):
    """What a strict reader of the reply gives: (title, date), or None where it is refused."""
    if block(reply) is None:
        return None
    try:
        value = json.loads(block(reply))
    except ValueError:
        return None
    title, date = value.get("title", "untitled"), value.get("date", "undated")
    return (title, date) if isinstance(title, str) and isinstance(date, str) else None


@pytest.mark.parametrize("reply", REPLIES)
def test_accepts_what_a_strict_reader_accepts(spark, reply):
    df = spark.createDataFrame([("f", reply)], "file_id string, reply string")
    row = accept_replies(df).withColumn("j", F.to_json("v")).first()
    want = expected(reply)
    if want is None:
        assert row.json_content is None and row.output_filename is None
    else:
        assert row.json_content == block(reply)
        title, date = want
        assert row.output_filename == f"{file_name(date)}_{file_name(title)}.json"


def test_missing_and_null_differ(spark):
    df = spark.createDataFrame([("{}",), ('{"title":null}',), (None,)], "j string")
    title, date, failed = fn.title_date_defaults(F.col("v"))
    rows = (
        df.withColumn("v", fn.parse_summary_strict(F.col("j")))
        .select(title.alias("t"), date.alias("d"), failed.alias("f"))
        .collect()
    )
    assert [tuple(r) for r in rows] == [
        ("untitled", "undated", False),
        (None, "undated", True),
        (None, None, True),
    ]


def test_unwrap(spark):
    raws = [
        '{"response": ```json\n{"a":"x\ny"}\n```\n}',
        '```\n{"a":"plain fence"}\n```',
        'text {"a":"no fence"} text',
        "nothing",
        "```json\n{broken\n```",
    ]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    got = df.select(
        F.try_variant_get(fn.summary_unwrap(F.col("raw")), "$.a", "string").alias("a")
    ).collect()
    assert [r.a for r in got] == ["x\ny", "plain fence", "no fence", None, None]


def test_messages(spark):
    df = spark.createDataFrame([('say "hi"\n',)], "t string")
    text = df.select(F.to_json(fn.build_messages("be brief", F.col("t"))).alias("m")).first().m
    assert json.loads(text) == [
        {"role": "system", "content": "be brief"},
        {"role": "user", "content": 'say "hi"\n'},
    ]
