import json
import random

import pytest

from colloquy.llm import queries
from colloquy.llm import toolcalls as t

CALLS = "conv_id long, call_id string, turn long, tool string, arguments string, parent_id string"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {
    "find": {"query": ("string", True, 2, 20), "limit": ("integer", False, 1, 9)},
    "add": {"a": ("number", True, None, None), "b": ("number", True, None, None), "tags": ("array", False, None, 2), "deep": ("object", False, None, None), "on": ("boolean", False, None, None)},
}


@pytest.mark.parametrize(
    "tool, arguments, wrong",
    [
        ("find", {"query": "ab", "limit": 9}, []),
        ("find", {"query": "a", "limit": 10}, ["limit:most", "query:least"]),
        ("find", {"limit": True}, ["limit:type", "query:missing"]),
        ("find", {"query": "abc", "other": 1}, ["other:unknown"]),
        ("find", [1], ["json"]),
        ("find", None, ["json"]),
        ("gone", {}, ["tool"]),
        (None, {}, ["tool"]),
        ("add", {"a": 1.5, "b": 2, "tags": [1, 2], "deep": {}, "on": False}, []),
        ("add", {"a": "1", "b": True, "tags": [1, 2, 3]}, ["a:type", "b:type", "tags:most"]),
    ],
)
def test_violations(tool, arguments, wrong):
    assert t.violations(SCHEMAS, tool, arguments) == wrong


def test_canonical_json():
    one = t.canonical(json.loads('{"b": 1.0, "a": {"z": [1.5, 2.0], "é": "\\u00e9\\n"}}'))
    assert one == '{"a":{"z":[1.5,2],"é":"é\\n"},"b":1}'
    assert t.canonical(json.loads(one)) == one


@pytest.fixture(scope="module")
def linked(spark):
    ok = '{"query":"hello", "limit":2.0}'
    calls = [
        (1, "a", 0, "find", ok, None), (1, "b", 2, "find", '{"query":"x"}', "a"), (1, "c", 4, "add", '{"a":1,"b":2}', "b"),
        (1, "x", 6, "find", ok, "y"), (1, "y", 8, "find", ok, "x"), (1, "below", 9, "find", ok, "x"),
        (1, "lost", 10, "find", ok, "nowhere"), (1, "open", 11, "find", "{not json", None), (1, "none", 12, None, None, None),
        (2, "a", 0, "find", ok, None), (2, "a", 0, "find", ok, None), (2, "a", 5, "add", "{}", None),
        (None, "a", 0, "find", ok, None), (2, None, 0, "find", ok, None),
    ]
    chain = [(3, f"n{i}", i, "find", ok, f"n{i - 1}" if i else None) for i in range(200)]
    random.Random(1).shuffle(chain)
    results = [(1, k, 1, f"result {k}") for k in ("a", "b", "x", "y", "below", "lost")]
    results += [(1, "stray", 3, "é \n"), (2, "a", 1, "second"), (2, "a", 1, "first"), (2, None, 1, "?"), (1, "c", 1, None)]
    out = t.link_calls(spark, spark.createDataFrame(calls + chain, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS)
    return {(r.conv_id, r.call_id): r for r in out.collect()}


def test_links(linked):
    assert len(linked) == 9 + 1 + 1 + 200
    status = {k[1]: r.status for k, r in linked.items() if k[0] == 1}
    assert status == {
        "a": "linked", "b": "linked", "c": "linked", "x": "cycle", "y": "cycle", "below": "cycle", "lost": "no_parent",
        "open": "no_result", "none": "no_result", "stray": "no_call",
    }
    twice = linked[2, "a"]
    assert (twice.n_calls, twice.n_results, twice.tool, twice.turn) == (3, 2, "find", 0)
    assert json.loads(twice.json)["result"] == "first"
    assert linked[1, "open"].violations == ["json"] and linked[1, "none"].violations == ["tool"]
    assert linked[1, "b"].violations == ["query:least"]
    assert linked[1, "stray"].json == (
        '{"arguments":null,"conversation":1,"id":"stray","level":null,"result":"é \\n","status":"no_call","tool":null,"violations":[]}'
    )
    assert json.loads(linked[1, "c"].json)["result"] == ""


def test_levels_are_topological(linked):
    assert [linked[1, k].level for k in ("a", "b", "c", "lost", "x", "below")] == [0, 1, 2, 0, None, None]
    assert all(linked[3, f"n{i}"].level == i for i in range(200))


def test_empty(spark):
    calls, results = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    assert t.link_calls(spark, calls, results, SCHEMAS).count() == 0
    only = t.link_calls(spark, calls, spark.createDataFrame([(1, "a", 0, "r")], RESULTS), SCHEMAS).collect()
    assert [r.status for r in only] == ["no_call"]


@pytest.mark.parametrize(
    "arguments",
    ['{"query": "\\ud800"}', '{"\\udfff": 1}', "[" * 100_000 + "]" * 100_000, '{"query": NaN}', '{"limit": 1e400}', "-Infinity", "{", "9" * 5000, " "],
)
def test_arguments_that_no_canonical_json_can_say(spark, arguments):
    calls = spark.createDataFrame([(1, "a", 0, "find", arguments, None, "x"), (1, "b", 1, "find", '{"query":"fine"}', None, "y")], CALLS + ", json string")
    results = spark.createDataFrame([(1, "a", 1, "word " * 300_000)], RESULTS)
    got = {r.call_id: r for r in t.link_calls(spark, calls, results, SCHEMAS).collect()}
    assert got["a"].violations == ["json"] and got["b"].violations == []
    told = json.loads(got["a"].json, parse_constant=lambda _: pytest.fail())
    assert told["arguments"] is None and told["result"] == "word " * 300_000


def test_pairs_of_surrogates_and_large_numbers_stay():
    assert t.canonical(t.loads('{"q": "\\ud83d\\ude00", "n": 1e300}')) == '{"n":' + str(int(1e300)) + ',"q":"\U0001f600"}'


def test_every_turn_is_accounted_for(spark, tmp_path):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hello there, what is it that you need?"), (1, 2, "assistant", "a"), (None, 1, "user", "x"), (1, None, "assistant", "y"), (2, 1, None, "z"), (2, 2, "tool", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op3_tool_calls(spark, str(tmp_path)).collect()
    assert sum(r.n_calls + r.n_results for r in got) + sum(r.status == "unlinked" for r in got) == len(rows)
    assert sorted((r.conv_id or 0, r.turn or 0) for r in got if r.status == "unlinked") == [(0, 1), (1, 0), (1, 0), (2, 1), (2, 2)]
