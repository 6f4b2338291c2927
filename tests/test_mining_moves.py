"""What mining makes and moves on its way to the results."""

import random
import re
import time

import pytest

from colloquy.operators import cue_extract, mining
from colloquy.operators.mining import document_terms
from colloquy.plans import stored_key_terms, update_terms


def test_a_segment_without_an_end_is_not_compared_with_itself(spark):
    # 12,000 words, each run of words a new one: comparing runs with each other took minutes
    text = " ".join(f"w{i}" for i in range(12_000)) + " for the end"
    rows = [("1", 1, text), ("2", 1, "for the end for the end"), ("3", 1, "nothing")]
    segments = spark.createDataFrame(rows, "file_id string, pos int, segment string")
    cues = spark.createDataFrame([("a", "for the"), ("b", "for the"), ("c", "The end!"), ("d", "w7 w8 w9")], "kind string, phrase string")
    begun = time.perf_counter()
    found = sorted((r.file_id, r.kind) for r in cue_extract(segments, cues, question_mark=None).collect())
    assert found == [("1", "a"), ("1", "b"), ("1", "c"), ("1", "d"), ("2", "a"), ("2", "b"), ("2", "c")]
    assert time.perf_counter() - begun < 30


def _spy(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_file_are_not_aggregated_as_rows(spark):
    texts = spark.createDataFrame([("1", "b a. a c"), ("1", "a"), ("2", None), (None, "z z")], "file_id string, text string")
    counts = {(r.file_id, r.term): r.tf for r in document_terms(texts).collect()}
    assert counts == {("1", "a"): 3, ("1", "b"): 1, ("1", "c"): 1, (None, "z"): 2}
    assert "count(" not in _spy(document_terms(texts))


def test_replaced_texts_are_cut_before_the_latest_is_chosen(spark, tmp_path):
    out = str(tmp_path / "terms")
    for batch, rows in (("1", [("1", "a a b"), ("2", "b c")]), ("2", [("1", "d")]), ("3", [("2", None)])):
        update_terms(spark, spark.createDataFrame(rows, "file_id string, text string"), out, batch)
    rows = stored_key_terms(spark, out, 2)
    assert [(r.file_id, r.term, r.score, r["rank"]) for r in rows.collect()] == [("1", "d", 0.693147, 1)]
    assert "max_by" not in _spy(rows)


def _cues_by_hand(rows, phrases, mark):
    """``file_id, pos, segment, kind`` by plain loops; kinds of one key are told of all its segments."""
    found = {}
    for file_id, pos, text in rows:
        spaced = f" {' '.join(re.findall(r'[a-z0-9]+', (text or '').lower()))} "
        kinds = {kind for kind, phrase in phrases if f" {phrase} " in spaced}
        found.setdefault((file_id, pos), set()).update(kinds | ({mark} if mark and (text or "").endswith("?") else set()))
    return sorted(str((*row, kind)) for row in rows for kind in found[row[:2]])


@pytest.mark.parametrize("common, counted", [(0, 16), (1, 1), (40, 1), (40, 1000), (500_000, 16)])
def test_however_many_phrases_are_common_all_are_found(spark, monkeypatch, common, counted):
    # 150 kinds are three numbers of bits; with 64 marks nearly every run has one that a phrase has
    monkeypatch.setattr(mining, "COMMON", common)
    monkeypatch.setattr(mining, "COUNTED", counted)
    monkeypatch.setattr(mining, "MARKS", 64)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    rows = [(f"f{i % 7}", i, " ".join(rng.choices(words, k=rng.randrange(9))) + rng.choice(["", ".", "?"])) for i in range(200)]
    rows += [("f0", 0, "w1 w2"), ("f0", 0, "w1 w2"), ("f0", 0, None), (None, 1, "w3 w4"), (None, None, "w5 w6 w7?"), ("f", None, "w3 w4")]
    phrases = [(f"k{rng.randrange(150)}", " ".join(rng.choices(words, k=rng.choice([1, 2, 3])))) for _ in range(600)]
    phrases += [(None, "w3 w4"), ("none", "w99"), ("asked", "w5")]
    segments = spark.createDataFrame(rows, "file_id string, pos int, segment string")
    table = spark.createDataFrame(phrases, "kind string, phrase string")
    for mark in ("asked", None):
        got = cue_extract(segments, table, question_mark=mark)
        assert sorted(str(tuple(r)) for r in got.collect()) == _cues_by_hand(rows, phrases, mark)


def _written(df):
    """Rows that each shuffle of a query wrote."""
    def numbers(node):
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            yield node.metrics().apply("shuffleRecordsWritten").value()
        if name == "AdaptiveSparkPlanExec":
            yield from numbers(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            yield from numbers(node.plan())
        else:
            for i in range(node.children().size()):
                yield from numbers(node.children().apply(i))

    df.collect()
    return list(numbers(df._jdf.queryExecution().executedPlan()))


@pytest.mark.parametrize("common", [100, 500_000])
def test_found_kinds_and_common_runs_do_not_move_as_rows(spark, monkeypatch, common):
    # 2,000 segments of ten words, in each of them all 60 kinds: 120,000 rows come out
    monkeypatch.setattr(mining, "COMMON", common, raising=False)
    segments = spark.range(2000).selectExpr("string(id) as file_id", "1 as pos", "'a b c d e f g h i j' as segment").cache()
    often = [(f"k{i}", " ".join("abcdefghij"[i % 9 : i % 9 + 2])) for i in range(60)]
    rare = [(f"k{i % 60}", f"x{i} y{i}") for i in range(500)]
    found = cue_extract(segments, spark.createDataFrame(often + rare, "kind string, phrase string"), question_mark=None)
    written = _written(found)
    assert found.count() == 120_000 and written and max(written) <= 2000
