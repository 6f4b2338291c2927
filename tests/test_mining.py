import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.operators import cue_extract, extractive_summary, key_terms, owner_from_speaker, phrase_index
from colloquy.plans import stored_frequency, stored_key_terms, update_terms

TEXTS = {
    "a": "Budget talks began. The budget was cut. Rain fell.",
    "b": "Rain fell again and again. The roof leaked.",
    "c": "The roof was mended. Budget for the roof: none!",
    "d": "",
    "e": None,
    "f": "The the the.",
}


def words(text):
    return re.findall(r"\w+", (text or "").lower())


def weights():
    n, df = len(TEXTS), Counter()
    for text in TEXTS.values():
        df.update(set(words(text)))
    return {t: math.log(n / k) for t, k in df.items()}


@pytest.fixture(scope="module", params=["rows", "join", "python"])
def frame(spark, request):
    df = spark.createDataFrame(list(TEXTS.items()), "file_id string, text string")
    if request.param == "join":
        names = df.select("file_id")
        return df.join(names, "file_id").join(names.withColumnRenamed("file_id", "x"), F.col("file_id") == F.col("x")).drop("x")
    if request.param == "python":
        return df.mapInPandas(lambda parts: parts, df.schema)
    return df


def test_key_terms(frame):
    idf, got = weights(), {}
    for r in key_terms(frame, 3).collect():
        got.setdefault(r.file_id, []).append((r.rank, r.term, r.score))
    for file, text in TEXTS.items():
        scores = [(round(tf * idf[t], 6), t) for t, tf in Counter(words(text)).items()]
        best = sorted(scores, key=lambda x: (-x[0], x[1]))[:3]
        assert [(t, s) for _, t, s in sorted(got.get(file, []))] == [(t, pytest.approx(s)) for s, t in best]


def test_extractive_summary(frame):
    idf, got = weights(), {}
    for r in extractive_summary(frame, 2).collect():
        got.setdefault(r.file_id, set()).add(r.segment)
    for file, text in TEXTS.items():
        tf, scores = Counter(words(text)), []
        for pos, s in enumerate(x.strip() for x in re.findall(r"[^.!?\n]+[.!?]*", text or "")):
            own = words(s)
            if own:
                scores.append((round(sum(tf[t] * idf[t] for t in own) / len(own), 6), -pos, s))
        assert got.get(file, set()) == {s for *_, s in sorted(scores, reverse=True)[:2]}


def test_partition_count_is_the_sessions(spark, frame):
    plan = key_terms(frame, 3)._jdf.queryExecution().executedPlan().toString()
    wanted = spark.conf.get("spark.sql.shuffle.partitions")
    assert set(re.findall(r"hashpartitioning\(.*?, (\d+)\)", plan)) == {wanted}


@pytest.fixture
def segments(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    rows = [(f"f{i % 9}", i, rng.choice([" ", ", ", " - "]).join(rng.choice(words) for _ in range(rng.randrange(0, 12))) + rng.choice(["", ".", "?"])) for i in range(300)]
    rows += [(None, 900, "w1 w2 w3?"), ("f", None, "W1, w2! w3"), ("f", 901, None)]
    return spark.createDataFrame(rows, "file_id string, pos int, segment string")


def phrases(n):
    rng = random.Random(n)
    return [(f"k{rng.randrange(5)}", " ".join(f"w{rng.randrange(30 + n // 10)}" for _ in range(rng.choice([1, 2, 3, 7])))) for _ in range(n)]


@pytest.mark.parametrize("n", [1, 40])
def test_a_cue_table_finds_what_a_dict_finds(spark, segments, n):
    rows = phrases(n) + [("k1", "W1 ... w2"), ("k1", "w1 w2"), ("none", " ?!"), ("none", "")]
    as_dict = {}
    for kind, phrase in rows:
        if phrase.strip(" ?!"):
            as_dict.setdefault(kind, []).append(phrase)
    table = spark.createDataFrame(rows, "kind string, phrase string")
    for mark in ("open_question", None, "k1"):
        got = cue_extract(segments, table, question_mark=mark)
        want = cue_extract(segments, {mark: [], **as_dict} if mark else as_dict, question_mark=mark)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_hundred_thousand_phrases(spark, segments):
    rows = phrases(100_000)
    found = cue_extract(segments, spark.createDataFrame(rows, "kind string, phrase string"), question_mark=None).collect()
    index = {}
    for kind, phrase in rows:
        index.setdefault(tuple(phrase.split()), set()).add(kind)
    want = set()
    for r in segments.collect():
        w = re.findall(r"[a-z0-9]+", (r.segment or "").lower())
        for n in (1, 2, 3, 7):
            for i in range(len(w) - n + 1):
                want |= {(r.file_id, r.pos, kind) for kind in index.get(tuple(w[i : i + n]), ())}
    assert sorted(map(str, ((r.file_id, r.pos, r.kind) for r in found))) == sorted(map(str, want))


def test_no_phrases_and_texts_that_do_not_move(spark, segments):
    none = spark.createDataFrame([], "kind string, phrase string")
    assert cue_extract(segments, none, question_mark=None).count() == 0
    assert cue_extract(segments, none).count() == sum((r.segment or "").endswith("?") for r in segments.collect())
    table = spark.createDataFrame(phrases(3), "kind string, phrase string")
    assert phrase_index(table).columns == ["kind", "n", "gram"]


def test_owners_by_a_cue_table(spark):
    rows = [("f", 1, "Ann", "I will send it. Yes."), ("f", 2, "Bob", "To do: buy tea. will  SEND!"), ("f", 3, "Ann", None)]
    turns = spark.createDataFrame(rows, "file_id string, turn int, speaker string, text string")
    table = spark.createDataFrame([("action_item", "will send"), ("action_item", "to do"), ("decision", "yes")], "kind string, phrase string")
    want = owner_from_speaker(turns, {"action_item": ["will send", "to do"], "decision": ["yes"]}).collect()
    assert sorted(map(tuple, owner_from_speaker(turns, table).collect())) == sorted(map(tuple, want)) and len(want) == 3


def test_replaced_files_change_the_terms_as_a_full_run_does(spark, tmp_path):
    schema, out = "file_id string, text string", str(tmp_path / "out")
    rng = random.Random(6)

    def text():
        return rng.choice([None, "", "?!", " ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 15)))])

    now = {}
    for batch in ("1", "2", "3"):
        given = {f"f{i}": text() for i in rng.sample(range(30), 18)}
        now |= given
        update_terms(spark, spark.createDataFrame(list(given.items()), schema), out, batch)
        full = spark.createDataFrame(list(now.items()), schema)
        frequency, files = stored_frequency(spark, out)
        want = Counter(t for x in now.values() for t in set(re.findall(r"[a-z]+", x or "")))
        assert {r.term: r.df for r in frequency.collect()} == dict(want)
        assert files.first().n == len(now)
        assert sorted(map(tuple, stored_key_terms(spark, out, 3).collect())) == sorted(map(tuple, key_terms(full, 3).collect()))
    with pytest.raises(FileExistsError):
        update_terms(spark, full, out, "3")
    assert files.first().n == len(now)
