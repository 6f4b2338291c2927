"""Plan shapes against brute force, with one key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from colloquy.skew import computed_once, running, top_per_key


@pytest.fixture(scope="module")
def skewed(spark):
    random.seed(7)
    rows = [
        ("hot" if i % 3 else f"k{i % 50}", i, random.choice([None, "a", "b", "c"]), i % 4 == 0)
        for i in range(3000)
    ]
    return rows, spark.createDataFrame(rows, "k string, pos long, v string, flag boolean").cache()


@pytest.mark.parametrize("block", [1, 7, 1000, 100_000])
def test_running(skewed, block):
    rows, df = skewed
    got = running(
        df,
        ["k"],
        "pos",
        sums={"n": F.col("flag").cast("int")},
        lasts={"last": F.col("v")},
        block_size=block,
    )
    assert set(got.columns) == {"k", "pos", "v", "flag", "n", "last"}
    count, last, want = {}, {}, {}
    for k, pos, v, flag in rows:
        count[k] = count.get(k, 0) + flag
        last[k] = v if v is not None else last.get(k)
        want[pos] = (count[k], last[k])
    assert {r.pos: (r.n, r.last) for r in got.collect()} == want


@pytest.mark.parametrize("k", [1, 3, 1500])
def test_top_per_key(skewed, k):
    rows, df = skewed
    got = top_per_key(df, ["k"], [F.desc("pos")], k, "r")
    by_key = {}
    for key, pos, *_ in rows:
        by_key.setdefault(key, []).append(pos)
    want = {
        (key, pos, i + 1)
        for key, found in by_key.items()
        for i, pos in enumerate(sorted(found, reverse=True)[:k])
    }
    assert {(r.k, r.pos, r.r) for r in got.collect()} == want


def test_top_per_key_is_cut_before_the_shuffle(skewed):
    _, df = skewed
    plan = top_per_key(df, ["k"], [F.desc("pos")], 3, "r")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.index("3, Final") < text.index("Exchange") < text.index("3, Partial")


def test_filters_read_what_was_computed(skewed):
    _, df = skewed
    once = computed_once(df, ["k"], {"x": F.sha2("v", 256)}).where(F.col("x").isNotNull())
    assert once._jdf.queryExecution().optimizedPlan().toString().count("sha2") == 1
