import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.llm import quality_rules as q

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = SPACE.findall(text)
    lines = [line for line in text.split("\n") if SPACE.search(line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if many[w] > 1:
            hit.update(range(i, i + 8))
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(hit),
    }


@settings(deadline=None, max_examples=60)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab#é \n\x85", max_size=80)), min_size=1, max_size=6))
def test_counts(rows):
    import pyarrow as pa

    got = q.measure(pa.array(rows, pa.string()))
    for i, text in enumerate(rows):
        assert {k: int(got[k][i]) for k in brute(text)} == brute(text)


def test_binomial_tail_is_exact():
    for n, p in ((7, 0.3), (400, 0.01), (3000, 0.05)):
        got = q.binomial_tail(n, p, min(n, 40))
        want = np.cumsum([math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(min(n, 40) + 1)])
        assert np.allclose(got, want, rtol=1e-9)


def test_no_cutoff_beyond_what_the_test_allows():
    # 1000 good texts, 30 of them over the second cutoff: 1 % may be rejected, so only the first is safe
    good, bad = np.array([0, 30, 0, 970.0]), np.array([10, 50, 0, 40.0])
    assert q.safe_cutoff(good, bad, 0.01, 0.05, 0.0) == 0
    assert q.safe_cutoff(good, bad, 0.05, 0.05, 0.0) == 1
    assert q.safe_cutoff(np.array([0, 0, 0, 20.0]), bad, 0.01, 0.05, 0.0) == -1  # too few labels
    assert q.safe_cutoff(good * 0, bad, 0.01, 0.05, 0.0) == -1


def test_guarantee_holds_on_random_labels():
    """Measures that say nothing about quality: the chosen cutoff must rarely reject above alpha."""
    rng, over, alpha = np.random.default_rng(3), 0, 0.05
    grid = np.linspace(0.99, 0.5, 40)
    for _ in range(300):
        place = np.searchsorted(-grid, -rng.random(800), "right")
        good = np.bincount(place, minlength=41).astype(float)[:41]
        j = q.safe_cutoff(good, good, alpha, 0.05, 0.0)
        over += j >= 0 and 1 - grid[j] > alpha
    assert over <= 300 * 0.05 + 12


@pytest.fixture(scope="module")
def judged(spark, docs, prose):
    rows = [(i, prose(40, i)) for i in range(1200)]
    rows += [(2000 + i, prose(40, i).replace(" ", "### ")) for i in range(200)]
    rows += [(3000, None), (3001, ""), (3002, "too short"), (None, prose(40, 9)), (5, prose(40, 5)), (3003, "same words " * 40)]
    rows += [(3004, prose(40, 7).replace(" ", "### "), None, None), (3005, prose(200_000, 3, 10**6))]
    labels = [(i, 1, 0) for i in range(1200)] + [(2000 + i, 0, 0) for i in range(150)] + [(None, 1, 0), (7, None, 0), (1, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs(rows, extra=("x",)).withColumnRenamed("_0", "_counts"), labels


def test_rules_reject_symbols_and_keep_prose(spark, judged):
    docs, labels = judged
    out = q.quality_rules(spark, docs, labels)
    assert out.columns == [*docs.columns, "rejected_by"] and out.count() == docs.count()
    got = {r.doc_id: r.rejected_by for r in out.collect()}
    assert all(got[2000 + i] == ["symbols_per_word"] or "symbols_per_word" in got[2000 + i] for i in range(200))
    assert all(got[i] is None for i in range(1200))
    assert got[3000] == got[3001] == got[3002] == ["base"] and "base" in got[3003]
    assert got[None] is None and got[3005] is None
    assert got[3004] is None  # its stratum has no labels, so no rule may reject there


def test_table_and_rows_agree(spark, judged):
    docs, labels = judged
    rows = q.quality_rules(spark, docs, labels).select("doc_id", F.col("rejected_by").isNull().alias("kept"))
    table = q.quality_table(spark, docs, labels).select("doc_id", F.col("rejected_by").isNull().alias("kept"))
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(map(tuple, table.collect()), key=str)


def test_empty_tables(spark, judged, docs, prose):
    _, labels = judged
    assert q.quality_rules(spark, docs([]), labels).count() == 0
    out = q.quality_rules(spark, docs([(1, prose(30)), (2, "x")]), labels.limit(0))
    assert {r.doc_id: r.rejected_by for r in out.collect()} == {1: None, 2: ["base"]}
