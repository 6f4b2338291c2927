import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.llm import near_dedup as nd
from colloquy.llm.components import components
from colloquy.llm.shared import Scratch


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Component of each id by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            inter = len(a & b)
            if a and b and 100 * inter >= 85 * (len(a) + len(b) - inter):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in up}


def edited(text, n, seed):
    words, rng = text.split(), random.Random(seed)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"new{seed}x{k}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows(prose):
    base, passage = prose(200, 1), prose(60, 2)
    out = [(100 + s, edited(base, s % 9, s)) for s in range(120)]  # near and not so near copies of a text
    out += [(300 + s, prose(50, 100 + s) + " " + passage) for s in range(40)]  # a shared passage is no copy
    out += [(400 + s, prose(80, 500)) for s in range(30)] + [(399, prose(80, 500).upper())]
    chain = prose(120, 700).split()
    out += [(500 + s, " ".join(chain[s : s + 100])) for s in range(12)]  # a chain: ends are not alike
    out += [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "A  b"), (6, "a b c"), (None, base), (None, None)]
    out += [(600, prose(90, 42)), (600, prose(90, 42)), (601, prose(30_000, 77, 10**6))]
    random.Random(0).shuffle(out)
    return out


def test_components_are_those_of_all_pairs(spark, docs, rows):
    out = nd.near_duplicates(spark, docs(rows)).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    for r in out:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
    sizes = {i: len(shingles(t)) for i, t in rows if i is not None}
    assert all(r.n_shingles == sizes[r.doc_id] for r in out if r.doc_id is not None)


def test_one_document_of_each_component_stays(spark, docs, rows):
    given_docs = docs(rows, extra=("x",)).withColumnRenamed("_0", "component_id")
    out = nd.deduplicate(spark, given_docs)
    assert out.columns == given_docs.columns
    want = brute(rows)
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(i for i in want if want[i] == i)
    assert ids.count(None) == 2


def test_different_texts_of_one_id_are_documents_of_their_own(spark, docs, prose):
    near = lambda seed: edited(prose(200, seed), 2, seed)
    rows = [(5, prose(200, 50)), (5, prose(200, 51)), (5, prose(200, 52)), (5, prose(200, 50))]
    rows += [(9, near(50)), (3, near(51)), (12, prose(200, 53)), (12, near(53)), (12, prose(200, 54)), (7, prose(80, 55)), (8, prose(80, 55))]
    rows += [(-4, ""), (-4, None), (-4, "a b"), (20, "a b"), (None, prose(200, 50)), (None, None)]
    got = sorted((str(r.doc_id), r.text or "") for r in nd.deduplicate(spark, docs(rows, extra=("x",)).withColumnRenamed("_0", "_digest")).collect())
    first = min((prose(200, 53), near(53)), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    want = [(5, prose(200, 50)), (3, near(51)), (5, prose(200, 52)), (12, first), (12, prose(200, 54)), (7, prose(80, 55))]
    want += [(-4, ""), (-4, "a b"), (None, prose(200, 50)), (None, "")]
    assert got == sorted((str(i), t) for i, t in want)


def test_pairs_below_the_contract_go_at_a_lower_similarity(spark, docs):
    rows = []
    for k in range(20):
        words = [f"t{k}w{i}" for i in range(100)]
        changed = list(words)
        changed[30], changed[60 + k] = "one", "other"  # 86 of 106 shingles: 0.81
        further = list(words)
        further[20], further[40], further[60 + k] = "one", "two", "three"  # 81 of 111: 0.73
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(changed)), (1000 + k, " ".join(further))]
    shared = len(shingles(rows[0][1]) & shingles(rows[1][1]))
    assert (shared, len(shingles(rows[0][1]) | shingles(rows[1][1]))) == (86, 106)
    first, near = {3 * k for k in range(20)}, {3 * k + 1 for k in range(20)}
    far = {1000 + k for k in range(20)}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(nd.deduplicate(spark, docs(rows))) == first | near | far
    assert ids(nd.deduplicate(spark, docs(rows), similar=80)) == first | far


def test_matches_are_those_of_the_bound():
    assert (nd.matches(85), nd.matches(80)) == (23, 19)


def test_empty(spark, docs):
    assert nd.near_duplicates(spark, docs([])).count() == 0
    assert nd.deduplicate(spark, docs([])).count() == 0


def test_plan_moves_no_text_before_candidates_are_known(spark, docs, rows):
    plan = nd.signed(docs(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@settings(deadline=None, max_examples=5)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components_of_any_graph(spark, pairs):
    up = {x: x for p in pairs for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    edges = spark.createDataFrame(pairs, "a long, b long").where("a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    got = {r.a: r.b for r in components(edges, Scratch(spark, "graph"), "c").collect()}
    assert got == {x: top(x) for x in up if top(x) != x}
