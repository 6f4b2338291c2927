import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        k = min(window, len(b))
        for i in range(len(b) - k + 1) if k else ():
            for j in range(len(w) - k + 1):
                if w[j : j + k] == b[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add(item)
    return len(w), hit, found


LETTERS = st.text(alphabet="ab c,", max_size=40)


@settings(deadline=None, max_examples=300)
@given(st.lists(LETTERS, max_size=5), LETTERS, st.integers(2, 5))
def test_automaton_finds_what_a_search_finds(items, text, window):
    named = [(str(i), t) for i, t in enumerate(items)]
    known = d.Automaton([(i, t.encode()) for i, t in named], window)
    spans, found = known.spans(text.encode().translate(d.TO_WORDS).split())
    n, hit, wanted = brute(text, named, window)
    assert {k for a, b in spans for k in range(a, b)} == hit
    assert found == wanted
    assert spans == sorted(spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


@settings(deadline=None, max_examples=100)
@given(st.lists(LETTERS, max_size=4), LETTERS)
def test_cleaned_texts_have_no_window(items, text):
    known = d.Automaton([(str(i), t.encode()) for i, t in enumerate(items)], 3)
    left = d.clean(known, text.encode(), 1.0)
    assert left is not None and known.spans(left.translate(d.TO_WORDS).split())[0] == []


@pytest.fixture(scope="module")
def tables(spark, docs, prose):
    item, short = prose(40, 1, 10**5), "quite Short, one"
    items = [(1, item), (2, item), (10, short), (3, None), (None, item), (4, " ,.; "), (5, "ünï " * 12), (5, "other words of five")]
    passage = " ".join(item.split()[7:20]).upper().replace(" ", ", ")
    rows = [
        (1, prose(60, 2) + "\n" + passage + ".\n" + prose(60, 3)),
        (2, passage),
        (3, prose(50, 4) + " Quite, short! ONE."),
        (4, None),
        (5, ""),
        (6, prose(80, 5)),
        (7, " ".join(item.split()[:9])),
        (8, "x ünï ünï ünï ünï ünï ünï ünï ünï ünï ünï y"),
        (None, passage),
        (1, prose(50_000, 6, 10**6) + " " + passage),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    return docs(rows, extra=("y",)).withColumnRenamed("_0", "found"), bench, items


def test_contamination_of_documents(spark, tables):
    docs, bench, items = tables
    named = [(str(i), t) for i, t in items if i is not None]
    out = d.contamination(spark, docs.drop("found"), bench)
    for r in out.select("text", "found", d.covered(F.col("found.spans")).alias("n")).collect():
        n, hit, found = brute(r.text, named, 10)
        assert (r.found.n_words, r.n, r.found["items"]) == (n, len(hit), sorted(found))


def test_parts_of_items_change_nothing(spark, tables, monkeypatch):
    docs, bench, _ = tables
    digest = F.sha2(F.concat_ws(",", "found.items"), 256)
    columns = ["text", "found.n_words", d.covered(F.col("found.spans")), digest]
    whole = d.contamination(spark, docs.drop("found"), bench).select(columns).collect()
    monkeypatch.setattr(d.parts, "__defaults__", (300,))
    assert len(list(d.parts(spark, bench, 10))) > 1
    split = d.contamination(spark, docs.drop("found"), bench).select(columns).collect()
    assert sorted(map(str, split)) == sorted(map(str, whole))
    assert hashlib.sha256(b"").hexdigest() in {r[3] for r in whole}


def test_spans_are_cut_and_mostly_copied_documents_go(spark, tables):
    docs, bench, _ = tables
    out = d.decontaminate(spark, docs, bench)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "3", "4", "5", "6", "7", "1"])
    for r in rows:
        assert r.n_chars == (None if r.text is None else len(r.text))
    kept = {r.text for r in docs.where("doc_id in (5, 6, 7)").collect()}
    assert kept <= {r.text for r in rows}
    assert d.contamination(spark, out.drop("found"), bench).where("size(found.spans) > 0").count() == 0


def test_parts_cut_what_one_part_cuts(spark, docs, prose, monkeypatch):
    names = [f"item{i}" for i in range(8)]
    texts = [prose(12, 50 + i, 10**6) for i in range(8)]
    chained = texts[0].split()
    texts[1] = " ".join(chained[6:] + texts[1].split()[6:])  # overlaps with item 0
    own = prose(40, 70, 10**6).split()
    rows = [(0, " ".join([*own, *chained[:6], *texts[1].split()]))]  # a span of two items, the first short of a window
    rows += [(1 + k, " ".join([texts[0], texts[k], *own[:16]])) for k in range(2, 8)]  # 24 of 40 words, 12 each
    rows += [(10 + k, " ".join([*own, *chained[:5], texts[k], *chained[5:]])) for k in range(2, 8)]  # a cut makes a window
    rows += [(30, None), (31, " ".join(own)), (32, " ".join([*own, *chained, *texts[1].split()[6:]]))]
    given_docs = docs(rows, extra=("y",)).withColumnRenamed("_0", "found")
    bench = spark.createDataFrame(list(zip(names, texts)), "item_id string, text string")
    whole = d.decontaminate(spark, given_docs, bench).collect()
    monkeypatch.setattr(d.parts, "__defaults__", (200,))
    assert len(list(d.parts(spark, bench, 10))) > 1
    split = d.decontaminate(spark, given_docs, bench)
    assert split.columns == given_docs.columns
    assert sorted(map(str, split.collect())) == sorted(map(str, whole))
    ids = {r.doc_id for r in whole}
    assert ids & set(range(3, 9)) == set() and {30, 31, 32} < ids


def test_empty_tables(spark, docs, tables):
    _, bench, _ = tables
    assert d.contamination(spark, docs([]), bench).count() == 0
    none = d.contamination(spark, docs([(1, "a b")]), bench.limit(0)).first()
    assert (none.found.n_words, none.found.spans, none.found["items"]) == (2, [], [])
    assert d.decontaminate(spark, docs([(1, "a b")]), bench.limit(0)).first().text == "a b"
