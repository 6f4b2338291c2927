import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import queries, runs
from colloquy.llm.flat import Texts


def brute(words, least=6, times=4):
    """Runs by comparing the words a period apart, for every period."""
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                part = words[i : j + q]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, len(part), q))
            i = max(i + 1, j)
    return sorted(out)


def in_text(text, least=runs.LEAST, times=runs.TIMES):
    return runs.text_runs(Texts(pa.array([text, "x y", None])), least, times)[1][0]


PERIODIC = st.builds(
    lambda head, part, n, tail: head + part * n + part[: n % len(part)] + tail,
    st.lists(st.integers(0, 3), max_size=12),
    st.lists(st.integers(0, 2), min_size=1, max_size=6),
    st.integers(1, 7),
    st.lists(st.integers(0, 3), max_size=12),
)


@settings(deadline=None, max_examples=300)
@given(PERIODIC, st.sampled_from([(6, 4), (2, 2), (3, 3), (9, 2)]))
def test_runs_are_those_of_all_periods(ids, kind):
    want = brute(ids, *kind)
    assert runs.squares(ids, *kind) == want
    assert in_text(" ".join(f"w{x}" for x in ids), *kind) == want


def test_long_runs_and_strings_that_are_hard_for_the_automaton():
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 2000:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    rng = random.Random(3)
    for ids in ([7] * 2000, [i % 300 for i in range(2000)], fibonacci[-1][:2000], [rng.randrange(2) for _ in range(2000)]):
        assert runs.squares(ids, 2, 2) == brute(ids, 2, 2)
        assert runs.squares(ids) == brute(ids)


def test_collapsed_keeps_the_first_period():
    text = "say a b\ta b\n a b a b  a end"
    assert in_text(text) == [(1, 9, 2)]
    assert runs.collapsed(text.encode(), in_text(text)) == b"say a b end"


def test_defined_results(spark, docs):
    long = "one two three " * 40_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 6), (4, "a " * 6), (None, "a " * 5), (5, "A a " * 6), (6, long), (7, "\0 é " * 9)]
    given_docs = docs(rows, extra=("x",)).withColumnRenamed("_0", "runs")
    got = {}
    for r in runs.find_runs(given_docs).collect():
        got.setdefault(r.doc_id, []).append(([tuple(x) for x in r.runs], r.n_words, r.collapsed))
    assert got[1] == got[2] == got[3] == [([], 0, "")]
    assert got[4] == [([(0, 6, 1)], 6, "a")] * 2
    assert got[None] == [([], 5, "a a a a a")]
    assert got[5] == [([(0, 12, 2)], 12, "A a")]
    assert got[6] == [([(0, 120_000, 3)], 120_000, "one two three")]
    assert got[7] == [([(0, 18, 2)], 18, "\0 é")]
    assert runs.find_runs(docs([])).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(given_docs, times=1)


def test_plan_moves_nothing(spark, docs):
    assert "Exchange" not in runs.find_runs(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()


def expected(doc_id, text):
    """The contract of op11, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    rest = " ".join(w for i, w in enumerate(words) if i not in gone)
    digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, rest)]
    row = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *row, *digests)


def test_query_against_brute_force(spark, docs, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 90)))) for i in range(400)]
    rows += [(1000 + i, "x y\n" * rng.randrange(0, 30)) for i in range(100)] + [(2000, None), (2001, "")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((expected(*r) for r in rows), key=str)
