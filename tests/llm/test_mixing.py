import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import mixing as m


def level(sizes, weights, cap=3):
    """Targets by sharing again and again until none is above its cap."""
    order = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    w = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [k for k in order if k not in fixed]
        left = total - sum(fixed.values())
        share = {k: left * w[k] / sum(w[j] for j in open_) for k in open_}
        above = [k for k in open_ if share[k] > cap * sizes[k]]
        if not above:
            return {**fixed, **share}
        fixed.update({k: cap * sizes[k] for k in above})


@settings(deadline=None, max_examples=12)
@given(st.dictionaries(st.one_of(st.none(), st.sampled_from("abcdefg")), st.integers(0, 1000), min_size=1))
def test_targets(spark, sizes):
    if not sum(sizes.values()):
        return
    rows = [("n" if k is None else f"s{k}", v) for k, v in sizes.items()]
    got = {r["key"]: r.target for r in m.targets(spark.createDataFrame(rows, "key string, source_size long")).collect()}
    want = level(sizes, m.WEIGHTS)
    for k, v in want.items():
        assert got["n" if k is None else f"s{k}"] == pytest.approx(v, rel=1e-12, abs=1e-9)


def test_quotas_are_exact_and_disjoint():
    drawings = np.array([700, 0, 41, 3])
    for shards in (1, 2, 7, 16):
        parts = [m.quotas(s, shards, drawings, 5) for s in range(shards)]
        assert (sum(have for _, have in parts) == drawings).all()
        end = np.zeros(4, int)
        for before, have in parts:
            assert (before == end).all() and (have >= 0).all()
            end = end + have
        sizes = [have.sum() for _, have in parts]
        assert max(sizes) - min(sizes) <= 1


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(4), []
    for i in range(600):
        source = rng.choices(["b", "a", "é", None, "Z"], [60, 10, 10, 3, 1])[0]
        out.append((i, " ".join(["w"] * rng.randint(0, 60)), "en", source))
    out += [(1000, None, "en", "a"), (1001, "w " * 5000, None, "b"), (None, "w w", "en", "b"), (7, out[7][1], "en", out[7][3])]
    return out + [(1002, "", "en", "empty")]


def test_sources_come_near_their_targets(spark, docs, rows):
    got = m.mix_table(spark, docs(rows), block_words=500).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len((text or "").split())
    want, taken = level(dict(sizes), m.WEIGHTS), Counter()
    for r in got:
        assert 0 <= r.copies <= 3 and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.size * r.copies
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(30, 0.02 * target)


def test_rows_of_the_mix(spark, docs, rows):
    table = docs(rows, extra=("z",)).withColumnRenamed("_0", "_key")
    mixed = m.mix(spark, table, block_words=500, shard_words=2000, shard="shard")
    assert mixed.columns == [*table.columns, "shard"]
    out = mixed.collect()
    assert out == mixed.collect()  # and a new plan gives the same rows in each shard
    again = m.mix(spark, table, block_words=500, shard_words=2000, shard="shard").collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    copies = Counter()
    for r in m.mix_table(spark, docs(rows), block_words=500).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in out) == {k: v for k, v in copies.items() if v}
    shards = Counter()
    for r in out:
        shards[r.shard] += len((r.text or "").split())
    assert len(shards) > 3
    mixed_ones = sum(len({r.source for r in out if r.shard == s}) > 1 for s in shards)
    assert mixed_ones >= len(shards) / 2


def test_empty(spark, docs):
    assert m.mix_table(spark, docs([])).count() == 0
    assert m.mix(spark, docs([])).count() == 0
    assert m.mix_table(spark, docs([(1, None), (2, "")])).agg({"copies": "sum"}).first()[0] == 0
