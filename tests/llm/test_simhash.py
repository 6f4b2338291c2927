import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import simhash as sh


def fingerprint(text):
    """Bit by bit, from the statement of the contract."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, links):
    up = {x: x for x in fps}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in fps}


def within(fps, far=2):
    return [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= far]


def near_and_far(n, seed):
    """Numbers with chains of neighbours, a dense ball and many that are alone."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)}
    for x in list(out)[: n // 2]:
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(64)
            out.add(x)
    centre = rng.getrandbits(64)
    out |= {centre ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)}
    return sorted(out)


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet="aB \n\té.\x0b1", max_size=60))
def test_fingerprint(text):
    assert sh.fingerprint(text.encode()) == fingerprint(text)


def test_fingerprint_of_a_text_of_many_blocks(monkeypatch, prose):
    text = prose(500, 3)
    monkeypatch.setattr(sh, "BLOCK", 64)
    assert sh.fingerprint(text.encode()) == fingerprint(text)


@pytest.mark.parametrize("least", [1, 8, 60, 10**9])
def test_every_pair_meets_once_in_one_home(least, monkeypatch):
    monkeypatch.setattr(sh, "PIECE", 256)
    fps = np.array(near_and_far(400, least), np.uint64)
    tree = sh.Tree(fps[::3], least)
    rows, shard, guest = tree.routed(fps)
    assert sorted(rows[~guest].tolist()) == list(range(len(fps)))
    met = []
    for s in range(tree.shards):
        own = np.concatenate([rows[(shard == s) & ~guest], rows[(shard == s) & guest]])
        homes = int(((shard == s) & ~guest).sum())
        for a, b in sh.links(fps[own[:homes]], fps[own]):
            once = a < b
            met += [tuple(sorted(p)) for p in zip(fps[own[a[once]]].tolist(), fps[own[b[once]]].tolist())]
    assert sorted(met) == sorted(within(fps.tolist()))


def test_a_shard_hands_on_a_spanning_forest():
    fps = near_and_far(300, 9)
    table = pa.table({"fp": np.array(fps, np.uint64).view(np.int64), "rep": np.arange(len(fps)), "guest": np.arange(len(fps)) % 7 == 0})
    out = sh.shard_links(table)
    links = [(fps[a], fps[b]) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())]
    homes = {x for i, x in enumerate(fps) if i % 7}
    want = components(fps, [(a, b) for a, b in within(fps) if a in homes or b in homes])
    assert components(fps, links) == want
    assert len(links) == len(fps) - len(set(want.values()))


def test_points_that_cannot_be_divided_are_one_shard():
    assert sh.Tree(np.array([5] * 50, np.uint64), 1).shards == 1
    assert sh.Tree(np.zeros(0, np.uint64), 1).shards == 1
    rows, shard, guest = sh.Tree(np.arange(64, dtype=np.uint64), 4).routed(np.zeros(0, np.uint64))
    assert len(rows) == len(shard) == len(guest) == 0


def brute(rows):
    fps = [(i, fingerprint(t)) for i, t in rows if i is not None]
    links = [(i, j) for n, (i, a) in enumerate(fps) for j, b in fps[:n] if (a ^ b).bit_count() <= 2]
    return components([i for i, _ in fps], links)


@pytest.mark.parametrize("sizes", [{}, {"shard": 16, "sampled": 2}])
def test_components_are_those_of_all_pairs(spark, docs, prose, sizes, monkeypatch):
    monkeypatch.setattr(sh, "LEAST_POINTS", 4)
    base = prose(2000, 1).split()
    rows = []
    for s in range(60):  # one or two words changed: few bits, often none or one, two, three
        words = list(base)
        for k in random.Random(s).sample(range(len(words)), s % 4):
            words[k] = f"n{s}"
        rows.append((100 + s, " ".join(words)))
    rows += [(300 + s, prose(3 + s % 4, 900 + s)) for s in range(80)] + [(500 + s, "Same  text") for s in range(40)]
    rows += [(1, None), (2, ""), (3, " \n "), (600, "same\ttext"), (700, prose(50, 5)), (700, prose(3, 900)), (None, "same text"), (None, None)]
    random.Random(0).shuffle(rows)
    given_docs = docs(rows, extra=("x",)).withColumnRenamed("_0", "fp")
    got = sh.near_duplicates(spark, given_docs, **sizes).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert all(r.component_id == (None if r.doc_id is None else want[r.doc_id]) for r in got)
    prints = sorted((r.doc_id or -1, r.fp % (1 << 64)) for r in got)
    assert prints == sorted((i or -1, fingerprint(t)) for i, t in rows)


def test_very_long_text_and_empty_table(spark, docs, prose):
    long = prose(60_000, 4, 10**6)
    (row,) = sh.near_duplicates(spark, docs([(1, long)])).collect()
    assert (row.fp % (1 << 64), row.component_id) == (fingerprint(long), 1)
    assert sh.near_duplicates(spark, docs([])).count() == 0
