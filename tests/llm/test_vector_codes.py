import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from colloquy.llm import vector_codes as vc

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()),
    ]
)


def brute(rows, entries=64, rounds=2):
    """Codes by (id, place), codebooks, from the statement of the contract in plain numbers."""
    kept = [(i, e) for i, e, _ in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    width = -(-max((len(e) for _, e in kept), default=1) // 16) * 16 or 16
    w = width // 16
    ints = [[math.floor(256 * float(np.float32(x))) for x in e] + [0] * (width - len(e)) for _, e in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    codes, errors, books = [[] for _ in kept], [0] * len(kept), []
    for p in range(16):
        parts = [v[p * w : (p + 1) * w] for v in ints]
        book = [parts[k] for k in order[:entries]]

        def nearest(part, book=book):
            return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))

        for _ in range(rounds):
            own = [nearest(x, book)[1] for x in parts]
            for j in range(len(book)):
                mine = [x for x, o in zip(parts, own) if o == j]
                book[j] = [sum(c) // len(mine) for c in zip(*mine)] if mine else book[j]
        for k, x in enumerate(parts):
            d, j = nearest(x, book)
            codes[k].append(j)
            errors[k] += d
        books.append(book)
    return [(i, bytes(c).hex(), e) for (i, _), c, e in zip(kept, codes, errors)], books


def rows_of(n, width, seed, kinds=None):
    rng = random.Random(seed)
    vectors = [[rng.gauss(0, 0.2) for _ in range(width)] for _ in range(kinds or n)]
    return [(i, vectors[i % len(vectors)], rng.choice([None, 1, 2])) for i in rng.sample(range(10 * n), n)]


def result(spark, rows, partitions=3, **sizes):
    df = spark.createDataFrame(rows, VECTORS).repartition(partitions)
    codes, books = vc.compress(spark, df, **sizes)
    return [(r.vec_id, r.codes.hex(), r.error) for r in codes.collect()], books


def key(row):
    return (row[0] is None, *map(str, row))


@pytest.mark.parametrize("n, width, kinds, block", [(300, 32, None, 64), (500, 16, 40, 8192), (40, 64, None, 16), (200, 48, 3, 50)])
def test_codes_and_books(spark, n, width, kinds, block):
    rows = rows_of(n, width, n, kinds)
    got, books = result(spark, rows, block=block)
    want, plain = brute(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert books.tolist() == plain
    assert vc.digest(books) == hashlib.sha256(",".join(str(x) for b in plain for e in b for x in e).encode()).hexdigest()


def test_ties_go_to_the_lower_entry(spark):
    # all components are one of two values: many parts are as near to one entry as to another
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 1 / 128, 1 / 64]) for _ in range(32)], 1) for i in range(400)]
    got, books = result(spark, rows, block=128)
    want, plain = brute(rows)
    assert sorted(got) == sorted(want) and books.tolist() == plain


def test_defined_results(spark):
    good = rows_of(90, 32, 1)
    odd = [(1, None, 1), (2, [None] * 32, 1), (3, [float("nan")] * 32, 1), (4, [float("inf")] + [0.0] * 31, 1)]
    odd += [(5, [], None), (6, [0.5] * 7, None), (None, [0.25] * 32, 3), (good[0][0], good[0][1], 2), (good[0][0], good[1][1], 2)]
    rows = [*good, *odd]
    got, books = result(spark, rows)
    want, plain = brute(rows)
    assert sorted(got, key=key) == sorted(want, key=key) and books.tolist() == plain
    for few in ([], odd[:4]):
        got, books = result(spark, few)
        assert got == [] and books.size == 0
    got, books = result(spark, [(9, [], 1), (8, [], None)])
    assert sorted(got) == [(8, "00" * 16, 0), (9, "00" * 16, 0)]
    got, _ = result(spark, [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [0.0] * 16, 1)])
    assert sorted(c for _, c, _ in got) == ["00" * 16, "01" * 16, "02" * 16]
    with pytest.raises(ValueError):
        vc.compress(spark, spark.createDataFrame([], VECTORS), entries=257)


def test_errors_by_label_with_other_columns(spark):
    rows = rows_of(200, 32, 7)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], T.StructType([*VECTORS.fields, T.StructField("error", T.StringType()), T.StructField("codes", T.IntegerType())]))
    codes, _ = vc.compress(spark, df)
    out = vc.with_label_errors(codes).collect()
    labels = {i: label for i, _, label in rows}
    total = {}
    for r in out:
        total[labels[r.vec_id]] = total.get(labels[r.vec_id], 0) + r.error
    assert len(out) == 200 and None in total
    assert all(r.label_error == total[labels[r.vec_id]] for r in out)


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 200), st.integers(1, 5), st.integers(1, 30), st.integers(1, 40), st.integers(0, 99))
def test_tree_and_candidates(n, width, scale, leaf, seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-scale, scale + 1, (n, width))
    balls = vc.metric_tree(points, leaf)
    assert sorted(balls.rows.tolist()) == list(range(n))
    ordered = points[balls.rows]
    for i in range(len(balls.first)):
        own = ordered[balls.first[i] : balls.last[i]]
        assert own.sum(axis=0).tolist() == balls.sums[i].tolist()
        assert np.sqrt(((own - balls.centre[i]) ** 2).sum(axis=1)).max() <= balls.radius[i] + 1e-9
        if balls.one[i] >= 0:
            spans = [(balls.first[c], balls.last[c]) for c in (balls.one[i], balls.other[i])]
            assert spans == [(balls.first[i], spans[1][0]), (spans[0][1], balls.last[i])]
    entries = points[rng.integers(0, n, min(n, 20))]
    codes, sums, counts = vc.entered(vc.Balls.unpacked(balls.packed(), width), ordered, entries)
    want = ((ordered[:, None, :] - entries) ** 2).sum(axis=2).argmin(axis=1)
    assert codes.tolist() == want.tolist()
    assert counts.tolist() == np.bincount(want, minlength=len(entries)).tolist()
    for j in range(len(entries)):
        assert sums[j].tolist() == ordered[want == j].sum(axis=0).tolist()


def test_a_far_ball_is_owned_without_looking_at_its_points():
    points = np.concatenate([np.arange(200)[:, None], 10_000 + np.arange(200)[:, None]])
    balls = vc.metric_tree(points, 8)
    codes, sums, counts = vc.entered(balls, np.full_like(points, 5_000), np.array([[100], [10_100]]))
    assert counts.tolist() == [200, 200] and sums[:, 0].tolist() == [points[:200].sum(), points[200:].sum()]
