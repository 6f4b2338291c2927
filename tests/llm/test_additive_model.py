"""Boosted tables against plain loops over rows and bins."""

import math

import numpy as np
import pytest

from colloquy.llm import additive_model as am


def leaf(g, h):
    return g / (h + am.PENALTY)


def gain(g, h):
    return g * g / (h + am.PENALTY)


def cut(g, h):
    """Where a run of bins gains most from being cut in two; 0 if nowhere."""
    best, at, lg, lh = 0.0, 0, 0.0, 0.0
    for i in range(1, len(g)):
        lg, lh = lg + g[i - 1], lh + h[i - 1]
        rg, rh = sum(g) - lg, sum(h) - lh
        if 4 * lh >= am.LEAST and 4 * rh >= am.LEAST:
            found = gain(lg, lh) + gain(rg, rh) - gain(sum(g), sum(h))
            if found > best + 1e-12:
                best, at = found, i
    return at if best > 1e-9 else 0


def tree(g, h):
    ends, out = [0, len(g)], [0.0] * len(g)
    for _ in range(2):
        more = []
        for a, b in zip(ends[:-1], ends[1:]):
            at = cut(g[a:b], h[a:b])
            more += [a + at] if at else []
        if not more:
            break
        ends = sorted([*ends, *more])
    for a, b in zip(ends[:-1], ends[1:]):
        for i in range(a, b):
            out[i] = leaf(sum(g[a:b]), sum(h[a:b]))
    return out


def square(g, h, n):
    """Values and gain of the best cut of a table (by (row, column)) by one row and one column."""
    best = None
    for i in range(1, n):
        for j in range(1, n):
            parts = {}
            for (r, c), v in g.items():
                key = r >= i, c >= j
                a, b = parts.get(key, (0.0, 0.0))
                parts[key] = a + v, b + h[r, c]
            found = sum(gain(*p) for p in parts.values()) - gain(sum(g.values()), sum(h.values()))
            if best is None or found > best[0] + 1e-12:
                best = found, i, j, parts
    found, i, j, parts = best
    return found, lambda r, c: leaf(*parts.get((r >= i, c >= j), (0.0, 0.0)))


def boosted(x, y, cuts, rounds, pair_rounds, pairs):
    """Scores of the rows that are learned from."""
    share = (sum(y) + 1) / (len(y) + 2)
    z = [math.log(share / (1 - share))] * len(y)
    bins = [[sum(v >= c for c in own) for v, own in zip(row, cuts)] for row in x]

    def gradients():
        p = [1 / (1 + math.exp(-v)) for v in z]
        return [(t - q, q * (1 - q)) for t, q in zip(y, p)]

    for _ in range(rounds):
        for f in range(len(cuts)):
            g, h = [0.0] * am.BINS, [0.0] * am.BINS
            for own, (a, b) in zip(bins, gradients()):
                g[own[f]] += a
                h[own[f]] += b
            step = tree(g, h)
            z = [v + am.RATE * step[own[f]] for v, own in zip(z, bins)]

    def cells(a, b):
        return [(own[a] * am.COARSE // am.BINS, own[b] * am.COARSE // am.BINS) for own in bins]

    def fitted(a, b):
        g, h = {}, {}
        for cell, (u, v) in zip(cells(a, b), gradients()):
            g[cell], h[cell] = g.get(cell, 0.0) + u, h.get(cell, 0.0) + v
        return square(g, h, am.COARSE)

    found = sorted((-fitted(a, b)[0], a, b) for a in range(len(cuts)) for b in range(a + 1, len(cuts)))
    for _ in range(pair_rounds):
        for _, a, b in found[:pairs]:
            value = fitted(a, b)[1]
            z = [v + am.RATE * value(*cell) for v, cell in zip(z, cells(a, b))]
    return [1 / (1 + math.exp(-v)) for v in z]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scores_are_those_of_the_plain_algorithm(monkeypatch, seed):
    for name, value in (("ROUNDS", 6), ("PAIR_ROUNDS", 3), ("PAIRS", 2), ("BINS", 16), ("COARSE", 4)):
        monkeypatch.setattr(am, name, value)
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(150, 3))
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=150) / 3) > 0).astype(float)
    model = am.Additive(x, y)
    grid = np.linspace(0, 1, am.BINS + 1)[1:-1]
    for f, own in enumerate(model.cuts):
        assert own == pytest.approx(np.quantile(x[:, f], grid))
    want = boosted(x.tolist(), y.tolist(), [c.tolist() for c in model.cuts], 6, 3, 2)
    assert model.scores(x) == pytest.approx(want, abs=1e-9)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.75


def test_a_score_is_a_sum_of_look_ups():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    model = am.Additive(x, (x[:, 0] > x[:, 1]).astype(float))
    new = rng.normal(size=(50, 4))
    for row, score in zip(new, model.scores(new)):
        bins = [sum(v >= c for c in own) for v, own in zip(row, model.cuts)]
        z = model.base + sum(table[b] for table, b in zip(model.tables, bins))
        z += sum(table[bins[a] * am.COARSE // am.BINS, bins[b] * am.COARSE // am.BINS] for a, b, table in model.pairs)
        assert score == pytest.approx(1 / (1 + math.exp(-z)))
