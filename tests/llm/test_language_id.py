"""The steps of language identification against plain loops over single numbers."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colloquy.llm import language_id as li

TEXTS = ["", "A b", "Ünïcode, 12 words!", "aaa aaa", "one two three one", None, "\U0001f600 x"]
MASK = (1 << 64) - 1


def buckets(text):
    """The features of a text, one n-gram after the other."""
    points = [ord(c) if c.isalpha() else 0x20 for c in (text or "").lower()]
    out = []
    for order in range(1, li.ORDERS + 1):
        for i in range(len(points) - order + 1):
            key = order
            for k in range(order):
                key = ((key + points[i + k]) * int(li.FACTORS[k])) & MASK
                key ^= key >> 29
            out.append(((key * int(li.FACTORS[0])) & MASK) >> (64 - li.BITS))
    return out


def test_features():
    grams = li.Grams(pa.array(TEXTS, pa.string()))
    for i, text in enumerate(TEXTS):
        assert grams.of(i).tolist() == buckets(text)
        assert grams.letters[i] == sum(c.isalpha() for c in (text or "").lower())
    table = np.random.default_rng(1).normal(size=li.BUCKETS)
    assert grams.sums(table) == pytest.approx([sum(table[b] for b in buckets(t)) for t in TEXTS])


def plain_ftrl(samples, classes, seed=1):
    """Follow-the-regularised-leader, proximal, as published: one coordinate at a time."""
    z, n, w = {}, {}, {}
    rng = np.random.default_rng(seed)
    for _ in range(li.EPOCHS):
        for s in rng.permutation(len(samples)):
            j, x, y = samples[s]
            for c in range(classes):
                for f in j:
                    zi, ni = z.get((c, f), 0.0), n.get((c, f), 0.0)
                    if abs(zi) <= li.L1:
                        w[c, f] = 0.0
                    else:
                        w[c, f] = -(zi - math.copysign(li.L1, zi)) / ((li.BETA + math.sqrt(ni)) / li.ALPHA + li.L2)
            logits = [sum(w[c, f] * v for f, v in zip(j, x)) for c in range(classes)]
            top = max(logits)
            e = [math.exp(v - top) for v in logits]
            for c in range(classes):
                miss = e[c] / sum(e) - (c == y)
                for f, v in zip(j, x):
                    g, old = miss * v, n.get((c, f), 0.0)
                    sigma = (math.sqrt(old + g * g) - math.sqrt(old)) / li.ALPHA
                    z[c, f] = z.get((c, f), 0.0) + g - sigma * w[c, f]
                    n[c, f] = old + g * g
    out = {}
    for (c, f), zi in z.items():
        shrunk = max(abs(zi) - li.L1, 0.0)
        out[c, f] = -math.copysign(shrunk, zi) / ((li.BETA + math.sqrt(n[c, f])) / li.ALPHA + li.L2)
    return out


def test_weights_are_those_of_the_plain_algorithm():
    rng, samples = np.random.default_rng(4), []
    for i in range(60):
        j = np.sort(rng.choice(40, size=rng.integers(1, 9), replace=False))
        samples.append((np.append(j, li.BUCKETS), np.append(rng.random(len(j)) * 3, 1.0), int(j[0] % 3)))
    got, want = li.train(samples, 3), plain_ftrl([(j.tolist(), x.tolist(), y) for j, x, y in samples], 3)
    for (c, f), value in want.items():
        assert got[c, f] == pytest.approx(value, abs=1e-9)
    used = {f for _, f in want}
    assert not got[:, [f for f in range(200) if f not in used]].any()
    assert any(v == 0 for v in want.values())  # the penalty leaves weights at zero


def test_temperature_is_the_likeliest_of_many():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 400)
    logits = rng.normal(size=(400, 3))
    logits[np.arange(400), y] += 2
    target = np.full((400, 3), 1 / 403)
    target[np.arange(400), y] += 400 / 403

    def loss(t):
        return -(target * np.log(li.softmax(3 * logits / t))).sum(axis=1).mean()

    found = li.temperature(3 * logits, y)
    assert loss(found) <= min(loss(t) for t in np.geomspace(0.05, 20, 400)) + 1e-6


def test_scores_of_whole_texts(spark, docs, monkeypatch):
    """Probabilities from weights that are given, n-gram by n-gram."""
    rng = np.random.default_rng(3)
    w = rng.normal(size=(2, li.BUCKETS + 1)).astype(np.float32)
    monkeypatch.setattr(li, "fitted", lambda sample, idf: (["de", "en"], w, 1.5))
    long = "the quick brown fox " * 40_000
    rows = [(i, t, "en", "s") for i, t in enumerate([*TEXTS, long])]
    given = docs(rows, extra=("z",)).withColumnRenamed("_0", "score")
    got = {r.doc_id: r for r in li.identify(spark, given, F.lit(True)).collect()}
    learned = [t for _, t, _, _ in rows if t is not None]
    df = np.zeros(li.BUCKETS)
    for t in learned:
        df[list(set(buckets(t)))] += 1
    idf = np.log((1 + len(learned)) / (1 + df))
    for i, text, _, _ in rows:
        own = buckets(text)
        if not any(c.isalpha() for c in text or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        share = {b: c / len(own) for b, c in Counter(own).items()}
        logits = [sum(li.SCALE * v * idf[b] * float(w[c, b]) for b, v in share.items()) + float(w[c, -1]) for c in range(2)]
        e = [math.exp(v / 1.5) for v in logits]
        assert got[i].score == pytest.approx(max(e) / sum(e), rel=1e-3)
        assert got[i].lang_pred == ("de", "en")[int(e[1] > e[0])]
