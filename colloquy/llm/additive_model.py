"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins; a feature's effect is a table with a number per bin, an
interaction's a table with a number per pair of (coarser) bins. The tables are learned by cyclic
boosting: round after round, each feature in turn gets a shallow tree of at most four leaves on the
current gradient, shrunk and added to its table; so credit is shared among correlated features. Then
the pairs whose two-by-two split explains most of what is left are boosted in the same way. A score is
the intercept plus one look-up per table, for all texts of a chunk at once.

The tables are trained in one task on a bounded sample of the labelled rows, about ``SAMPLE``, dealt by a
hash of the id. Features of all texts are computed once and written.

Defined results
* null or empty text: all features 0, scored like any text.
* no labels to learn from: every score is 0.5; one class only: the smoothed share of that class.
* labels without id or quality: not used; several of one id: the lowest quality counts.
* null doc_id: scored, never learned from. Repeated rows: scored as often as they occur.
* an empty table: no rows.
"""

import io
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import Texts, Words, chunks
from .quality_rules import measure
from .shared import Scratch

SAMPLE = 20_000
BINS, COARSE = 64, 16
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 6
RATE, PENALTY, LEAST = 0.1, 1.0, 5.0  # shrinkage; ridge on a leaf; weight of a leaf at least

NAMES = (
    "log_words", "word_length", "symbols", "upper", "marks", "repeats", "dup_lines", "line_words",
    "distinct", "digits", "points", "wide", "pipes", "longest",
)
SCHEMA = ", ".join(f"{n} double" for n in NAMES)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


DIGITS, POINTS, PIPES = _mask(b"0123456789"), _mask(b".,;:"), _mask(b"|")
WIDE = np.arange(256) >= 0x80


def features(column: pa.Array) -> np.ndarray:
    """A row of ``NAMES`` for each text."""
    c = measure(column)
    texts = Texts(column)
    words = Words(texts)
    hashes = words.hashes(texts.data)
    order = np.lexsort((hashes, words.doc))
    new = np.ones(len(hashes), bool)
    new[1:] = (np.diff(words.doc[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])
    distinct = np.bincount(words.doc[order][new], minlength=texts.n)
    longest = np.zeros(texts.n)
    np.maximum.at(longest, words.doc, words.last - words.first)
    n, chars = np.maximum(1, c["n_words"]), np.maximum(1, c["word_chars"])
    lines, size = np.maximum(1, c["n_lines"]), np.maximum(1, np.diff(texts.at))
    return np.stack(
        [
            np.log1p(c["n_words"]),
            c["word_chars"] / n,
            c["n_symbols"] / n,
            c["n_upper"] / chars,
            c["n_marks"] / n,
            c["n_repeat_words"] / n,
            c["n_dup_lines"] / lines,
            c["n_words"] / lines,
            distinct / n,
            texts.sums(DIGITS[texts.data]) / size,
            texts.sums(POINTS[texts.data]) / n,
            texts.sums(WIDE[texts.data]) / size,
            texts.sums(PIPES[texts.data]) / n,
            np.log1p(longest),
        ],
        axis=1,
    )


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + PENALTY)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + PENALTY)


def _split(g: np.ndarray, h: np.ndarray) -> int:
    """The bin before which a run of bins is best cut in two; 0 if it is better left whole."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = _gain(left_g, left_h) + _gain(right_g, right_h) - _gain(g.sum(), h.sum())
    gain = np.where((left_h * 4 >= LEAST) & (right_h * 4 >= LEAST), gain, 0)
    best = int(np.argmax(gain)) if len(gain) else 0
    return best + 1 if len(gain) and gain[best] > 1e-9 else 0


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of a tree of depth two over the bins."""
    out, cut = np.zeros(len(g)), _split(g, h)
    for a, b in ((0, cut), (cut, len(g))) if cut else ((0, len(g)),):
        mid = _split(g[a:b], h[a:b])
        for c, d in ((a, a + mid), (a + mid, b)) if mid else ((a, b),):
            out[c:d] = _leaf(g[c:d].sum(), h[c:d].sum())
    return out


def square_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values per cell of the best cut of a table by one row and one column, and its gain."""
    G, H = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)
    tg, th = G[-1, -1], H[-1, -1]
    quarters = []
    for q, t in ((G, tg), (H, th)):
        a = q[:-1, :-1]
        b, c = q[:-1, -1:] - a, q[-1:, :-1] - a
        quarters.append((a, b, c, t - a - b - c))
    gain = sum(_gain(x, y) for x, y in zip(*quarters)) - _gain(tg, th)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for columns in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, columns] = _leaf(g[rows, columns].sum(), h[rows, columns].sum())
    return out, float(gain[i, j])


class Additive:
    """Intercept, cuts of each feature, its table, and the tables of pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        grid = np.linspace(0, 1, BINS + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, f], grid)) if len(x) else np.zeros(0) for f in range(x.shape[1])]
        bins = self.bins(x)
        self.tables = [np.zeros(BINS) for _ in self.cuts]
        self.pairs: list[tuple[int, int, np.ndarray]] = []
        if not len(y) or y.min() == y.max():
            return
        z = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for f in range(len(self.cuts)):
                p = sigmoid(z)
                g = np.bincount(bins[:, f], y - p, BINS)
                h = np.bincount(bins[:, f], p * (1 - p), BINS)
                step = RATE * shallow_tree(g, h)
                self.tables[f] += step
                z += step[bins[:, f]]
        coarse = bins * COARSE // BINS
        p = sigmoid(z)
        found = []
        for a, b in combinations(range(len(self.cuts)), 2):
            cell = coarse[:, a] * COARSE + coarse[:, b]
            g, h = (np.bincount(cell, v, COARSE * COARSE).reshape(COARSE, COARSE) for v in (y - p, p * (1 - p)))
            found.append((square_tree(g, h)[1], a, b, cell))
        found.sort(key=lambda f: (-f[0], f[1], f[2]))
        chosen = [[a, b, cell, np.zeros((COARSE, COARSE))] for _, a, b, cell in found[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for pair in chosen:
                p = sigmoid(z)
                g, h = (np.bincount(pair[2], v, COARSE * COARSE).reshape(COARSE, COARSE) for v in (y - p, p * (1 - p)))
                step = RATE * square_tree(g, h)[0]
                pair[3] += step
                z += step.ravel()[pair[2]]
        self.pairs = [(a, b, table) for a, b, _, table in chosen]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(cut, x[:, f], "right") for f, cut in enumerate(self.cuts)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        z = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            z += table[bins[:, f]]
        coarse = bins * COARSE // BINS
        for a, b, table in self.pairs:
            z += table[coarse[:, a], coarse[:, b]]
        return sigmoid(z)


def with_features(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                x = features(chunk.column(1))
                columns = [pa.array(np.ascontiguousarray(x[:, f])) for f in range(len(NAMES))]
                yield pa.RecordBatch.from_arrays([chunk.column(0), *columns], ["doc_id", *NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def classify(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, train_on: Column, total: int = SAMPLE
) -> DataFrame:
    """``doc_id, held_out, score`` for each row; ``train_on``, of doc_id, says which labels may be used."""
    scratch = Scratch(spark, "additive-model")
    rows = scratch.keep(with_features(docs), "features")
    may = F.coalesce(train_on, F.lit(False))
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & may)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    n = known.count()
    dealt = F.pmod(F.xxhash64(F.lit(19), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(known.where(dealt < min(1.0, total / max(1, n))), "doc_id")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", *NAMES], kind="stable")
        model = Additive(group[list(NAMES)].to_numpy(float), (group["quality"].to_numpy() == 1).astype(float))
        out = io.BytesIO()
        np.savez(
            out,
            base=model.base,
            sizes=np.array([len(c) for c in model.cuts]),
            cuts=np.concatenate(model.cuts),
            tables=np.stack(model.tables),
            pairs=np.array([[a, b] for a, b, _ in model.pairs], np.int64).reshape(-1, 2),
            grids=np.array([t for _, _, t in model.pairs]).reshape(-1, COARSE, COARSE),
        )
        return pd.DataFrame({"model": [out.getvalue()]})

    found = sample.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(fit, "model binary").first()
    sent = spark.sparkContext.broadcast(bytes(found["model"]) if found else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(sent.value)
        for batch in batches:
            if batch.num_rows:
                x = np.stack([np.asarray(c) for c in batch.columns[2:]], axis=1)
                score = model.scores(x) if model else np.full(len(x), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = rows.select("doc_id", (~may).alias("held_out"), *NAMES)
    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")


def loaded(raw: bytes | None) -> Additive | None:
    if raw is None:
        return None
    held, model = np.load(io.BytesIO(raw)), Additive.__new__(Additive)
    model.base = float(held["base"])
    model.cuts = np.split(held["cuts"], np.cumsum(held["sizes"])[:-1])
    model.tables = list(held["tables"])
    model.pairs = [(int(a), int(b), t) for (a, b), t in zip(held["pairs"], held["grids"])]
    return model
