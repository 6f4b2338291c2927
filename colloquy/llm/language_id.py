"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 characters of the lower-cased text, with everything but letters read as a space, are
hashed into ``BUCKETS`` features; a feature's value is its share of the text's n-grams times its
inverse document frequency. Document frequencies are counted over all training documents, each task
adding up its own. The weights are trained by follow-the-regularised-leader with L1 and L2 penalties
on a bounded sample: about ``SAMPLE`` training documents, the same number of each language as far as
there are, dealt by a hash of the id; so a language with most of the rows does not crowd out the
others. A fifth of the sample is not trained on and sets the temperature that calibrates the
probabilities. Texts are scored where they lie.

Defined results
* null text, or a text without a letter: ``und`` with score 0.
* no labelled training document: ``und`` with score 0 for every text.
* null doc_id: dealt like an empty id. Repeated rows: learned from, and predicted, as often as they occur.
* an empty table: no rows.
"""

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import chunks

ORDERS = 3
BITS = 16
BUCKETS = 1 << BITS
SAMPLE = 6000
LEAST = 20  # documents per language, if there are so many
MOST_LANGUAGES = 1000
UND = "und"
SCALE = 20.0
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.05, 1e-3, 3
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
U = np.uint64
TABLES: dict[str, np.ndarray] = {}


def letters() -> np.ndarray:
    """Which code points are letters."""
    if "letters" not in TABLES:
        TABLES["letters"] = np.array([chr(c).isalpha() for c in range(0x110000)])
    return TABLES["letters"]


class Grams:
    """Hashed n-grams of the texts of a chunk, an array per order: text i has ``at[n][i]:at[n][i + 1]``."""

    def __init__(self, column: pa.Array):
        lowered = [(text or "").lower() for text in column.to_pylist()]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(text) for text in lowered], np.int64)
        ends = np.cumsum(sizes)
        is_letter = letters()[points]
        seen = np.concatenate([[0], np.cumsum(is_letter)])
        self.n = len(sizes)
        self.letters = seen[ends] - seen[ends - sizes]
        text = np.where(is_letter, points, 0x20).astype(U)
        self.hashed, self.at = [], []
        for order in range(1, ORDERS + 1):
            counts = np.maximum(sizes - order + 1, 0)
            at = np.concatenate([[0], np.cumsum(counts)])
            start = np.repeat((ends - sizes) - at[:-1], counts) + np.arange(at[-1])
            key = np.full(len(start), order, U)
            for k in range(order):
                key = (key + text[start + k]) * FACTORS[k]
                key ^= key >> U(29)
            self.hashed.append(((key * FACTORS[0]) >> U(64 - BITS)).astype(np.int32))
            self.at.append(at)

    def of(self, i: int) -> np.ndarray:
        return np.concatenate([h[a[i] : a[i + 1]] for h, a in zip(self.hashed, self.at)])

    def totals(self) -> np.ndarray:
        return sum(np.diff(at) for at in self.at)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of all n-grams of each text."""
        out = np.zeros(self.n)
        for h, at in zip(self.hashed, self.at):
            total = np.concatenate([[0.0], np.cumsum(weights[h], dtype=np.float64)])
            out += total[at[1:]] - total[at[:-1]]
        return out


def document_frequencies(training: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, place, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for chunk in chunks(batch, "text"):
                grams = Grams(chunk.column(0))
                n += grams.n
                for i in range(grams.n):
                    own = grams.of(i)
                    order = np.arange(len(own))
                    place[own] = order  # of equal n-grams the last one's place stays
                    df[own[place[own] == order]] += 1
        used = np.flatnonzero(df)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(used, -1)), pa.array(np.append(df[used], n))], ["bucket", "n"]
            )

    counts = training.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = counts.toArrow()  # BUCKETS + 1 rows at most
    bucket, n = np.asarray(rows["bucket"]), np.asarray(rows["n"])
    df = np.zeros(BUCKETS, np.int64)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    return df, int(n[bucket < 0].sum())


def sampled(training: DataFrame, total: int) -> DataFrame:
    """About ``total`` documents, as even over the languages as their numbers allow."""
    sizes = training.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    share = max(LEAST, total // max(1, len(sizes)))
    rates = {r["lang"]: min(1.0, share / r["count"]) for r in sizes}
    dealt = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("lang")] if rates else F.lit(0.0)
    return training.where(dealt < rate)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 1) -> np.ndarray:
    """Weights (class, bucket + 1) by FTRL-proximal; the last column is the intercept.

    A sample is its features, their values and its class.
    """
    z, n = np.zeros((classes, BUCKETS + 1)), np.zeros((classes, BUCKETS + 1))

    def weights(j: np.ndarray | slice) -> np.ndarray:
        zj, nj = z[:, j], n[:, j]
        return -np.sign(zj) * np.maximum(np.abs(zj) - L1, 0) / ((BETA + np.sqrt(nj)) / ALPHA + L2)

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for s in rng.permutation(len(samples)):
            j, x, y = samples[s]
            w = weights(j)
            p = softmax(w @ x)
            p[y] -= 1
            g = np.outer(p, x)
            before = n[:, j]
            after = before + g * g
            z[:, j] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
            n[:, j] = after
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """What logits are divided by so that held-out labels are likeliest, by golden section.

    The labels are smoothed as if each class had been seen once more: if none of n texts is
    wrong, the chance of a wrong one is still about 1 / n.
    """
    classes = logits.shape[1]
    target = np.full(logits.shape, 1 / (len(y) + classes))
    target[np.arange(len(y)), y] += len(y) / (len(y) + classes)

    def loss(t: float) -> float:
        return -(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-12))).sum(axis=1).mean()

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fitted(sample: DataFrame, idf: np.ndarray) -> tuple[list[str], np.ndarray, float] | None:
    """Languages, weights and temperature from the sample, in one task: it is bounded."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                grams = Grams(chunk.column(2))
                js, xs = [], []
                for i in range(grams.n):
                    own = grams.of(i)
                    j, count = np.unique(own, return_counts=True)
                    js.append(j.astype(np.int32))
                    xs.append((SCALE * count / max(1, len(own)) * idf[j]).astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(0), chunk.column(1), pa.array(js, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float32()))],
                    ["place", "lang", "j", "x"],
                )

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "lang"], kind="stable")
        names = sorted(rows["lang"].unique())
        classes = {name: k for k, name in enumerate(names)}
        y = rows["lang"].map(classes).to_numpy()
        held = (rows["place"].to_numpy() % 5 == 0) & (len(rows) >= 50)
        samples = [
            (np.append(np.asarray(j, np.int64), BUCKETS), np.append(np.asarray(x, float), 1.0), int(k))
            for j, x, k in zip(rows["j"], rows["x"], y)
        ]
        w = train([s for s, h in zip(samples, held) if not h], len(names))
        logits = np.array([w[:, j] @ x for (j, x, _), h in zip(samples, held) if h])
        t = temperature(logits, y[held]) if held.any() else 1.0
        out = io.BytesIO()
        np.savez(out, names=np.array(names), weights=w.astype(np.float32), temperature=t)
        return pd.DataFrame({"model": [out.getvalue()]})

    place = F.pmod(F.xxhash64(F.lit(18), "doc_id"), F.lit(1 << 40))
    slim = sample.select(place.alias("place"), "lang", "text")
    got = slim.mapInArrow(features, "place bigint, lang string, j array<int>, x array<float>")
    model = got.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(fit, "model binary").first()
    if model is None:
        return None
    held = np.load(io.BytesIO(bytes(model["model"])))
    return held["names"].tolist(), held["weights"], float(held["temperature"])


def identify(spark: SparkSession, docs: DataFrame, train_on: Column, total: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row; ``train_on`` says which rows may be learned from."""
    may = F.coalesce(train_on, F.lit(False))
    training = docs.where(may & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    df, n = document_frequencies(training)
    idf = np.log((1 + n) / (1 + df)).astype(np.float64)
    model = fitted(sampled(training, total), idf)
    names, w, t = model or ([], np.zeros((0, BUCKETS + 1), np.float32), 1.0)
    scaled = (w[:, :-1] * (SCALE * idf)).astype(np.float32)
    sent = spark.sparkContext.broadcast((names, scaled, w[:, -1], t))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, tables, bias, heat = sent.value
        for batch in batches:
            for chunk in chunks(batch, "text"):
                grams = Grams(chunk.column(2))
                some = np.maximum(1, grams.totals())
                if langs:
                    logits = np.stack([grams.sums(table) / some + b for table, b in zip(tables, bias)], axis=1)
                    p = softmax(logits / heat)
                    best = p.argmax(axis=1)
                    known = grams.letters > 0
                    pred = [langs[k] if ok else UND for k, ok in zip(best, known)]
                    score = np.where(known, p.max(axis=1), 0.0)
                else:
                    pred, score = [UND] * grams.n, np.zeros(grams.n)
                yield pa.RecordBatch.from_arrays(
                    [chunk.column(0), chunk.column(1), pa.array(pred, pa.string()), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    slim = docs.select("doc_id", (~may).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
