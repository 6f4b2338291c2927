"""Quality rules whose cutoffs are chosen under a bound on false rejection.

Every rule says "reject a text whose measure is above a cutoff". The cutoffs that may be
chosen form a fixed grid, from the loosest to the strictest. For each stratum (the language)
and each rule, the labelled documents of the stratum are the holdout: a cutoff is safe if an
exact binomial test rejects, at level ``delta / (strata * rules)``, that the rule turns away
more than ``alpha / rules`` of the good documents. The grid is tested in its order and testing
stops at the first cutoff that is not safe, so a whole grid costs one test (fixed-sequence
testing) and Bonferroni's correction covers strata and rules: with probability ``1 - delta``
no stratum loses more than ``alpha`` of its good documents, all rules taken together. Among the
safe cutoffs the one is taken that catches most bad documents per good one turned away.

Defined results
* null text: an empty text, so no words: the base rules reject it.
* null stratum: a stratum of its own, the empty text.
* a stratum without (enough) labels: no cutoff is safe, nothing but the base rules rejects.
* documents with one id: the label counts for each of them; labels with one id: the lowest
  quality counts; null ids, and labels without quality, are no labels.
* empty tables: no rows, no cutoffs.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flat import SPACE, Texts, Words, chunks
from .shared import Scratch, free_name

WINDOW = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
MARKS = np.zeros(256, bool)
MARKS[list(b"!?")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")
FEATURES = T.StructType([T.StructField(name, T.LongType(), False) for name in COUNTS])


def repeated_words(hashes: np.ndarray, k: int = WINDOW) -> int:
    """Words that lie in a window of ``k`` words which the text holds twice or more."""
    n = len(hashes) - k + 1
    if n < 2:
        return 0
    order = np.argsort(hashes[:n], kind="stable")
    same = np.flatnonzero(np.diff(hashes[order].view(np.int64)) == 0)
    if not len(same):
        return 0
    step = np.zeros(n + k, np.int64)
    starts = np.unique(np.concatenate([order[same], order[same + 1]]))
    np.add.at(step, starts, 1)
    np.add.at(step, starts + k, -1)
    return int((np.cumsum(step) > 0).sum())


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for each text of a chunk."""
    texts = Texts(column)
    words = Words(texts)
    hashes = words.hashes(texts.data)
    windows = np.zeros(len(hashes), np.uint64)
    found, start = words.windows(hashes, WINDOW, 3)
    windows[start] = found
    n = texts.n
    dup, lines, repeats = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(n):
        if words.counts[i]:
            own = [line for line in texts.bytes(i).split(b"\n") if line.strip()]
            lines[i], dup[i] = len(own), len(own) - len(set(own))
            if words.counts[i] > WINDOW:
                at, to = words.at[i], words.at[i + 1]
                # a place that starts no window ends the text's slice: there are k - 1 of them
                repeats[i] = repeated_words(windows[at:to])
    inside = ~SPACE[texts.data]
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": texts.sums(inside & ((texts.data & 0xC0) != 0x80)),
        "n_symbols": texts.sums(SYMBOLS[texts.data]),
        "n_dup_lines": dup,
        "n_repeat_words": repeats,
        "n_lines": lines,
        "n_upper": texts.sums(UPPER[texts.data]),
        "n_marks": texts.sums(MARKS[texts.data]),
    }


def with_counts(docs: DataFrame, out: str) -> DataFrame:
    """``docs`` with a struct of ``COUNTS`` for the whole text, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for chunk in chunks(batch, "text"):
                got = measure(chunk.column(at))
                struct = pa.StructArray.from_arrays([pa.array(got[c]) for c in COUNTS], list(COUNTS))
                yield pa.RecordBatch.from_arrays([*chunk.columns, struct], [*chunk.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, FEATURES)]))


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def falling(*parts: tuple[float, float, int]) -> list[float]:
    """Cutoffs in equal ratios: from, to, how many."""
    return [round(float(x), 6) for a, b, n in parts for x in np.geomspace(a, b, n)]


# name -> (measure of a text, cutoffs from loose to strict)
RULES = {
    "symbols_per_word": (lambda c: share(c["n_symbols"], c["n_words"]), falling((8, 0.05, 48))),
    "upper_share": (lambda c: share(c["n_upper"], c["word_chars"]), falling((0.95, 0.1, 48))),
    "marks_per_word": (lambda c: share(c["n_marks"], c["n_words"]), falling((4, 0.05, 48))),
    "repeat_share": (lambda c: share(c["n_repeat_words"], c["n_words"]), falling((0.95, 0.05, 48))),
    "dup_line_share": (lambda c: share(c["n_dup_lines"], c["n_lines"]), falling((0.95, 0.05, 48))),
    "word_length": (lambda c: share(c["word_chars"], c["n_words"]), falling((200, 8, 48))),
}


def place(value: Column, grid: list[float]) -> Column:
    """How many cutoffs of the grid the value does not exceed: the index of the first that it does."""
    return F.size(F.filter(F.array(*map(F.lit, grid)), lambda cutoff: cutoff >= value))


def base_failed(counts: Column) -> Column:
    """Too short, or mostly repeated: no label is needed to say so."""
    n = counts["n_words"]
    return (n < 20) | (100 * counts["n_repeat_words"] > 30 * n)


def binomial_tail(n: int, p: float, upto: int) -> np.ndarray:
    """P(Binomial(n, p) <= k) for k = 0..upto, exactly, from sums of logarithms."""
    k = np.arange(upto + 1)
    steps = np.log((n - k[1:] + 1) / k[1:]) + np.log(p) - np.log1p(-p)
    logs = n * np.log1p(-p) + np.concatenate([[0.0], np.cumsum(steps)])
    return np.minimum(1.0, np.exp(np.logaddexp.accumulate(logs)))


def safe_cutoff(good: np.ndarray, bad: np.ndarray, alpha: float, level: float, price: float) -> int:
    """Index of the cutoff to use, or -1.

    ``good[j]`` documents of quality 1 exceed cutoff j but none before it, the last entry counts
    those that exceed none; ``bad`` likewise.
    """
    n, rejected = int(good.sum()), np.cumsum(good[:-1])
    if not n:
        return -1
    tail = binomial_tail(n, alpha, int(rejected[-1]))
    safe = tail[rejected.astype(int)] <= level
    stop = len(safe) if safe.all() else int(np.argmin(safe))
    if not stop:
        return -1
    gain = np.cumsum(bad[:-1])[:stop] / max(1, bad.sum()) - price * rejected[:stop] / n
    best = int(np.argmax(gain))
    return best if gain[best] > 0 else -1


def choose_cutoffs(
    counted: DataFrame,
    labels: DataFrame,
    counts: str,
    stratum: str,
    alpha: float = 0.05,
    delta: float = 0.05,
    price: float = 5.0,
) -> DataFrame:
    """``(stratum, rule, cutoff)`` for every rule that has a safe cutoff in a stratum.

    The labelled documents are counted by (stratum, rule, place in the grid, quality) before
    anything is gathered, so a group of the test has at most ``2 * (grid + 1)`` rows whatever the
    number of labels; the number of strata is that of languages.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_quality"))
    )
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("rule"), place(fn(F.col(counts)), grid).alias("place"))
            for name, (fn, grid) in RULES.items()
        ]
    )
    held = (
        counted.where(~base_failed(F.col(counts)))
        .select("doc_id", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), counts)
        .join(known, "doc_id")
        .select("stratum", "_quality", F.inline(rows))
        .groupBy("stratum", "rule", "place")
        .agg(
            F.count_if(F.col("_quality") == 1).alias("good"),
            F.count_if(F.col("_quality") != 1).alias("bad"),
        )
    )
    tests = held.agg(F.count_distinct("stratum").alias("n")).first()["n"] * len(RULES)
    grids = {name: grid for name, (_, grid) in RULES.items()}

    def test(group: pd.DataFrame) -> pd.DataFrame:
        rule = group["rule"].iloc[0]
        grid = grids[rule]
        good, bad = np.zeros(len(grid) + 1), np.zeros(len(grid) + 1)
        np.add.at(good, group["place"].to_numpy(), group["good"].to_numpy())
        np.add.at(bad, group["place"].to_numpy(), group["bad"].to_numpy())
        j = safe_cutoff(good, bad, alpha / len(grids), delta / max(1, tests), price)
        cutoff = grid[j] if j >= 0 else np.inf
        return pd.DataFrame({"stratum": [group["stratum"].iloc[0]], "rule": [rule], "cutoff": [cutoff]})

    chosen = held.groupBy("stratum", "rule").applyInPandas(test, "stratum string, rule string, cutoff double")
    return chosen.where(F.col("cutoff") < float("inf"))


def judge(counted: DataFrame, cutoffs: DataFrame, counts: str, stratum: str, out: str) -> DataFrame:
    """``counted`` with ``out``: null if the text is kept, else the rules that reject it."""
    key = free_name(counted, "_stratum")
    limits = cutoffs.groupBy(F.col("stratum").alias(key)).agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias(out)
    )
    c = F.col(counts)
    broken = F.filter(
        F.array(
            F.when(base_failed(c), F.lit("base")),
            *[F.when(fn(c) > F.try_element_at(F.col(out), F.lit(name)), F.lit(name)) for name, (fn, _) in RULES.items()],
        ),
        lambda x: x.isNotNull(),
    )
    return (
        counted.withColumn(key, F.coalesce(F.col(stratum).cast("string"), F.lit("")))
        .join(limits, key, "left")
        .withColumn(out, F.when(F.size(broken) > 0, broken))
        .drop(key)
    )


def quality_rules(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, stratum: str = "lang", **limits
) -> DataFrame:
    """``docs`` as they are, with ``rejected_by``: the rules that reject a text, null if it stays.

    Two passes over the texts: one counts what the labelled documents show, one judges every text
    where it lies. No text is moved.
    """
    counts, scratch = free_name(docs, "_counts"), Scratch(spark, "quality-rules")
    slim = with_counts(docs.select("doc_id", stratum, "text"), counts).drop("text")
    cutoffs = scratch.keep(choose_cutoffs(slim, labels, counts, stratum, **limits), "cutoffs")
    return judge(with_counts(docs, counts), cutoffs, counts, stratum, "rejected_by").drop(counts)


def quality_table(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, stratum: str = "lang", **limits
) -> DataFrame:
    """Counts and verdict of each document, without its text; the texts are read once."""
    scratch = Scratch(spark, "quality-table")
    slim = with_counts(docs.select("doc_id", stratum, "text"), "counts").drop("text")
    slim = scratch.keep(slim, "counts")
    cutoffs = scratch.keep(choose_cutoffs(slim, labels, "counts", stratum, **limits), "cutoffs")
    failed = base_failed(F.col("counts")).alias("base_failed")
    judged = judge(slim, cutoffs, "counts", stratum, "rejected_by")
    return judged.select("doc_id", stratum, "counts.*", "rejected_by", failed)
