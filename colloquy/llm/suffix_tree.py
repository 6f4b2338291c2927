"""Language-model scores from a probabilistic suffix tree.

The tree is over the bytes of a text's tokens: each word followed by a space, then an end. Counts of
all windows of ``DEPTH + 1`` symbols are taken over the whole training text (each task adds up its
own before the shuffle), and give the counts of shorter ones. A context is retained if the next-symbol
distribution after it differs from that after its longest proper suffix by more than chance: its
log-likelihood gain must exceed a chi-squared bound for its number of successors. All of these and
their suffixes make the tree, so it grows with the training text; no context is longer than ``DEPTH``.

Next-symbol distributions are smoothed towards the suffix's (Witten-Bell), the root's towards the
uniform one over 257 symbols, so every text has a probability. The tree stays on Spark: the probability
of each window that occurs in any text is worked out level by level, from the shortest context to the
longest retained one. Windows that make up at least one in ``FREQUENT_WINDOWS`` of the training text,
which are at most ``FREQUENT_WINDOWS``, travel to the tasks with their logarithms; the rest of a
document's windows are joined with theirs, a row per distinct rare window of a document.

``learn`` makes a tree as an automaton on one machine, for a small text or a given number of contexts.
Its state is the longest retained suffix of what was read. As no context is longer than ``DEPTH``, a
chunk of texts is cut into lanes that warm up over ``DEPTH`` symbols and advance together, a symbol a
step.

The unigram base is over words. Counts of words that make up at least one in ``FREQUENT`` tokens, which
are at most ``FREQUENT`` words, travel to the tasks; the rest of a document's words are joined with the
counts, a row per distinct rare word of a document.

Defined results
* null text: as the empty text, one end token.
* no training text: every symbol has probability 1/257, no token is known.
* null doc_id: a key of its own. Repeated rows are scored, and learned from, as often as they occur.
* an empty table: no rows.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .flat import chunks
from .shared import Scratch

DEPTH = 5
FREQUENT = 500_000
FREQUENT_WINDOWS = 8_000_000
HELD_WORDS = 150_000  # distinct words a task adds up before it hands them on
HELD_GRAMS = 1_500_000  # and windows
COUNTED = 1 << 19  # bytes of text whose windows are counted at a time
LANE = 1024
SYMBOLS = 257
U = np.uint64
SPREAD = U(0x9E3779B97F4A7C15)


def tokens(text: pa.Scalar) -> list[bytes]:
    """Words of a text; bytes.lower and bytes.split know ASCII only."""
    return text.as_buffer().to_pybytes().lower().split() if text.is_valid else []


def stream(words: list[bytes]) -> bytes:
    """A text's symbols after the padding that stands for what comes before it."""
    return bytes(DEPTH) + b"".join([w + b" " for w in words]) + b"\0"


def grams(texts: list[bytes]) -> np.ndarray:
    """All windows of DEPTH + 1 symbols that end in a symbol of a text, packed into numbers."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    counts = sizes - DEPTH
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    out = np.zeros(len(at), U)
    for k in range(DEPTH + 1):
        out = (out << U(8)) | data[at + k]
    return out


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(n, first)


def counted(docs: DataFrame) -> DataFrame:
    """``word, gram, n``: counts of words (gram null) and of windows (word null) in rows of ``train``.

    Windows that only other rows have are there with a count of 0.
    """
    names = ["word", "gram", "n"]

    def rows(words: Counter, found: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        if words:
            own = list(words)
            columns = [pa.array(own, pa.binary()), pa.nulls(len(own), pa.int64()), pa.array([words[w] for w in own], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)
        if found is not None:
            keys, n = found
            for i in range(0, len(keys), 500_000):
                part = pa.array(keys[i : i + 500_000].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.binary()), part, pa.array(n[i : i + 500_000])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        parts, size = [], 0
        for batch in batches:
            for chunk in chunks(batch, "text", COUNTED):
                learned, held = [], []
                for text, train in zip(chunk.column(0), chunk.column(1).to_pylist()):
                    own = tokens(text)
                    if train:
                        words.update(own)
                    (learned if train else held).append(stream(own))
                if learned:
                    parts.append(np.unique(grams(learned), return_counts=True))
                    size += len(parts[-1][0])
                if held:
                    other = np.unique(grams(held))
                    parts.append((other, np.zeros(len(other), np.int64)))
                    size += len(other)
                if len(words) > HELD_WORDS:
                    yield from rows(words, None)
                    words = Counter()
                if size > HELD_GRAMS:
                    parts = [merged(parts)]
                    size = len(parts[0][0])
                    if 2 * size > HELD_GRAMS:
                        yield from rows(Counter(), parts[0])
                        parts, size = [], 0
        yield from rows(words, merged(parts) if parts else None)

    each = docs.select("text", "train").mapInArrow(run, "word binary, gram bigint, n bigint")
    return each.groupBy("word", "gram").agg(F.sum("n").alias("n"))


def low(gram: str | Column, symbols: Column) -> Column:
    """The last symbols of a packed window."""
    mask = F.element_at(F.array(*[F.lit((1 << 8 * k) - 1) for k in range(DEPTH + 2)]), symbols + 1)
    return F.col(gram).bitwiseAND(mask) if isinstance(gram, str) else gram.bitwiseAND(mask)


def levels(windows: DataFrame, scratch: Scratch) -> DataFrame:
    """``level, gram, n, context``: windows of one symbol after a context of ``level`` symbols."""
    level = F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))
    every = windows.select("gram", "n", level.alias("level"))
    every = every.select("level", low("gram", F.col("level") + 1).alias("gram"), "n")
    every = every.groupBy("level", "gram").agg(F.sum("n").alias("n"))
    return scratch.keep(every.withColumn("context", F.shiftright("gram", 8)), "windows")


def divergent(every: DataFrame) -> DataFrame:
    """``level, context, gain`` of the contexts that pass the test."""
    every = every.where("n > 0")
    totals = every.groupBy("level", "context").agg(F.sum("n").alias("total"))
    shares = every.join(totals, ["level", "context"]).select("level", "context", "gram", "n", (F.col("n") / F.col("total")).alias("p"))
    above = shares.select((F.col("level") + 1).alias("level"), F.col("gram").alias("suffix"), F.col("p").alias("q"))
    both = shares.where("level > 0").withColumn("suffix", low("gram", F.col("level"))).join(above, ["level", "suffix"])
    gain = F.sum(F.col("n") * F.log(F.col("p") / F.col("q")))
    gains = both.groupBy("level", "context").agg(gain.alias("gain"), F.count("*").alias("k"))
    # twice the gain is about chi-squared with k - 1 degrees of freedom: mean plus four deviations
    bound = F.col("k") + 4 * F.sqrt(2.0 * F.col("k"))
    return gains.where(2 * F.col("gain") > bound).select("level", "context", "gain")


def probabilities(every: DataFrame, scratch: Scratch) -> DataFrame:
    """``gram, n, p`` of the longest windows: p of the last symbol after the longest retained suffix."""
    passed = divergent(every)
    suffixes = passed.select("context", F.explode(F.sequence(F.lit(1), "level")).alias("level"))
    tree = suffixes.select("level", low("context", F.col("level")).alias("context")).distinct()
    seen = every.where("n > 0").groupBy("level", "context").agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    inner = seen.where("level > 0").join(tree, ["level", "context"], "left_semi")
    nodes = scratch.keep(inner.unionByName(seen.where("level = 0")), "nodes")
    p = None
    for d in range(DEPTH + 1):
        own = every.where(F.col("level") == d).select("context", "gram", "n")
        own = own.join(nodes.where(F.col("level") == d).select("context", "total", "k"), "context", "left")
        if d:
            own = own.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * d) - 1)))
            own = own.join(p.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), "suffix")
        else:  # the root is a node even if nothing was learned
            own = own.withColumns(
                {"total": F.coalesce("total", F.lit(0)), "k": F.coalesce("k", F.lit(1)), "q": F.lit(1 / SYMBOLS)}
            )
        mixed = (F.col("n") + F.col("k") * F.col("q")) / (F.col("total") + F.col("k"))
        p = own.select("gram", "n", F.when(F.col("k").isNull(), F.col("q")).otherwise(mixed).alias("p"))
    return p


class Logs:
    """Logarithms of packed windows, in buckets by the top bits of a product."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray):
        bits = max(1, len(keys).bit_length())
        self.shift = U(64 - bits)
        bucket = (keys * SPREAD) >> self.shift
        order = np.argsort(bucket, kind="stable")
        self.keys, self.logs = keys[order], logs[order]
        self.starts = np.searchsorted(bucket[order], np.arange((1 << bits) + 1, dtype=U)).astype(np.int32)

    def places(self, found: np.ndarray) -> np.ndarray:
        """Where each window is; -1 for those that are not here."""
        bucket = ((found * SPREAD) >> self.shift).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        out = np.full(len(found), -1, np.int32)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.keys[here] == found[left]
            out[left[hit]] = here[hit]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out

    def sums(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sum of each stream's logarithms; the windows that are not here, how often a text has them
        and where each text's begin."""
        found = grams(texts)
        ends = np.cumsum([len(t) - DEPTH for t in texts])
        at = self.places(found)
        logs = np.append(self.logs, 0.0)[at]
        total = np.concatenate([[0.0], np.cumsum(logs, dtype=np.float64)])
        missing = np.flatnonzero(at < 0)
        text, rare = np.searchsorted(ends, missing, "right"), found[missing]
        order = np.lexsort((rare, text))
        text, rare = text[order], rare[order]
        new = np.ones(len(rare), bool)
        new[1:] = (rare[1:] != rare[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(rare)))
        begins = np.searchsorted(text[first], np.arange(len(texts) + 1))
        return total[ends] - total[np.concatenate([[0], ends[:-1]])], rare[first], times, begins


def retained(windows: DataFrame, scratch: Scratch, contexts: int | None = None) -> tuple[pa.Table, list[tuple[int, int]]]:
    """Counts of the tree's nodes as ``level, context, symbol, n``, and its contexts (level, packed).

    ``contexts``: only so many, those with the largest gains.
    """
    every = levels(windows, scratch)
    chosen = divergent(every).orderBy(F.desc("gain"), "level", "context")
    if contexts is not None:
        chosen = chosen.limit(contexts)
    nodes = {(0, 0)}
    for d, context in chosen.select("level", "context").collect():
        while d and (d, context) not in nodes:
            nodes.add((d, context))
            d, context = d - 1, context & ((1 << 8 * (d - 1)) - 1)
    tree = sorted(nodes)
    wanted = scratch.spark.createDataFrame(tree, "level int, context bigint")
    return every.join(wanted, ["level", "context"], "left_semi").select("level", "context", "gram", "n").toArrow(), tree


class Model:
    """The tree as an automaton: per state and symbol the next state and the log10 probability."""

    def __init__(self, counts: pa.Table, tree: list[tuple[int, int]]):
        levels, contexts, windows, n = (np.asarray(c.combine_chunks()) for c in counts.columns)
        symbols = windows & 0xFF
        seen = np.unique(symbols)
        width = len(seen) + 1  # the last column: any symbol that was never seen
        self.codes = np.full(256, width - 1, np.int32)
        self.codes[seen] = np.arange(len(seen))
        nodes = {node: i for i, node in enumerate(tree)}  # by level, so a suffix comes before its context
        table = np.zeros((len(tree), width))
        row = np.array([nodes[key] for key in zip(levels.tolist(), contexts.tolist())], np.int64)
        np.add.at(table, (row, self.codes[symbols]), n)
        p = np.zeros_like(table)
        for i, (d, context) in enumerate(tree):
            own = table[i]
            kinds = np.count_nonzero(own)
            if d:
                parent = p[nodes[d - 1, context & ((1 << 8 * (d - 1)) - 1)]]
            else:
                parent, kinds = np.full(width, 1 / SYMBOLS), max(kinds, 1)
            p[i] = (own + kinds * parent) / (own.sum() + kinds)
        # states: the tree and all prefixes of its contexts, so that no longer suffix is missed
        states = set(tree)
        for d, context in tree:
            while d:
                d, context = d - 1, context >> 8
                k, c = d, context
                while (k, c) not in states:
                    states.add((k, c))
                    k, c = k - 1, c & ((1 << 8 * (k - 1)) - 1)
        order = sorted(states)
        index = {state: i for i, state in enumerate(order)}

        def longest(d: int, context: int, among: dict) -> int:
            while (d, context) not in among:
                d, context = d - 1, context & ((1 << 8 * (d - 1)) - 1)
            return among[d, context]

        self.next = np.zeros((len(order), width), np.int32)
        own = np.zeros(len(order), np.int64)
        for i, (d, context) in enumerate(order):
            own[i] = longest(d, context, nodes)
            for code, symbol in enumerate(seen.tolist()):
                k, c = d + 1, context << 8 | symbol
                if k > DEPTH:
                    k, c = DEPTH, c & ((1 << 8 * DEPTH) - 1)
                self.next[i, code] = longest(k, c, index)
        self.logs = np.log10(p[own]).astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each stream."""
        data = self.codes[np.frombuffer(b"".join(texts), np.uint8)]
        width, n = self.next.shape[1], len(data)
        lanes = -(-n // LANE)
        padded = np.zeros(DEPTH + lanes * LANE, np.int32)
        padded[DEPTH : DEPTH + n] = data
        view = np.lib.stride_tricks.as_strided(padded, (LANE + DEPTH, lanes), (padded.itemsize, LANE * padded.itemsize))
        columns = np.ascontiguousarray(view)
        then, logs = self.next.ravel(), self.logs.ravel()
        state = np.zeros(lanes, np.int32)
        out = np.empty((LANE, lanes), np.float32)
        for t in range(LANE + DEPTH):
            at = state * width + columns[t]
            if t >= DEPTH:
                np.take(logs, at, out=out[t - DEPTH])
            state = then[at]
        each = np.ascontiguousarray(out.T).ravel()[:n].astype(np.float64)
        ends = np.cumsum([len(t) for t in texts])
        starts = np.concatenate([[0], ends[:-1]])
        total = np.concatenate([[0.0], np.cumsum(each)])
        return total[ends] - total[starts + DEPTH]  # the padding is given


LOADED: dict[int, tuple] = {}


def learn(training: DataFrame, scratch: Scratch, contexts: int | None = None) -> tuple[DataFrame, Model]:
    """Counts of words, and the model on one machine, from the texts of ``training``."""
    counts = scratch.keep(counted(training.select("text", F.lit(True).alias("train"))), "counts")
    words = counts.where("word is not null").select("word", "n")
    found, tree = retained(counts.where("gram is not null").select("gram", "n"), scratch, contexts)
    return words, Model(found, tree)


def score(spark: SparkSession, docs: DataFrame, train: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row.

    ``train`` says which rows are learned from.
    """
    scratch = Scratch(spark, "suffix-tree")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    counts = scratch.keep(counted(slim), "counts")
    words = counts.where("word is not null").select("word", "n")
    every = levels(counts.where("gram is not null").select("gram", "n"), scratch)
    logs = scratch.keep(probabilities(every, scratch).select("gram", "n", F.log10("p").alias("log")), "logs")
    scratch.drop("windows", "nodes")
    n_docs = slim.where("train").count()
    sums = words.agg(F.sum("n"), F.count("*")).first()
    total, distinct = (sums[0] or 0) + n_docs, sums[1] + (n_docs > 0)
    often = words.where(F.col("n") * FREQUENT >= total).toArrow()  # at most FREQUENT rows
    known = dict(zip(often["word"].to_pylist(), often["n"].to_pylist()))
    n_windows = logs.agg(F.sum("n")).first()[0] or 0
    common = logs.where((F.col("n") > 0) & (F.col("n") * FREQUENT_WINDOWS >= n_windows)).select("gram", "log").toArrow()
    table = tuple(np.asarray(c.combine_chunks()) for c in common.columns)
    floor = np.log10(total + distinct + 1)
    end = np.log10(n_docs + 1) - floor
    sent = spark.sparkContext.broadcast((table[0].astype(U), table[1].astype(np.float32), known))
    key = sent._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in LOADED:
            LOADED.clear()
            keys, values, counts = sent.value
            LOADED[key] = Logs(keys, values), {w: (n, np.log10(n + 1) - floor) for w, n in counts.items()}
        held, frequent = LOADED[key]
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for chunk in chunks(batch, "text", COUNTED):
                texts, n, n_known, base, rare, times, ends = [], [], [], [], [], [], [0]
                for text in chunk.column(1):
                    own = tokens(text)
                    texts.append(stream(own))
                    hits, log = int(n_docs > 0), end
                    for word, tf in Counter(own).items():
                        got = frequent.get(word)
                        if got:
                            hits += tf
                            log += tf * got[1]
                        else:
                            rare.append(word)
                            times.append(tf)
                    n.append(len(own) + 1)
                    n_known.append(hits)
                    base.append(log)
                    ends.append(len(rare))
                sums, windows, often, begins = held.sums(texts)
                begins = pa.array(begins, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + chunk.num_rows)),
                        chunk.column(0),
                        chunk.column(2),
                        pa.array(n, pa.int64()),
                        pa.array(n_known, pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(sums),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rare, pa.binary())),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(times, pa.int32())),
                        pa.ListArray.from_arrays(begins, pa.array(windows.view(np.int64))),
                        pa.ListArray.from_arrays(begins, pa.array(often, pa.int32())),
                    ],
                    ["row", "doc_id", "train", "n_tokens", "n_known", "base", "score", "rare", "times", "windows", "often"],
                )
                row += chunk.num_rows

    kinds = (
        "row bigint, doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base double, score double, "
        "rare array<binary>, times array<int>, windows array<bigint>, often array<int>"
    )
    scored = scratch.keep(slim.select("doc_id", "text", "train").mapInArrow(run, kinds), "scored")
    left = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x"))
    left = left.select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("tf"))
    joined = left.join(words, "word", "left")
    log = F.col("tf") * (F.log10(F.coalesce("n", F.lit(0)) + 1) - F.lit(float(floor)))
    seen = F.when(F.col("n") > 0, F.col("tf")).otherwise(0)
    by_word = joined.select("row", log.alias("more"), seen.alias("more_known"), F.lit(0.0).alias("more_score"))
    left = scored.select("row", F.explode(F.arrays_zip("windows", "often")).alias("x"))
    left = left.select("row", F.col("x.windows").alias("gram"), F.col("x.often").alias("tf"))
    joined = left.join(logs.select("gram", "log"), "gram")
    by_window = joined.select("row", F.lit(0.0).alias("more"), F.lit(0).alias("more_known"), (F.col("tf") * F.col("log")).alias("more_score"))
    names = ["more", "more_known", "more_score"]
    rest = by_word.unionByName(by_window).groupBy("row").agg(*[F.sum(c).alias(c) for c in names])
    return scored.drop("rare", "times", "windows", "often").join(rest, "row", "left").select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
