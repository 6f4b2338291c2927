"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items make one automaton that knows every run of words of every item. A
document's words are streamed through it; the automaton's state is the longest run that ends at
the current word and occurs in an item, and its length is tracked. Where the length reaches
``WINDOW`` the last ``WINDOW`` words are a window of an item and are hit; an item with fewer words
is a window by itself and is hit where all of it has just been read. Each state knows the items
whose window it ends.

The items travel to the tasks, the documents are never moved. Items are dealt into parts of
``PART_BYTES`` at most (an item that is longer is a part of its own), and the documents pass
through one part after the other. What is cut, and whether a document stays, is decided on the hits
of all parts together, so the number of parts changes no result.

Defined results
* null or empty text: no words, no hits.
* items without id or without words: not items. Rows with one item id: one item.
* items with equal texts: each of them is found.
* empty tables: no rows; without items nothing is hit.
"""

import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, free_name

WINDOW = 10
PART_BYTES = 4 << 20

# ASCII letters lowered, everything of ASCII but letters and digits a space, the rest as it is.
TO_WORDS = bytes(
    b + 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

class Automaton:
    """Generalised suffix automaton over the words of items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.words = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str]] = []  # states of an item's prefixes
        short: list[tuple[int, int, str]] = []
        for item, text in items:
            ids = [self.words.setdefault(w, len(self.words)) for w in text.translate(TO_WORDS).split()]
            state = 0
            for word in ids:
                state = self._extend(state, word)
                ends.append((state, item))
            if 0 < len(ids) < window:
                short.append((state, len(ids), item))
        n = len(self.next)
        order = sorted(range(1, n), key=self.length.__getitem__)
        # Items by state, handed up from longer to shorter suffixes; only those of window length count.
        inside: list[set[str]] = [set() for _ in range(n)]
        for state, item in ends:
            if self.length[state] >= window:
                inside[state].add(item)
        for state in reversed(order):
            up = self.link[state]
            if self.length[up] >= window:
                inside[up] |= inside[state]
        self.whole: list[frozenset[str] | None] = [None] * n
        self.short: list[tuple[tuple[int, str], ...]] = [()] * n
        own: dict[int, list[tuple[int, str]]] = {}
        # the state of an item's last prefix may hold longer strings too, so its length is kept
        for state, length, item in short:
            own.setdefault(state, []).append((length, item))
        for state in order:
            up = self.link[state]
            if self.length[state] >= window:
                self.whole[state] = frozenset(inside[state]) if self.length[up] < window else self.whole[up]
            self.short[state] = self.short[up] + tuple(own.get(state, ()))
        self.any_short = bool(short)

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(last, known, word)
        state = self._add(self.length[last] + 1, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last < 0:
            self.link[state] = 0
        else:
            other = self.next[last][word]
            same = self.length[other] == self.length[last] + 1
            self.link[state] = other if same else self._clone(last, other, word)
        return state

    def _add(self, length: int, then: dict[int, int]) -> int:
        self.next.append(then)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _clone(self, last: int, other: int, word: int) -> int:
        copy = self._add(self.length[last] + 1, dict(self.next[other]))
        self.link[copy], self.link[other] = self.link[other], copy
        while last >= 0 and self.next[last].get(word) == other:
            self.next[last][word] = copy
            last = self.link[last]
        return copy

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of words, apart from each other and in order, and the items of their windows."""
        get, then, link, length, window = self.words.get, self.next, self.link, self.length, self.window
        whole, short, any_short = self.whole, self.short, self.any_short
        spans: list[list[int]] = []
        items: set[str] = set()
        state = run = 0
        for i, word in enumerate([get(w, -1) for w in words]):
            if word < 0:
                state = run = 0
                continue
            to = then[state].get(word)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = then[state].get(word)
            state, run = to, run + 1  # the root knows every word of the items
            if run >= window:
                items |= whole[state]
                begin = i + 1 - window
            elif any_short and short[state] and run >= short[state][0][0]:
                begin = i + 1
            else:
                continue
            if any_short:
                for k, item in short[state]:
                    if k <= run:
                        items.add(item)
                        begin = min(begin, i + 1 - k)
            # a longer hit may reach back over spans that were closed before
            while spans and spans[-1][1] >= begin:
                begin = min(begin, spans.pop()[0])
            spans.append([begin, i + 1])
        return [(a, b) for a, b in spans], items


BUILT: dict[int, Automaton] = {}


def built(part) -> Automaton:
    """The automaton of a broadcast part, made once per Python worker."""
    if part.id not in BUILT:
        BUILT.clear()
        BUILT[part.id] = Automaton(part.items.value, part.window)
    return BUILT[part.id]


class Part:
    """Items that are broadcast together."""

    def __init__(self, spark: SparkSession, items: list[tuple[str, bytes]], window: int):
        self.items, self.window = spark.sparkContext.broadcast(items), window
        self.id = self.items._jbroadcast.id() if hasattr(self.items, "_jbroadcast") else id(self.items)


def parts(spark: SparkSession, bench: DataFrame, window: int, most: int = PART_BYTES) -> Iterator[Part]:
    """The items in parts of ``most`` bytes, a part at a time on the driver."""
    scratch = Scratch(spark, "items")
    items = scratch.keep(
        bench.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
            F.col("item_id").cast("string").alias("item"), F.encode("text", "utf-8").alias("text")
        ),
        "items",
    ).withColumn("size", F.octet_length("text") + 64)
    total = items.agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-2 * total // most))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    while True:
        fullest = dealt.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where(
            (F.col("size") > most) & (F.col("n") > 1)
        )
        if fullest.isEmpty() or n > 1 << 24:
            break
        n *= 2
        dealt = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    for (part,) in dealt.select("part").distinct().orderBy("part").toLocalIterator():
        rows = dealt.where(F.col("part") == part).select("item", "text").collect()
        yield Part(spark, sorted((r.item, bytes(r.text)) for r in rows), window)


def _matched(docs: DataFrame, part: Part, out: str) -> DataFrame:
    """``docs`` with a struct for this part of the items: number of words, hit spans, items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = built(part)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            n, hit, items = [], [], []
            for text in texts:
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").translate(TO_WORDS).split()
                spans, found = known.spans(words)
                n.append(len(words))
                hit.append(spans)
                items.append(sorted(found))
            span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            struct = pa.StructArray.from_arrays(
                [
                    pa.array(n, pa.int64()),
                    pa.array([[{"a": a, "b": b} for a, b in s] for s in hit], span),
                    pa.array(items, pa.list_(pa.string())),
                ],
                ["n_words", "spans", "items"],
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, out])

    span = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
    found = T.StructType(
        [T.StructField("n_words", T.LongType()), T.StructField("spans", span), T.StructField("items", T.ArrayType(T.StringType()))]
    )
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, found)]))


def hit_words(spans: list) -> int:
    """Words in any of the spans, which may overlap if they come from several parts."""
    total = end = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _hits(spark: SparkSession, docs: DataFrame, dealt: Iterable[Part], window: int, out: str) -> DataFrame:
    """``docs`` with a struct ``out``: number of words, hit spans of all parts, items."""
    scratch, got = Scratch(spark, "contamination"), []
    for i, part in enumerate(dealt):
        name = f"{out}{i}"
        docs = _matched(scratch.keep(docs, f"part-{i}") if i else docs, part, name)
        got.append(name)
        if i > 1:
            scratch.drop(f"part-{i - 1}")
    if not got:
        docs = _matched(docs, Part(spark, [], window), f"{out}0")
        got = [f"{out}0"]
    found = F.struct(
        F.col(got[0])["n_words"].alias("n_words"),
        F.flatten(F.array(*[F.col(g)["spans"] for g in got])).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(g)["items"] for g in got])))).alias("items"),
    )
    return docs.withColumn(out, found).drop(*got)


def contamination(spark: SparkSession, docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``found``: number of words, hit spans of words ``[a, b)``, items."""
    out = free_name(docs, "_found")
    found = _hits(spark, docs, parts(spark, bench, window), window, out)
    return found.withColumn("found", F.col(out)).drop(out)


def covered(spans: Column) -> Column:
    """Number of words in the spans of a column; spans of several parts may overlap."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        ordered,
        start,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], x["b"]).alias("end"),
        ),
        lambda acc: acc["n"],
    )


def without(text: bytes, at: list[tuple[int, int]], spans: list[tuple[int, int]]) -> bytes:
    """The text without spans of its words, which begin and end ``at``; each leaves a line break.

    Spans may overlap or touch if they come from several parts, and count as one then.
    """
    kept, end, last = [], 0, -1
    for a, b in sorted(spans):
        if a > last:
            kept.append(text[end : at[a][0]])
        last = max(last, b)
        end = at[last - 1][1]
    return b"\n".join([*kept, text[end:]])


def places(plain: bytes) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(rb"[^ ]+", plain)]


def clean(known: Automaton, text: bytes, coverage: float) -> bytes | None:
    """The text without its hit spans; None if they are more than ``coverage`` of its words.

    Words that meet at a cut may make a window again, so it is repeated.
    """
    first = True
    while True:
        plain = text.translate(TO_WORDS)
        spans, _ = known.spans(plain.split())
        if not spans:
            return text
        at = places(plain)
        if first and hit_words(spans) > coverage * len(at):
            return None
        first, text = False, without(text, at, spans)


def _rewritten(batch: pa.RecordBatch, schema: pa.Schema, new: list[bytes | None]) -> pa.RecordBatch:
    """The columns of ``schema`` with other texts."""
    texts = pa.array([None if x is None else x.decode("utf-8") for x in new], schema.field("text").type)
    return pa.RecordBatch.from_arrays([texts if n == "text" else batch.column(n) for n in schema.names], schema.names)


def _cleaned(docs: DataFrame, part: Part, coverage: float) -> DataFrame:
    """All rounds of a document in one task: the items are one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = built(part)
        for batch in batches:
            texts = batch.column("text")
            new = [clean(known, x.as_buffer().to_pybytes(), coverage) if x.is_valid else None for x in texts]
            keep = pa.array([x is not None or not y.is_valid for x, y in zip(new, texts)], pa.bool_())
            yield _rewritten(batch, batch.schema, new).filter(keep)

    return docs.mapInArrow(run, docs.schema)


def _cleaned_by_rounds(
    spark: SparkSession, docs: DataFrame, dealt: Iterable[Part], bench: DataFrame, window: int, coverage: float
) -> DataFrame:
    """What one part with all items would give: a round takes the hits of all parts, then cuts."""
    scratch, hit, done, turn = Scratch(spark, "decontaminate"), free_name(docs, "_hit"), [], 0
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, new = batch.drop_columns([hit]), []
            for text, found in zip(batch.column("text"), batch.column(hit)):
                raw = text.as_buffer().to_pybytes()
                spans = [(x["a"], x["b"]) for x in found["spans"].as_py()]
                new.append(without(raw, places(raw.translate(TO_WORDS)), spans))
            yield _rewritten(own, own.schema, new)

    while True:
        found = scratch.keep(_hits(spark, docs, dealt, window, hit), f"found-{turn}")
        spans = F.col(hit)["spans"]
        done.append(found.where(F.size(spans) == 0).drop(hit))
        some = found.where(F.size(spans) > 0)
        if not turn:
            some = some.where(covered(spans) <= F.lit(float(coverage)) * F.col(hit)["n_words"])
        if some.isEmpty():
            break
        docs, dealt, turn = some.mapInArrow(run, schema), parts(spark, bench, window), turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def decontaminate(
    spark: SparkSession, docs: DataFrame, bench: DataFrame, window: int = WINDOW, coverage: float = 0.5
) -> DataFrame:
    """``docs`` without the spans that occur in an item; documents that are mostly such spans go.

    A null text stays null. ``n_chars``, if there, is the length of the text that is left.
    """
    schema, dealt = docs.schema, parts(spark, bench, window)
    begin = list(islice(dealt, 2))
    if len(begin) < 2:
        docs = _cleaned(docs, begin[0], coverage) if begin else docs
    else:
        docs = _cleaned_by_rounds(spark, docs, chain(begin, dealt), bench, window, coverage)
    if "n_chars" in docs.columns:
        kind = schema["n_chars"].dataType
        length = F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars"))
        docs = docs.withColumn("n_chars", length.cast(kind))
    return docs
