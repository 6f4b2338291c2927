"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's set holds its distinct shingles of five words; two documents are linked if their
sets' Jaccard similarity is ``similar`` hundredths or more, 85 unless given. The steps:

1. Each text gives the size of its set, a digest of the set and a signature of ``COORDINATES``
   minima (one pass, no shuffle). Documents with one set are one class from here on; only its
   smallest id goes on.
2. Every class is posted under each of its (coordinate, value) pairs, and postings are counted.
   A pair that no other class has cannot collide; it only uses up a place of the prefix.
3. Prefix: two linked classes agree in ``matches`` coordinates or more, so they meet in the
   ``COORDINATES - matches + 1`` rarest of either one. Only these are kept as postings: a value
   that a passage common to many documents brings about is skipped unless a document has little
   else.
4. Merging: every posting proposes its most central member, the one that shares most of its
   coordinates with others, as the partner of the rest (in further rounds, if asked for, one by a
   hash, where a posting is not yet one component). Proposals with enough matching coordinates are
   confirmed on the full sets; links become components. So a large group of copies costs a link
   for each, not one for each two.
5. The rest: what is still in a posting with another component is held against all of it, after
   an exact bound. A shingle that only one of these documents has is in no intersection, so the
   shared ones must be enough for the overlap that the sizes ask for. Each pair is made once, at
   the least of its common postings, then matched and confirmed like the others.

The matches are so few that two sets of just that similarity miss them with probability ``MISSED`` or
less (binomial tail): 23 of 48 at 0.85. More similar ones miss them less. Nothing is capped or sampled.

Defined results
* null text, or a text without words: size 0, a component of its own, kept.
* fewer than five words: the sequence as one shingle.
* a null doc_id: counted and kept, linked with nothing, component null.
* rows with one doc_id: one node of the graph; links of each of them are links of the node.
* an empty table: no rows.
"""

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .flat import LOWER, Texts, Words, chunks, mix, randoms
from .shared import Scratch, free_name

SHINGLE = 5
COORDINATES = 48
MISSED = 4e-10
NUM, DEN = 85, 100  # similarity of a link
ROUNDS = 1

FACTORS = randoms(COORDINATES, 11)
SHIFTS = randoms(COORDINATES, 12)


def matches(similar: int) -> int:
    """Coordinates that two sets of this similarity agree in but for a probability of ``MISSED``."""
    p, tail = similar / DEN, 0.0
    for m in range(COORDINATES + 1):
        tail += comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if tail > MISSED:
            return m
    return COORDINATES


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    texts = Texts(column)
    texts.data = LOWER[texts.data]
    words = Words(texts)
    hashes = words.hashes(texts.data)
    grams, start = words.windows(hashes, k, 5)
    at = np.searchsorted(start, words.at)
    sets = []
    for i in range(texts.n):
        if words.counts[i] >= k:
            sets.append(np.unique(grams[at[i] : at[i + 1]]))
        elif words.counts[i]:
            few = hashes[words.at[i] : words.at[i + 1]]
            short = (few * randoms(len(few), 6)).sum() + np.uint64(len(few))
            sets.append(mix(np.array([short], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row per set: for each coordinate the least permuted hash, tagged with the coordinate."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), COORDINATES), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    for c in range(COORDINATES):
        out[full, c] = np.minimum.reduceat(flat * FACTORS[c] + SHIFTS[c], at)
    return mix(out + SHIFTS)


SIGNED = "n_shingles bigint, digest binary, signature array<bigint>"


def signed(docs: DataFrame) -> DataFrame:
    """``doc_id``, size, digest of the set, signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                sets = shingle_sets(chunk.column(1))
                rows = signatures(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        chunk.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([row if len(s) else None for s, row in zip(sets, rows)], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "digest", "signature"],
                )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(run, f"doc_id bigint, {SIGNED}")


def with_sets(docs: DataFrame) -> DataFrame:
    """``rep``, size, signature and the set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                sets = shingle_sets(chunk.column(1))
                rows = signatures(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        chunk.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(list(rows), pa.list_(pa.int64())),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["rep", "n", "signature", "shingles"],
                )

    schema = "rep bigint, n bigint, signature array<bigint>, shingles array<bigint>"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def postings(classes: DataFrame, similar: int = NUM) -> DataFrame:
    """``(key, rep, common)``: the prefix of each class that another class shares, and how many of
    its coordinates are shared."""
    posted = classes.select("rep", F.explode("signature").alias("key"))
    shared = posted.groupBy("key").agg(F.count("*").alias("cnt")).where("cnt > 1")
    own = posted.join(shared, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("cnt", "key"))).alias("keys"))
    # the pairs that nobody shares come first: they are the rarest
    room = F.lit(COORDINATES - matches(similar) + 1) - (F.lit(COORDINATES) - F.size("keys"))
    prefix = F.explode(F.slice("keys", 1, room)).alias("x")
    return own.where(room > 0).select("rep", F.size("keys").alias("common"), prefix).select("x.key", "rep", "common")


def enough(inter: Column, a: Column, b: Column, similar: int = NUM) -> Column:
    """100 * intersection >= similar * union."""
    return DEN * inter >= similar * (a + b - inter)


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int = NUM) -> DataFrame:
    """The pairs (a, b) that match in enough coordinates and are similar on their full sets."""
    left = sets.select(*[F.col(c).alias(f"{c}_a") for c in ("rep", "signature", "shingles")])
    right = sets.select(*[F.col(c).alias(f"{c}_b") for c in ("rep", "signature", "shingles")])
    both = pairs.join(left, F.col("a") == F.col("rep_a")).join(right, F.col("b") == F.col("rep_b"))
    matched = both.where(F.size(F.array_intersect("signature_a", "signature_b")) >= matches(similar))
    inter = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return matched.where(enough(inter, F.size("shingles_a"), F.size("shingles_b"), similar)).select("a", "b")


def labelled(posts: DataFrame, merged: DataFrame | None) -> DataFrame:
    """Postings with the component of each member, without those that are one component."""
    if merged is None:
        return posts.withColumn("comp", F.col("rep"))
    comps = merged.select(F.col("a").alias("rep"), F.col("b").alias("comp"))
    got = posts.join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = got.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return got.join(mixed, "key", "left_semi")


def proposals(active: DataFrame, turn: int) -> DataFrame:
    """Each member of a posting with the posting's leader of this round; distinct pairs a > b."""
    rank = -F.col("common").cast("bigint") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    lead = active.groupBy("key").agg(F.min(F.struct(rank.alias("rank"), "rep", "comp")).alias("lead"))
    met = active.join(lead, "key").where(F.col("comp") != F.col("lead.comp"))
    return met.select(
        F.greatest("rep", "lead.rep").alias("a"), F.least("rep", "lead.rep").alias("b")
    ).distinct()


def bounded(active: DataFrame, sets: DataFrame, similar: int = NUM) -> DataFrame:
    """The members that may still have a link, with their size and number of shared shingles."""
    members = active.select("rep").distinct()
    own = sets.join(members, "rep", "left_semi").select("rep", "n", F.explode("shingles").alias("x"))
    common = own.groupBy("x").agg(F.count("*").alias("c")).where("c > 1").select("x")
    counts = own.join(common, "x").groupBy("rep", "n").agg(F.count("*").alias("shared"))
    # the partner is not smaller than the intersection: 100 * shared >= similar * n
    return counts.where(DEN * F.col("shared") >= similar * F.col("n"))


def remaining(active: DataFrame, bounds: DataFrame, similar: int = NUM) -> DataFrame:
    """All pairs of a posting that are of two components and within the bound, each pair once."""
    keys = active.groupBy("rep").agg(F.collect_set("key").alias("keys"))  # a prefix at most
    posts = active.join(bounds, "rep").join(keys, "rep")
    left = posts.select("key", *[F.col(c).alias(f"{c}_a") for c in ("rep", "comp", "n", "shared", "keys")])
    right = posts.select("key", *[F.col(c).alias(f"{c}_b") for c in ("rep", "comp", "n", "shared", "keys")])
    most = F.least("shared_a", "shared_b", "n_a", "n_b")
    meet = (
        (F.col("rep_a") > F.col("rep_b"))
        & (F.col("comp_a") != F.col("comp_b"))
        & enough(most, F.col("n_a"), F.col("n_b"), similar)
        & (F.array_min(F.array_intersect("keys_a", "keys_b")) == F.col("key_a"))
    )
    left = left.withColumnRenamed("key", "key_a")
    right = right.withColumnRenamed("key", "key_b")
    pairs = left.join(right, (F.col("key_a") == F.col("key_b")) & meet)
    return pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def near_duplicates(spark: SparkSession, docs: DataFrame, rounds: int = ROUNDS, similar: int = NUM) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row; links are of ``similar`` hundredths or more."""
    scratch = Scratch(spark, "near-dedup")
    marks = scratch.keep(signed(docs), "signed")
    classes = scratch.keep(
        marks.where(F.col("doc_id").isNotNull() & F.col("signature").isNotNull())
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("doc_id").alias("rep"), "signature")).alias("x"))
        .select("digest", "x.rep", "x.signature"),
        "classes",
    )
    posts = scratch.keep(postings(classes, similar), "posts")
    members = posts.select(F.col("rep").alias("doc_id")).distinct()
    sets = scratch.keep(with_sets(docs.join(members, "doc_id", "left_semi")), "sets")
    links, merged = [], None
    for turn in range(rounds):
        active = labelled(posts, merged)
        found = scratch.keep(confirmed(proposals(active, turn), sets, similar), f"links-{turn}")
        links.append(found)
        merged = components(_all(links), scratch, f"round-{turn}")
    active = scratch.keep(labelled(posts, merged), "active")
    bounds = scratch.keep(bounded(active, sets, similar), "bounds")
    links.append(scratch.keep(confirmed(remaining(active, bounds, similar), sets, similar), "links-rest"))
    # rows of one class are linked to its smallest id
    same = marks.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest")
    links.append(same.where(F.col("doc_id") > F.col("rep")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    final = components(_all(links), scratch, "final")
    scratch.drop("classes", "posts", "sets", "active", "bounds", *[f"links-{t}" for t in range(rounds)], "links-rest")
    comps = final.select(F.col("a").alias("doc_id"), F.col("b").alias("component_id"))
    return (
        marks.select("doc_id", "n_shingles")
        .join(comps, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
    )


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for df in links[1:]:
        out = out.union(df)
    return out


def apart(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``node, doc_id, text`` of ``docs``, where different texts of one id are different nodes, and what
    node stands for which id.

    All other rows have their id for a node. The new numbers lie beyond all ids, on the side with more room.
    """
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    hashed = slim.where("doc_id is not null").select("doc_id", digest.alias("digest"))
    several = hashed.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi")
    texts = hashed.join(several.select("doc_id"), "doc_id", "left_semi").distinct()
    low, high = slim.agg(F.min("doc_id"), F.max("doc_id")).first()
    number = F.monotonically_increasing_id()
    node = number + F.lit((high or 0) + 1) if (high or 0) < -(low or 0) else F.lit((low or 0) - 1) - number
    nodes = scratch.keep(texts.select("doc_id", "digest", node.alias("node")), "nodes")
    ids = nodes.select("doc_id").distinct()
    alone = slim.join(ids, "doc_id", "left_anti").select(F.col("doc_id").alias("node"), "doc_id", "text")
    more = slim.join(ids, "doc_id", "left_semi").withColumn("digest", digest).join(nodes, ["doc_id", "digest"])
    return alone.union(more.select("node", "doc_id", "text")), nodes


def deduplicate(spark: SparkSession, docs: DataFrame, similar: int = NUM) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the smallest id.

    Of rows with one id and one text, one stays. Different texts of one id are documents of their own,
    each in the component of its text; where several of them are in one component, the text with the
    least digest stays. Rows with a null id stay.
    """
    scratch = Scratch(spark, "near-dedup-out")
    nodes_of, named = apart(docs, scratch)
    found = near_duplicates(spark, nodes_of.select(F.col("node").alias("doc_id"), "text"), similar=similar)
    own = found.where("doc_id is not null").select(F.col("doc_id").alias("node"), "component_id").distinct()
    ids = own.join(named.select("node", "doc_id", "digest"), "node", "left")
    rank = F.struct(F.coalesce("doc_id", "node").alias("id"), "digest", "node")
    best = ids.withColumn("_rank", rank).groupBy("component_id").agg(F.min("_rank").alias("best"), F.count("*").alias("n"))
    lost = ids.withColumn("_rank", rank).join(best.where("n > 1"), "component_id").where(F.col("_rank") != F.col("best"))
    gone = scratch.keep(lost.select(F.col("_rank.id").alias("doc_id"), "digest"), "gone")
    whole = gone.where("digest is null").select("doc_id")
    mark, key = free_name(docs, "_digest"), free_name(docs, "_id")
    kept = docs.join(whole, "doc_id", "left_anti").select(docs.columns)
    twice = scratch.keep(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "twice")
    once = kept.join(twice, "doc_id", "left_anti").select(docs.columns)
    some = kept.join(twice, "doc_id", "left_semi").select(docs.columns).withColumn(mark, F.sha2(F.coalesce("text", F.lit("")), 256))
    texts = gone.where("digest is not null").select(F.col("doc_id").alias(key), F.col("digest").alias("_gone"))
    some = some.join(texts, (F.col("doc_id") == F.col(key)) & (F.col(mark) == F.col("_gone")), "left_anti")
    one = some.groupBy("doc_id", mark).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(key)).select(f"{key}.*")
    return once.union(one.select(docs.columns))
