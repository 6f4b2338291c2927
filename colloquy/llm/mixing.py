"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. A document belongs to one of its source's blocks by a hash; a source has a block for each
   ``BLOCK_WORDS`` words, so a source with a third of all rows is just many blocks.
2. A source's target says how often all its blocks are taken (epochs) and how many words more. For
   these its blocks are taken in an order permuted by a hash; in the block where the words run out,
   documents are taken in a permuted order as long as they fit.
3. The number of block drawings per source is exact. A binary tree over the output shards splits
   this vector: at every node the left half gets a multivariate-hypergeometric draw of what the
   node has, the right half the rest. So each shard is a random sample of the mix, and the shards'
   quotas sum to the sources' exactly. A leaf draws its path from the root again, with generators
   seeded by the node, so no node waits for another.
4. A source's drawings, in permuted order, are dealt to the shards by their quotas: they are
   disjoint. Within a shard, rows are in an order shuffled by a hash.

All hashes are of ids and the seed: a rerun gives the same mix.

Defined results
* sources by code point, null last, weigh ``WEIGHTS`` in turn.
* null text, or a text without words: size 0; it goes where its block goes and adds no word.
* a source without words: target 0, not taken.
* null doc_id: hashed as an id of its own. Rows with one id: taken together.
* an empty table: no rows.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .flat import mix as mix_bits
from .shared import Scratch, free_name

WEIGHTS = (5, 2, 1)
CAP = 3  # times a source's size
BLOCK_WORDS = 1 << 18
SHARD_WORDS = 1 << 23
MOST_SOURCES = 1_000_000

SIZE = r"coalesce(regexp_count(text, '[^\\x20\\x09-\\x0D]+'), 0)"


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """Key of the source, size and place of each row. The key is not null: an ``n``, or ``s`` and the name."""
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    place = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    mine = {
        free_name(docs, "_key"): key,
        free_name(docs, "_size"): F.expr(SIZE).cast("bigint"),
        free_name(docs, "_place"): place,
    }
    return docs.withColumns(mine)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``key, source_size, target`` from ``key, source_size``, a row per source.

    A share above the cap stops there, and what it leaves goes to the others by weight. In the order
    of cap to weight the sources that stop come first: the level of the rest follows from sums.
    """
    order = Window.orderBy("missing", "key")
    weighed = sizes.withColumn("missing", F.col("key") == "n").withColumn(
        "w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    )
    total = Window.partitionBy()
    before = Window.orderBy(cap * F.col("source_size") / F.col("w"), "key").rowsBetween(Window.unboundedPreceding, -1)
    rest = weighed.withColumn("left", F.sum("source_size").over(total) - F.coalesce(cap * F.sum("source_size").over(before), F.lit(0)))
    rest = rest.withColumn("w_left", F.sum("w").over(total) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    fits = cap * F.col("source_size") * F.col("w_left") >= F.col("left") * F.col("w")
    level = F.min_by(F.struct("left", "w_left"), F.when(fits, F.col("w_left") * -1.0)).over(total)
    share = F.col("level.left") * F.col("w") / F.col("level.w_left")
    return (
        rest.withColumn("level", level)
        .withColumn("target", F.least((cap * F.col("source_size")).cast("double"), F.coalesce(share, F.lit(0.0))))
        .select("key", "source_size", "target")
    )


def quotas(shard: int, shards: int, drawings: np.ndarray, seed: int) -> np.ndarray:
    """How many drawings of each source go to the shards before this one, and to this one (two rows)."""
    total, low, high = int(drawings.sum()), 0, shards
    have, before = drawings.copy(), np.zeros_like(drawings)
    while high - low > 1:
        mid = (low + high) // 2
        room = total * mid // shards - total * low // shards
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(have, room, method="marginals")
        if shard < mid:
            have, high = left, mid
        else:
            before, have, low = before + left, have - left, mid
    return np.stack([before, have])


def drawings(
    spark: SparkSession, slim: DataFrame, seed: int, scratch: Scratch, block_words: int, shard_words: int
) -> tuple[DataFrame, DataFrame, int]:
    """What is drawn: ``key, block, copy, some, shard``; the sources; the number of shards.

    ``some`` is null where all of a block is drawn, else the places in it that are. ``slim`` has
    ``key, size, place``. The windows below sort one row per block of a source, not its documents.
    """
    sources = scratch.keep(targets(slim.groupBy("key").agg(F.sum("size").alias("source_size"))), "sources")
    ratio, whole = F.col("target") / F.nullif("source_size", F.lit(0)), F.col("epochs") * F.col("source_size")
    plan = scratch.keep(
        sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)))
        .withColumn("epochs", F.least(F.lit(CAP), F.floor(F.coalesce(ratio, F.lit(0)))))
        .withColumn("more", F.when(F.col("epochs") < CAP, F.col("target") - whole).otherwise(0.0)),
        "plan",
    )
    placed = slim.join(plan.select("key", "blocks"), "key").withColumn("block", F.pmod("place", "blocks"))
    blocks = scratch.keep(placed.groupBy("key", "block").agg(F.sum("size").alias("words")), "blocks")
    permuted = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed + 1), "key", "block"), "block")
    ranked = (
        blocks.withColumn("rank", F.row_number().over(permuted) - 1)
        .withColumn("before", F.sum("words").over(permuted) - F.col("words"))
        .join(plan.select("key", "epochs", "more"), "key")
        .withColumn("room", F.col("more") - F.col("before"))
    )
    ranked = scratch.keep(ranked, "ranked")
    edge = ranked.where((F.col("room") > 0) & (F.col("room") < F.col("words"))).select("key", "block", "room")
    inside = placed.join(edge, ["key", "block"]).groupBy("key", "block", "room", "place").agg(F.sum("size").alias("size"))
    edges = inside.groupBy("key").applyInPandas(_filled(seed), "key string, block bigint, some array<bigint>")
    full = _full(ranked)
    part = ranked.join(edges, ["key", "block"]).select("key", "block", F.col("epochs").cast("int").alias("copy"), "some")
    drawn = full.union(part.select(full.columns))
    # An order of its own for each copy; the drawings of a source are numbered through all copies.
    through = Window.partitionBy("key").orderBy("copy", F.xxhash64(F.lit(seed + 3), "copy", "block"), "block")
    drawn = scratch.keep(drawn.withColumn("at", F.row_number().over(through) - 1), "drawn")
    counts = drawn.groupBy("key").agg(F.count("*").alias("n")).orderBy("key").limit(MOST_SOURCES + 1).collect()
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; merge small ones first")
    names, n = [r["key"] for r in counts], np.array([r["n"] for r in counts], np.int64)
    words = plan.agg(F.sum("target")).first()[0] or 0
    shards = max(1, -(-int(words) // shard_words))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                before, have = quotas(shard, shards, n, seed)
                used = np.flatnonzero(have)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[i] for i in used], pa.string()),
                        pa.array(np.full(len(used), shard)),
                        pa.array(before[used]),
                        pa.array(have[used]),
                    ],
                    ["key", "shard", "begin", "quota"],
                )

    ranges = spark.range(shards).mapInArrow(leaves, "key string, shard bigint, begin bigint, quota bigint")
    dealt = ranges.select("key", "shard", F.explode(F.sequence("begin", F.col("begin") + F.col("quota") - 1)).alias("at"))
    return scratch.keep(drawn.join(dealt, ["key", "at"]).drop("at"), "dealt"), plan, shards


def _full(ranked: DataFrame) -> DataFrame:
    """A row for each time that all of a block is drawn."""
    times = F.col("epochs").cast("int") + F.when((F.col("words") <= F.col("room")) & (F.col("room") > 0), 1).otherwise(0)
    copies = F.filter(F.sequence(F.lit(0), F.lit(CAP)), lambda copy: copy < times)
    return ranked.select("key", "block", F.explode(copies).alias("copy"), F.lit(None).cast("array<bigint>").alias("some"))


def _filled(seed: int):
    """Documents of a source's last block, in an order permuted by a hash, as long as they fit."""

    def fill(block: pd.DataFrame) -> pd.DataFrame:
        room = float(block["room"].iloc[0])
        place, size = block["place"].to_numpy(np.int64), block["size"].to_numpy(np.int64)
        order = np.lexsort((place, mix_bits(place.view(np.uint64) + np.uint64(seed))))
        some, over = [], None
        for i in order:
            if size[i] <= room:
                some.append(int(place[i]))
                room -= size[i]
            elif over is None or size[i] < size[over]:
                over = i
        if over is not None and size[over] - room < room:
            some.append(int(place[over]))
        return pd.DataFrame({"key": [block["key"].iloc[0]], "block": [int(block["block"].iloc[0])], "some": [some]})

    return fill


def mix_table(
    spark: SparkSession,
    docs: DataFrame,
    seed: int = 8,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies``: how often the mix takes each row."""
    scratch = Scratch(spark, "mix-table")
    slim = sized(docs.select("doc_id", "source", "text"), seed).select(
        "doc_id", "source", F.col("_key").alias("key"), F.col("_size").alias("size"), F.col("_place").alias("place")
    )
    slim = scratch.keep(slim, "slim")
    drawn, plan, _ = drawings(spark, slim, seed, scratch, block_words, shard_words)
    per_block = drawn.groupBy("key", "block").agg(
        F.count_if(F.col("some").isNull()).alias("full"), F.first("some", ignorenulls=True).alias("some")
    )
    placed = slim.join(plan.select("key", "blocks", "source_size", "target"), "key")
    placed = placed.withColumn("block", F.pmod("place", "blocks")).join(per_block, ["key", "block"], "left")
    part = F.when(F.array_contains("some", F.col("place")), 1).otherwise(0)
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", (F.coalesce("full", F.lit(0)) + part).alias("copies")
    )


def mix(
    spark: SparkSession,
    docs: DataFrame,
    seed: int = 8,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    shard: str | None = None,
) -> DataFrame:
    """The rows of the mix, repeats included, dealt to shards and shuffled within each.

    With ``shard``, a column of this name tells the shard.
    """
    scratch = Scratch(spark, "mix")
    slim = sized(docs.select("doc_id", "source", "text"), seed).select(
        F.col("_key").alias("key"), F.col("_size").alias("size"), F.col("_place").alias("place")
    )
    drawn, plan, shards = drawings(spark, scratch.keep(slim, "slim"), seed, scratch, block_words, shard_words)
    names = {c: free_name(docs, f"_{c}") for c in ("key", "size", "place", "blocks", "block", "copy", "some", "shard")}
    block = names["block"]
    sources = plan.select(F.col("key").alias(names["key"]), F.col("blocks").alias(names["blocks"]))
    drawn = drawn.select([F.col(c).alias(names[c]) for c in ("key", "block", "copy", "some", "shard")])
    rows = sized(docs, seed).join(sources, names["key"]).withColumn(block, F.pmod(names["place"], names["blocks"]))
    rows = rows.join(drawn, [names["key"], block]).where(
        F.col(names["some"]).isNull() | F.array_contains(names["some"], F.col(names["place"]))
    )
    order = F.xxhash64(F.lit(seed + 4), names["copy"], names["place"])
    # a shard is a partition: a hash of it would put several into one
    out = rows.repartitionById(shards, F.col(names["shard"]).cast("int")).sortWithinPartitions(names["shard"], order)
    keep = [F.col(c) for c in docs.columns]
    return out.select(*keep, *([F.col(names["shard"]).alias(shard)] if shard else []))
