"""Connected components of a graph whose links are a table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating star algorithm (Kiveris et al., 2014).

    ``edges`` has a row (a, b), a > b, per link. Large star: every greater neighbour of a node is
    linked to the smallest neighbour of it; small star: every smaller one is. A node with many
    neighbours is an aggregate with partial sums and a join that may be split, not a group.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = out.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") > F.col("b"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``(a, b)``: each node ``a`` that is not the smallest of its component, and that smallest, b.

    ``edges`` has columns a > b. Each round is written, so a lost executor costs one round at most;
    their number grows with the logarithm of the number of nodes.
    """

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.keep(edges.select("a", "b").distinct(), f"{name}-0")
    seen, i = digest(now), 0
    while True:
        i += 1
        step = scratch.keep(_stars(now, large=True), f"{name}-{i}-large")
        after = scratch.keep(_stars(step, large=False).distinct(), f"{name}-{i}")
        scratch.drop(f"{name}-{i}-large", f"{name}-{i - 1}")
        now, before, seen = after, seen, digest(after)
        if seen == before:
            return now
