"""Plan shapes: joins, totals and top rows that hold when one key has a large share of the
rows, and values that are computed once."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 100_000


def computed_once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` and the new columns, whose values later steps read and do not work out again.

    A filter on a computed column is otherwise pushed below the projection, with a second
    copy of what it takes to compute it. Spark pushes nothing through a generator, so the
    columns go through one that makes one row of one row.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*keep, F.inline(F.array(row)))


def carried(
    blocks: DataFrame, keys: list[str], block: str, total: Column, out: str, start=None
) -> DataFrame:
    """What all earlier blocks of the same keys amount to; ``blocks`` has a row per block."""
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    value = total.over(before)
    return blocks.withColumn(out, value if start is None else F.coalesce(value, F.lit(start)))


def running(
    df: DataFrame,
    keys: list[str],
    pos: str,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    block_size: int = BLOCK,
) -> DataFrame:
    """Running sums and last non-null values per key, in the order of the integer ``pos``.

    ``pos`` is unique within its keys, so cutting it into ranges of ``block_size`` bounds what a
    task sorts, however many rows a key has. Totals of the ranges are added up before they are
    moved, from a second read of the few columns they need, and carried over by a window over one
    row per range. Ask for all running columns in one call: the rows are moved once for it. Keys
    may be null.
    """
    sums, lasts = sums or {}, lasts or {}
    # A struct of the keys equals another with nulls in the same places, so no row is lost.
    by = ["_keys", "_block"]
    ranged = df.withColumns({"_keys": F.struct(*keys), "_block": F.expr(f"{pos} div {block_size}")})
    totals = [F.sum(c).alias(f"_sum_{out}") for out, c in sums.items()]
    totals += [
        F.max_by(c, F.when(c.isNotNull(), F.col(pos))).alias(f"_last_{out}")
        for out, c in lasts.items()
    ]
    blocks = ranged.groupBy(*by).agg(*totals)
    for out in sums:
        blocks = carried(blocks, ["_keys"], "_block", F.sum(f"_sum_{out}"), f"_before_{out}", 0)
    for out in lasts:
        last = F.last(f"_last_{out}", ignorenulls=True)
        blocks = carried(blocks, ["_keys"], "_block", last, f"_before_{out}")
    outs = [*sums, *lasts]
    blocks = blocks.select(*by, *[f"_before_{out}" for out in outs])

    inside = (
        Window.partitionBy(*by)
        .orderBy(pos)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = ranged.join(blocks, by)
    for out, c in sums.items():
        joined = joined.withColumn(out, F.sum(c).over(inside) + F.col(f"_before_{out}"))
    for out, c in lasts.items():
        here = F.last(c, ignorenulls=True).over(inside)
        joined = joined.withColumn(out, F.coalesce(here, F.col(f"_before_{out}")))
    return joined.select(*df.columns, *outs)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str) -> DataFrame:
    """The first ``k`` rows per key in a total order, with their rank.

    Spark cuts every input partition to ``k`` rows per key before the shuffle, as long as ``k`` is
    within its own ``spark.sql.optimizer.windowGroupLimitThreshold``.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(ranked)).where(F.col(rank) <= k)
