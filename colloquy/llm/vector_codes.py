"""Product codes of vectors: k-means per part, over metric trees of the anchors hierarchy.

A vector's components become integers floor(``SCALE`` * x) and are cut into ``PARTS`` equal consecutive
parts. Each part position has a codebook of ``ENTRIES`` entries, first those of the smallest ids. In each of
``ROUNDS`` rounds every part goes to its nearest entry (ties to the lower one) and each entry becomes the
floor of the mean of its parts; an entry without parts stays. All sums are of integers, so the result
does not depend on how rows are dealt out. The steps:

1. A task puts ``BLOCK`` vectors at a time into trees, one per part position, and writes them
   (``planted``). Anchors hierarchy (Moore, 2000): the point farthest from its anchor becomes the next anchor
   and takes over what is nearer to it, until there are about as many anchors as points in each; a part
   of more than ``LEAF`` points is divided again. Middle-out: the two anchors whose joint ball is smallest are
   joined until one ball is left. Every ball keeps its centre, radius, count and integer sum.
2. In a round a task goes down its trees (``entered``). A ball inherits the candidate entries of the one
   above it. A candidate that is farther than another one from every point of the ball, by the distance
   of the centre from the bisecting plane, is crossed off for good. A ball with one candidate left is
   wholly owned and adds its cached sum and count; below it nothing is looked at. At a leaf the
   candidates that are left are compared with each point in integers.
3. Sums and counts are added up per task, then over tasks: a row per part, entry and component, whatever
   the number of vectors. Only these and the codebooks pass the driver.

Crossing off uses floating-point numbers with a margin above their error, so a tie is never decided by them.

Defined results
* a null vector, or one with a null or non-finite component: dropped.
* vectors of other lengths: the longest one, rounded up to a multiple of ``PARTS``, gives the length;
  shorter ones are filled up with zeros. An empty vector is all zeros.
* a component whose integer is beyond what squares allow (2^27 for 64 components, see ``bound``): counts as that bound.
* fewer vectors than ``ENTRIES``: as many entries as vectors. Equal entries: the lower one owns.
* null vec_id: after all others when entries are chosen. Repeated rows: each is a row; equal ids are
  ordered by their components.
* null labels: together, like any other label; a sum beyond a long is null.
* an empty table: no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
BLOCK = 8192
LEAF = 128
MARGIN = 1e-9  # of the distances, far above the error of their floating-point values
PAIRS = 1 << 20  # points and candidates that are compared at a time


def finite(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding, label`` of the rows whose vector has numbers only."""

    def number(x):
        value = x.cast("double")
        return x.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))

    slim = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label")
    return slim.where(F.col("embedding").isNotNull() & F.forall("embedding", number))


def bound(width: int) -> int:
    """The largest integer of a component: squared distances of ``width`` of them fit a long."""
    return 1 << (62 - max(1, width).bit_length()) // 2 - 1


def integers(column: pa.Array, width: int) -> np.ndarray:
    """A row per vector: floor(SCALE * x) of its components, filled up with zeros to ``width``."""
    sizes = np.diff(column.offsets.to_numpy())
    values = np.asarray(column.flatten(), np.float64)
    most = bound(width)
    with np.errstate(over="ignore"):
        found = np.clip(np.floor(values * SCALE), -most, most).astype(np.int64)
    if len(sizes) and (sizes == width).all():
        return found.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = found
    return out


@dataclass
class Balls:
    """A metric tree over ``points``, which ``rows`` puts in the order of the leaves.

    Ball i has the points ``first[i]`` to ``last[i]`` of that order and the children ``one[i]`` and ``other[i]``,
    -1 for a leaf; ball 0 has them all.
    """

    rows: np.ndarray
    first: np.ndarray
    last: np.ndarray
    one: np.ndarray
    other: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    NAMES = ("rows", "first", "last", "one", "other", "centre", "radius", "sums")
    TYPES = ("<i4", "<i4", "<i4", "<i4", "<i4", "<f8", "<f8", "<i8")

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, n), t).tobytes() for n, t in zip(self.NAMES, self.TYPES)]

    @classmethod
    def unpacked(cls, cells: list[bytes], width: int) -> Balls:
        got = [np.frombuffer(cell, t) for cell, t in zip(cells, cls.TYPES)]
        balls = cls(*got)
        balls.centre, balls.sums = balls.centre.reshape(-1, width), balls.sums.reshape(-1, width)
        return balls


def anchors(points: np.ndarray, wanted: int) -> list[np.ndarray]:
    """The rows that each anchor owns; the farthest point of the widest anchor is the next one."""
    owner = np.zeros(len(points), np.int64)
    pivots = [points[0]]
    away = np.sqrt(((points - pivots[0]) ** 2).sum(axis=1))
    while len(pivots) < wanted:
        far = int(away.argmax())
        if away[far] == 0:
            break
        pivot, new = points[far], len(pivots)
        between = np.sqrt(((np.array(pivots) - pivot) ** 2).sum(axis=1))
        # what is nearer to its anchor than half way to the new one stays where it is
        asked = np.flatnonzero(away > between[owner] / 2)
        d = np.sqrt(((points[asked] - pivot) ** 2).sum(axis=1))
        near = d < away[asked]
        owner[asked[near]], away[asked[near]] = new, d[near]
        owner[far], away[far] = new, 0.0
        pivots.append(pivot)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(1, len(pivots)))
    return [own for own in np.split(order, cuts) if len(own)]


def joined(centres: np.ndarray, radii: np.ndarray) -> list[tuple[int, int]]:
    """Middle-out: which two balls are joined, one after the other; the i-th join is ball n + i."""
    n = len(centres)
    centre = np.concatenate([centres, np.zeros((n - 1, centres.shape[1]))])
    radius = np.concatenate([radii, np.zeros(n - 1)])
    gap = np.full((2 * n - 1, 2 * n - 1), np.inf)

    def around(i: int, others: np.ndarray) -> np.ndarray:
        d = np.sqrt(((centre[others] - centre[i]) ** 2).sum(axis=1))
        return np.maximum(np.maximum(radius[i], radius[others]), (d + radius[i] + radius[others]) / 2)

    for i in range(1, n):
        gap[i, :i] = around(i, np.arange(i))
    alive, out = list(range(n)), []
    least = gap.min(axis=1)
    for new in range(n, 2 * n - 1):
        i = int(least.argmin())
        j = int(gap[i].argmin())
        r = gap[i, j]
        d = float(np.sqrt(((centre[i] - centre[j]) ** 2).sum()))
        t = 0.0 if d == 0 else min(1.0, max(0.0, (r - radius[i]) / d))
        centre[new], radius[new] = centre[i] + t * (centre[j] - centre[i]), r
        out.append((i, j))
        for gone in (i, j):
            gap[gone], gap[:, gone] = np.inf, np.inf
            alive.remove(gone)
        if alive:
            others = np.array(alive)
            gap[new, others] = around(new, others)
        alive.append(new)
        stale = np.array(alive)
        least[:] = np.inf
        least[stale] = gap[stale].min(axis=1)
    return out


def metric_tree(points: np.ndarray, leaf: int = LEAF) -> Balls:
    """The tree of a block's parts."""
    exact, floats = points, points.astype(np.float64)
    children: list[tuple[int, int]] = []  # of each ball, by its number; leaves have rows instead
    own: list[np.ndarray | None] = []

    def ball(pair: tuple[int, int], rows: np.ndarray | None) -> int:
        children.append(pair)
        own.append(rows)
        return len(children) - 1

    def grown(rows: np.ndarray) -> int:
        if len(rows) <= leaf:
            return ball((-1, -1), rows)
        parts = anchors(floats[rows], max(2, int(len(rows) ** 0.5)))
        if len(parts) == 1:  # all points are one
            return ball((-1, -1), rows)
        tops = [grown(rows[part]) for part in parts]
        centres = np.array([floats[rows[part]].mean(axis=0) for part in parts])
        radii = np.array([np.sqrt(((floats[rows[p]] - c) ** 2).sum(axis=1).max()) for p, c in zip(parts, centres)])
        for i, j in joined(centres, radii):
            tops.append(ball((tops[i], tops[j]), None))
        return tops[-1]

    # from the root: each ball's points are those of its children, next to each other
    work, order, at = [grown(np.arange(len(points)))], [], 0
    one, other, first, number = [], [], [], {}
    while work:
        b = work.pop()
        number[b] = len(first)
        first.append(at)
        if own[b] is not None:
            order.append(own[b])
            at += len(own[b])
        one.append(children[b][0])
        other.append(children[b][1])
        work += [c for c in reversed(children[b]) if c >= 0]
    names = np.array([number[c] for c in range(len(children))] + [-1])  # the last one: -1 stays -1
    one, other, first = names[one], names[other], np.array(first)
    last = np.zeros(len(first), np.int64)
    sizes = {number[b]: len(rows) for b, rows in enumerate(own) if rows is not None}
    for i in range(len(first) - 1, -1, -1):  # children come after their ball
        last[i] = first[i] + sizes[i] if one[i] < 0 else last[other[i]]
    rows = np.concatenate(order)
    ordered = exact[rows]
    total = np.concatenate([np.zeros((1, exact.shape[1]), np.int64), np.cumsum(ordered, axis=0)])
    sums = total[last] - total[first]
    centre = sums / (last - first)[:, None]
    counts = last - first
    starts = np.cumsum(counts) - counts
    member = np.repeat(np.arange(len(first)), counts)
    at = np.arange(len(member)) - (starts - first)[member]
    d = np.sqrt(((ordered[at] - centre[member]) ** 2).sum(axis=1))
    return Balls(rows, first, last, one, other, centre, np.maximum.reduceat(d, starts), sums)


def crossed(balls: Balls, which: np.ndarray, open_: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The candidates of each ball, of those in ``open_``, that may own a point of it."""
    floats = entries.astype(np.float64)
    away = ((balls.centre[which][:, None, :] - floats) ** 2).sum(axis=2)
    away[~open_] = np.inf
    best = away.argmin(axis=1)
    apart = np.sqrt(((floats[best][:, None, :] - floats) ** 2).sum(axis=2))
    near = away[np.arange(len(which)), best][:, None]
    r = balls.radius[which][:, None]
    # the centre lies (away - near) / (2 apart) on the best one's side of the plane between the two
    lost = away - near > 2 * apart * r + MARGIN * (away + near + apart * r + 1)
    return open_ & ~lost


def entered(balls: Balls, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entry of each point, in the order of ``balls.rows``, and sum and count of each entry's points.

    ``points`` are in that order too.
    """
    n, width = len(entries), points.shape[1]
    codes = np.zeros(len(points), np.int16)
    sums, counts = np.zeros((n, width), np.int64), np.zeros(n, np.int64)
    _, lowest = np.unique(entries, axis=0, return_index=True)
    which, open_ = np.array([0]), np.isin(np.arange(n), lowest)[None]  # of equal entries the lower one owns
    while len(which):
        open_ = crossed(balls, which, open_, entries)
        single = open_.sum(axis=1) == 1
        whole, entry = which[single], open_[single].argmax(axis=1)
        np.add.at(sums, entry, balls.sums[whole])
        np.add.at(counts, entry, balls.last[whole] - balls.first[whole])
        for ball, e in zip(whole.tolist(), entry.tolist()):
            codes[balls.first[ball] : balls.last[ball]] = e
        which, open_ = which[~single], open_[~single]
        leaf = balls.one[which] < 0
        for ball, candidates in zip(which[leaf].tolist(), open_[leaf]):
            at, of = slice(balls.first[ball], balls.last[ball]), np.flatnonzero(candidates)
            step = max(1, PAIRS // len(of))
            for i in range(at.start, at.stop, step):
                own = points[i : min(at.stop, i + step)]
                d = ((own[:, None, :] - entries[of]) ** 2).sum(axis=2)
                found = of[d.argmin(axis=1)]  # the first, so the lower one of equals
                codes[i : i + len(own)] = found
                np.add.at(sums, found, own)
                counts += np.bincount(found, minlength=n)
        which, open_ = which[~leaf], open_[~leaf]
        which = np.concatenate([balls.one[which], balls.other[which]])
        open_ = np.concatenate([open_, open_])
    return codes, sums, counts


def planted(vectors: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """``vec_ids, labels, n, points, trees``: a row per block of vectors, with a tree for each part.

    ``points`` has the parts of each position in the order of its tree's leaves.
    """
    w = width // PARTS
    label = vectors.schema["label"].dataType.simpleString()

    def rows(tables: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(tables).combine_chunks()
        found = integers(whole.column(1).chunk(0), width)
        trees, points = [], []
        for k in range(PARTS):
            part = found[:, k * w : (k + 1) * w]
            tree = metric_tree(part)
            trees.append(tree.packed())
            points.append(part[tree.rows].astype("<i8").tobytes())
        all_of_it = pa.array([0, len(found)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                *[pa.ListArray.from_arrays(all_of_it, whole.column(c).chunk(0)) for c in (0, 2)],
                pa.array([len(found)], pa.int64()),
                pa.array([points], pa.list_(pa.binary())),
                pa.array([trees], pa.list_(pa.list_(pa.binary()))),
            ],
            ["vec_ids", "labels", "n", "points", "trees"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, block - size)
                batch = batch.slice(some.num_rows)
                held.append(some)
                size += some.num_rows
                if size == block:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    schema = f"vec_ids array<bigint>, labels array<{label}>, n bigint, points array<binary>, trees array<array<binary>>"
    return vectors.select("vec_id", "embedding", "label").mapInArrow(run, schema)


def blocks(batches: Iterator[pa.RecordBatch], w: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[Balls, np.ndarray]]]]:
    """The rows of a table of blocks, one at a time, with tree and points of each part."""
    for batch in batches:
        points, trees = batch.schema.get_field_index("points"), batch.schema.get_field_index("trees")
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            cells = zip(row.column(trees)[0].as_py(), row.column(points)[0].as_py())
            yield row, [(Balls.unpacked(tree, w), np.frombuffer(own, "<i8").reshape(-1, w)) for tree, own in cells]


def totals(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """``part, entry, place, total, n``: sums and counts of the parts that each entry owns."""
    w = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for _, parts in blocks(batches, w):
            for k, (balls, points) in enumerate(parts):
                _, total, n = entered(balls, points, books[k])
                sums[k] += total
                counts[k] += n
        part, entry, place = (x.ravel() for x in np.indices(books.shape))
        used = counts[part, entry] > 0
        columns = [part, entry, place, sums.ravel(), np.repeat(counts.ravel(), w)]
        yield pa.RecordBatch.from_arrays([pa.array(c[used]) for c in columns], ["part", "entry", "place", "total", "n"])

    each = trees.select("points", "trees").mapInArrow(run, "part bigint, entry bigint, place bigint, total bigint, n bigint")
    return each.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def moved(books: np.ndarray, sums: DataFrame) -> np.ndarray:
    """The codebooks after a round: floor of each used entry's mean."""
    out = books.copy()
    for part, entry, place, total, n in sums.collect():  # entries times components, at most
        out[part, entry, place] = total // n
    return out


def coded(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, codes, error`` of every vector."""
    w = books.shape[2]
    label = trees.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, parts in blocks(batches, w):
            n = row.column(row.schema.get_field_index("n"))[0].as_py()
            codes, error = np.zeros((n, PARTS), np.uint8), np.zeros(n, np.int64)
            for k, (balls, points) in enumerate(parts):
                own, _, _ = entered(balls, points, books[k])
                codes[balls.rows, k] = own
                error[balls.rows] += ((points - books[k][own]) ** 2).sum(axis=1)
            lists = [row.column(row.schema.get_field_index(c)) for c in ("vec_ids", "labels")]
            cells = [pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
            yield pa.RecordBatch.from_arrays([*[c.flatten() for c in lists], *cells], ["vec_id", "label", "codes", "error"])

    schema = f"vec_id bigint, label {label}, codes binary, error bigint"
    return trees.select("vec_ids", "labels", "n", "points", "trees").mapInArrow(run, schema)


def first_books(kept: DataFrame, width: int, entries: int) -> np.ndarray:
    """Parts of the vectors with the smallest ids, at most ``entries``: part, entry, component."""
    chosen = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    found = [integers(column, width) for column in chosen["embedding"].chunks]
    rows = np.concatenate([np.zeros((0, width), np.int64), *found])
    return rows.reshape(len(rows), PARTS, width // PARTS).transpose(1, 0, 2).copy()


def compress(
    spark: SparkSession, vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, codes, error`` of every vector that is kept, and the codebooks.

    ``codes`` has a byte per part; the codebooks are integers by part, entry and component.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is a byte: from 1 to 256 entries")
    scratch = Scratch(spark, "vector-codes")
    kept = finite(vectors)
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(1, -(-longest // PARTS)) * PARTS
    books = first_books(kept, width, entries)
    trees = scratch.keep(planted(kept, width, block), "trees")
    if not books.shape[1]:
        return coded(trees, books), books
    for _ in range(rounds):
        books = moved(books, totals(trees, books))
    return coded(trees, books), books


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``: the errors of all vectors of its label, null labels together."""
    known = F.struct("label")  # a struct of a null equals another one
    sums = codes.groupBy(known.alias("_key")).agg(F.try_sum("error").alias("label_error"))
    return codes.withColumn("_key", known).join(sums, "_key").drop("_key")


def digest(books: np.ndarray) -> str:
    """SHA-256 of the codebooks' integers, by part, entry and component, with commas between them."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
