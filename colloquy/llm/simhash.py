"""SimHash near-duplicates by vantage-point trees over 64-bit fingerprints.

Documents whose fingerprints differ in ``DISTANCE`` bits or fewer are linked. The steps:

1. Each text gives its fingerprint (one pass, no shuffle). Documents with one fingerprint are a class,
   linked to its smallest id; only one row of a class goes on, however many copies there are.
2. A vantage-point tree is fitted on a sample: one in ``SAMPLED`` of the distinct fingerprints, ``SAMPLE`` at
   most, those with the least hash. A node has a vantage point and the median distance from it: what is
   not farther is inside, the rest is outside. Its leaves are the shards.
3. All fingerprints are sent down the tree. Each has one home. Triangle bound: of two that differ in
   two bits, the distances from a vantage point differ by two at most. So what is outside by two or
   less also goes inside as a guest, and a guest goes on to each side that may hold something near.
   Every pair meets in the home of one of the two, once.
4. A shard holds its homes and guests against its homes, through rings of distances from further vantage
   points (a ring meets those two around it), until a piece is small enough to count the bits of all its
   pairs. It hands on a spanning forest of the links, so a dense shard costs a link per fingerprint.
5. Links of shards and of classes become components.

No pair is missed: both bounds are exact. A fingerprint has 2080 others within two bits at most, and
equal ones are one class, so no shard grows with the size of a group of copies. The number of shards grows
with the data until the sample has ``SAMPLE`` points; from then on (about 17 million fingerprints) shards do.

Defined results
* null or empty text, or a text without words: fingerprint zero, linked like any other.
* fewer than three words: the whole sequence as one shingle.
* a null doc_id: a fingerprint, linked with nothing, component null.
* rows with one doc_id: one node of the graph; links of each of them are links of the node.
* an empty table: no rows. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .components import components
from .flat import chunks
from .shared import Scratch

SHINGLE = 3
SEED = 42
DISTANCE = 2
SAMPLED = 64  # one in so many fingerprints is in the sample
SAMPLE = 1 << 18
SHARD = 1 << 11  # homes that a shard should have
LEAST_POINTS = 32  # of the sample, in a leaf
PIECE = 1 << 20  # pairs whose bits are counted at a time
BLOCK = 1 << 15  # shingles whose bits are summed at a time
U = np.uint64


def fingerprint(raw: bytes) -> int:
    """Bits that are set in over half of the hashes of a text's shingles."""
    words = raw.lower().split()  # for bytes, both know ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    k = min(SHINGLE, len(words))
    n, counts = len(words) - k + 1, np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        spans = zip(starts[i : min(n, i + BLOCK)], ends[i + k - 1 : min(n, i + BLOCK) + k - 1])
        hashes = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` for each row; ``fp`` is the fingerprint as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                found = [fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in chunk.column(1)]
                fps = pa.array(np.array(found, U).view(np.int64))
                yield pa.RecordBatch.from_arrays([chunk.column(0), fps], ["doc_id", "fp"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id bigint, fp bigint")


def bits(a: np.ndarray, b: np.ndarray | U) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class Tree:
    """A vantage-point tree as arrays; a child below zero is a shard: -1 the first, -2 the second."""

    def __init__(self, sample: np.ndarray, least: int):
        self.vantage: list[int] = []
        self.radius: list[int] = []
        self.inside: list[int] = []
        self.outside: list[int] = []
        self.shards = 0
        self.root = self._grown(np.unique(sample), max(1, least))

    def _grown(self, points: np.ndarray, least: int) -> int:
        split = halves(points) if len(points) > least else None
        if split is None:
            self.shards += 1
            return -self.shards
        vantage, radius, near = split
        node = len(self.vantage)
        self.vantage.append(int(vantage))
        self.radius.append(radius)
        self.inside.append(0)
        self.outside.append(0)
        self.inside[node] = self._grown(points[near], least)
        self.outside[node] = self._grown(points[~near], least)
        return node

    def routed(self, fps: np.ndarray, far: int = DISTANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each fingerprint goes: its number, the shard and whether it is a guest there."""
        out: list[tuple[np.ndarray, int, np.ndarray]] = []
        work = [(self.root, np.arange(len(fps)), np.zeros(len(fps), bool))]
        while work:
            node, rows, guest = work.pop()
            if not len(rows):
                continue
            if node < 0:
                out.append((rows, -node - 1, guest))
                continue
            d, r = bits(fps[rows], U(self.vantage[node])), self.radius[node]
            near = d <= r
            visits = ~near & (d <= r + far)  # outside, but something inside may be within ``far``
            inner = near | visits
            work.append((self.inside[node], rows[inner], guest[inner] | visits[inner]))
            outer = ~near | (guest & (d > r - far))
            work.append((self.outside[node], rows[outer], guest[outer]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        shard = np.concatenate([np.full(len(rows), s, np.int32) for rows, s, _ in out])
        return np.concatenate([x[0] for x in out]), shard, np.concatenate([x[2] for x in out])


def halves(points: np.ndarray, tries: int = 8) -> tuple[U, int, np.ndarray] | None:
    """Vantage point, radius and what is inside of it: of a few vantage points that with the widest spread."""
    best, spread = None, -1.0
    for v in points[:: max(1, len(points) // tries)][:tries]:
        d = bits(points, v)
        r = int(np.median(d))
        if not (d > r).any():  # half of the points are at the greatest distance
            r = int(d.max()) - 1
        near = d <= r
        if near.any() and d.std() > spread:
            best, spread = (v, r, near), float(d.std())
    return best


def links(homes: np.ndarray, others: np.ndarray, far: int = DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of the two lists that differ in ``far`` bits or fewer, a piece at a time."""
    work = [(np.arange(len(homes)), np.arange(len(others)))]
    while work:
        a, b = work.pop()
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) > PIECE:
            vantage = homes[a[len(a) // 2]]
            da, db = bits(homes[a], vantage), bits(others[b], vantage)
            a, b = a[np.argsort(da, kind="stable")], b[np.argsort(db, kind="stable")]
            da, db = np.sort(da), np.sort(db)
            rings = np.unique(da)
            pieces = [
                (
                    a[np.searchsorted(da, r) : np.searchsorted(da, r, "right")],
                    b[np.searchsorted(db, r - far) : np.searchsorted(db, r + far, "right")],
                )
                for r in rings
            ]
            if 4 * sum(len(x) * len(y) for x, y in pieces) < 3 * len(a) * len(b):
                work += pieces
                continue
        step = max(1, PIECE // len(b))
        for i in range(0, len(a), step):
            x, y = np.nonzero(np.bitwise_count(homes[a[i : i + step], None] ^ others[None, b]) <= far)
            yield a[i + x], b[y]


class Forest:
    """Trees of linked nodes; ``kept`` has a link for each that joined two of them."""

    def __init__(self, n: int):
        self.top = np.arange(n)
        self.kept: list[tuple[int, int]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        top = self.top
        new = top[a] != top[b]
        for x, y in zip(a[new].tolist(), b[new].tolist()):
            i, j = self._root(x), self._root(y)
            if i != j:
                top[max(i, j)] = min(i, j)
                self.kept.append((x, y))
        while (top[top] != top).any():
            top = self.top = top[top]

    def _root(self, x: int) -> int:
        while self.top[x] != x:
            x = int(self.top[x])
        return x


def shard_links(shard: pa.Table, far: int = DISTANCE) -> pa.Table:
    """Spanning links ``a > b`` between the representatives of a shard's fingerprints."""
    fps = shard["fp"].to_numpy().view(U)
    guest = shard["guest"].to_numpy()
    order = np.argsort(guest, kind="stable")  # homes first
    fps, reps = fps[order], shard["rep"].to_numpy()[order]
    n = int(len(fps) - guest.sum())
    forest = Forest(len(fps))
    for a, b in links(fps[:n], fps, far):
        once = a < b
        forest.add(a[once], b[once])
    ends = reps[np.array(forest.kept, np.int64).reshape(-1, 2)]
    return pa.table({"a": pa.array(ends.max(axis=1)), "b": pa.array(ends.min(axis=1))})


def classes(marks: DataFrame) -> DataFrame:
    """``fp, rep``: each fingerprint and the smallest id that has it."""
    return marks.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))


def fitted(distinct: DataFrame, n: int, shard: int = SHARD, sampled: int = SAMPLED, sample: int = SAMPLE) -> Tree:
    """The tree over a sample of the ``n`` distinct fingerprints."""
    size = min(sample, n // sampled)
    chosen = distinct.orderBy(F.xxhash64("fp"), "fp").limit(size).select("fp").toArrow() if size else None
    points = chosen["fp"].to_numpy().view(U) if size else np.zeros(0, U)
    return Tree(points, max(LEAST_POINTS, shard * size // max(1, n)))


def shards(distinct: DataFrame, tree: Tree, far: int = DISTANCE) -> DataFrame:
    """``shard, fp, rep, guest``: each fingerprint in its home and in the shards it is a guest of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(U)
            rows, shard, guest = tree.routed(fps, far)
            if len(rows):
                at = pa.array(rows)
                columns = [pa.array(shard), batch.column(0).take(at), batch.column(1).take(at), pa.array(guest)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "fp", "rep", "guest"])

    return distinct.select("fp", "rep").mapInArrow(run, "shard int, fp bigint, rep bigint, guest boolean")


def near_pairs(distinct: DataFrame, tree: Tree, far: int = DISTANCE) -> DataFrame:
    """``a > b``: links that join all representatives whose fingerprints are within ``far`` of each other."""
    dealt = shards(distinct, tree, far)
    return dealt.groupBy("shard").applyInArrow(lambda t: shard_links(t, far), "a bigint, b bigint")


def near_duplicates(spark: SparkSession, docs: DataFrame, far: int = DISTANCE, shard: int = SHARD, sampled: int = SAMPLED) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``."""
    scratch = Scratch(spark, "simhash")
    marks = scratch.keep(fingerprints(docs), "marks")
    distinct = scratch.keep(classes(marks), "classes")
    tree = fitted(distinct, distinct.count(), shard, sampled)
    found = scratch.keep(near_pairs(distinct, tree, far), "links")
    same = marks.join(distinct, "fp").where(F.col("doc_id") > F.col("rep"))
    every = found.union(same.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    final = components(every, scratch, "final").select(F.col("a").alias("doc_id"), F.col("b").alias("component_id"))
    scratch.drop("links")
    joined = marks.join(final, "doc_id", "left")
    return joined.withColumn("component_id", F.coalesce("component_id", "doc_id"))
