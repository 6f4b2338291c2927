"""Texts of an Arrow batch as flat numpy arrays: bytes, words and their 64-bit hashes.

Nothing here knows Spark. A task gets Arrow batches, cuts them into chunks of a few megabytes
and works on the chunk's bytes without making a Python string of each word. A null text
counts as an empty one.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20  # bytes of text that are worked on at a time; a longer text is a chunk by itself
BLOCK = 1 << 19  # bytes that are hashed at a time

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """The first ``n`` odd numbers of a fixed random sequence."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed << 32)) | U(1)


BYTES = randoms(256, 1)
PLACES = randoms(4096, 2)


def places(n: int) -> np.ndarray:
    """Multipliers of the first ``n`` bytes of a word."""
    global PLACES
    if n > len(PLACES):
        PLACES = randoms(2 * n, 2)
    return PLACES


class Texts:
    """A chunk: ``data`` holds the bytes of ``n`` texts, text i from ``at[i]`` to ``at[i + 1]``."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("") if column.null_count else column
        column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
        at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
        buffer = column.buffers()[2]
        data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
        self.n = len(column)
        self.at = at - at[0]
        self.data = data[at[0] : at[-1]]

    def bytes(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values``, one a byte, over each text."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return total[self.at[1:]] - total[self.at[:-1]]


class Words:
    """The words of a chunk: runs of bytes that are not ``space``, in their order.

    ``first`` and ``last`` are the bytes where a word starts and the one after its end, ``doc``
    its text, ``at[i]`` the number of words before text i.
    """

    def __init__(self, texts: Texts, space: np.ndarray = SPACE):
        inside = np.zeros(len(texts.data) + 1, bool)
        np.logical_not(space[texts.data], out=inside[:-1])
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = np.zeros(len(inside), bool)
        ends[1:] = inside[:-1] & ~inside[1:]
        cuts = texts.at[1:-1]  # a text ends a word even if the next one starts with a letter
        cuts = cuts[(cuts > 0) & (cuts < len(texts.data))]
        begins[cuts] = inside[cuts]
        ends[cuts] = inside[cuts - 1]
        self.first = np.flatnonzero(begins)
        self.last = np.flatnonzero(ends)
        self.at = np.searchsorted(self.first, texts.at)
        self.counts = np.diff(self.at)
        self.doc = np.repeat(np.arange(texts.n), self.counts)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word, from a multilinear form over its bytes."""
        out = np.empty(len(self.first), U)
        cuts = np.searchsorted(self.first, np.arange(0, len(data) + BLOCK, BLOCK))
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i == j:
                continue
            start, length = self.first[i:j], self.last[i:j] - self.first[i:j]
            from_, to = start[0], self.last[j - 1]
            begins = np.zeros(to - from_, np.int64)
            begins[start - from_] = np.arange(1, j - i + 1)
            word = np.maximum.accumulate(begins) - 1
            offset = np.arange(to - from_) - (start - from_)[word]
            used = offset < length[word]
            terms = BYTES[data[from_:to]] * places(int(length.max()) + 1)[np.where(used, offset, 0)]
            terms[~used] = 0
            out[i:j] = np.add.reduceat(terms, start - from_) + length.astype(U)
        return mix(out)

    def windows(self, hashes: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``k`` consecutive words of one text, and the word where each starts."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, U), np.zeros(0, np.int64)
        start = np.flatnonzero(self.doc[: n] == self.doc[k - 1 :])
        total = np.zeros(len(start), U)
        for j, m in enumerate(randoms(k, seed)):
            total += hashes[start + j] * m
        return mix(total), start


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``limit`` bytes of ``column``, at least one row each."""
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(texts), 0)
    ends = np.cumsum(np.asarray(sizes, np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop

