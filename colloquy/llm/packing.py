"""Token ids of documents, packed into rows of equal length.

A text is encoded with a public byte-level vocabulary and ends with the end-of-text id. What is
longer than a row is split into whole rows and a rest, losslessly; the rests of about
``WINDOW_TOKENS`` tokens of a partition are packed at a time by best fit decreasing: the longest
goes first, into the fullest row that has room, which a segment tree over the room left finds in a
logarithm of steps. Nothing is shuffled: a task packs the documents it has read, and holds no more
than a window of them, so rows that are left partly empty are one or so per window.

Each row is one record: its ids as little-endian numbers (two bytes if the vocabulary allows, else
four), the cumulative lengths of its segments, and for each position the distance from its segment's
start. ``doc_ids`` and ``offsets`` say which document each segment is from and at which token of it.

Defined results
* null or empty text: the end-of-text id alone.
* null doc_id: null in ``doc_ids``. Repeated rows: packed as often as they occur.
* an empty table: no rows.
"""

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits a text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 2048
WINDOW_TOKENS = 1 << 22
REMEMBERED = 300_000  # encoded pieces that a worker keeps
ROWS = 512  # rows of a batch that leaves a task


class Encoder:
    """Ids of a text as bytes of little-endian numbers; pieces between spaces are remembered.

    The pattern never joins what stands on both sides of a single space between two characters that
    are not white space, so such pieces, each with the space before it, are encoded one by one and
    alike everywhere.
    """

    def __init__(self, ranks: bytes):
        import tiktoken

        pairs = [line.split() for line in ranks.splitlines() if line]
        table = {base64.b64decode(a): int(b) for a, b in pairs}
        self.end = max(table.values()) + 1
        self.dtype = np.dtype("<u2") if self.end < 1 << 16 else np.dtype("<u4")
        self.encoding = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known: dict[str, bytes] = {}  # without the space before it; none has white space at an end

    def _ids(self, piece: str) -> bytes:
        return array(self.code, self.encoding.encode_ordinary(piece)).tobytes()

    def encode(self, text: str) -> np.ndarray:
        known, out = self.known, []
        first, *rest = text.split(" ")
        held = first  # not yet encoded: the start of the text, or what white space ties together
        for part in rest:
            if held is None:
                ids = known.get(part)
                if ids is None:
                    if not part or part[0].isspace() or part[-1].isspace():
                        held = " " + part
                        continue
                    if len(known) >= REMEMBERED:
                        known.clear()
                    ids = known[part] = self._ids(" " + part)
                out.append(ids)
            elif not part or part[0].isspace() or part[-1].isspace():
                held = f"{held} {part}"
            elif not held or held[-1].isspace():
                out.append(self._ids(f"{held} {part}"))
                held = None
            else:
                out += [self._ids(held), self._ids(" " + part)]
                held = None
        if held is not None:
            out.append(self._ids(held))
        out.append(array(self.code, [self.end]).tobytes())
        return np.frombuffer(b"".join(out), self.dtype)


class Rooms:
    """Open rows by the room they have left, in a segment tree: the least room of at least n."""

    def __init__(self, length: int):
        self.base = 1
        while self.base < length + 1:
            self.base *= 2
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _change(self, room: int, by: int) -> None:
        node = self.base + room
        while node:
            self.count[node] += by
            node //= 2

    def put(self, room: int, row: int) -> None:
        if room:
            self.rows[room].append(row)
            self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Room and number of the fullest row with room for ``need``, which is taken out."""
        count, node = self.count, self.base + need
        if not count[node]:
            while node > 1 and not (node % 2 == 0 and count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.base
        self._change(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Which of the sizes, none above ``length``, share a row; each row in the order of placing."""
    rooms, rows = Rooms(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[i])
        if found is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        rooms.put(room - sizes[i], row)
    return rows


SCHEMA = (
    "row_id bigint, n_tokens int, input_ids binary, position_ids binary, "
    "cu_seqlens array<int>, doc_ids array<bigint>, offsets array<bigint>"
)


def packed(docs: list[tuple[int | None, np.ndarray]], length: int, pad: int, first: int) -> Iterator[pa.RecordBatch]:
    """Rows for the documents of a window, numbered from ``first``."""
    pieces = [(k, at) for k, (_, ids) in enumerate(docs) for at in range(0, len(ids), length)]
    sizes = [min(length, len(docs[k][1]) - at) for k, at in pieces]
    rows = best_fit_decreasing(sizes, length)
    for start in range(0, len(rows), ROWS):
        some = rows[start : start + ROWS]
        matrix = np.full((len(some), length), pad, docs[0][1].dtype)
        places = np.zeros((len(some), length), "<u4")
        ends, owners, offsets = [], [], []
        for r, row in enumerate(some):
            end, own, ofs = [0], [], []
            for i in row:
                k, at = pieces[i]
                to = end[-1] + sizes[i]
                matrix[r, end[-1] : to] = docs[k][1][at : at + sizes[i]]
                places[r, end[-1] : to] = np.arange(sizes[i])
                end.append(to)
                own.append(docs[k][0])
                ofs.append(at)
            ends.append(end)
            owners.append(own)
            offsets.append(ofs)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(first + start, first + start + len(some))),
                pa.array([e[-1] for e in ends], pa.int32()),
                pa.array([row.tobytes() for row in matrix], pa.binary()),
                pa.array([row.tobytes() for row in places], pa.binary()),
                pa.array(ends, pa.list_(pa.int32())),
                pa.array(owners, pa.list_(pa.int64())),
                pa.array(offsets, pa.list_(pa.int64())),
            ],
            ["row_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "offsets"],
        )


ENCODERS: dict[str, Encoder] = {}


def pack(
    spark: SparkSession, docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, window: int = WINDOW_TOKENS
) -> DataFrame:
    """Packed rows of the texts of ``docs``, see ``SCHEMA``.

    The vocabulary is read once, where the job starts, and sent to the tasks: a few megabytes,
    which is checked.
    """
    with open(vocabulary, "rb") as file:
        raw = file.read()
    if len(raw) > 64 << 20:
        raise ValueError(f"{vocabulary}: more than 64 MB")
    ranks = spark.sparkContext.broadcast(raw)
    number = hashlib.sha256(raw).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in ENCODERS:
            ENCODERS.clear()
            ENCODERS[number] = Encoder(ranks.value)
        encoder = ENCODERS[number]
        row, held, tokens = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "")
                held.append((doc_id, ids))
                tokens += len(ids)
                if tokens >= window:
                    for out in packed(held, length, encoder.end, row):
                        yield out
                        row += out.num_rows
                    held, tokens = [], 0
        if held:
            yield from packed(held, length, encoder.end, row)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)
