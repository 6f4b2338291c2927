"""Periodic runs of words, found with a suffix automaton whose link tree is a link-cut forest.

A run is a stretch of consecutive words with a smallest period q, of ``times`` periods and ``least``
words or more, that no neighbouring word extends. For each text:

1. Words that can be in a run are cut out first. Three consecutive words of a run of at least two
   periods occur in it at least so often as ``seen_again`` says (three times, for runs of four periods and six
   words); so every run lies in a stretch whose triples all occur that often in the text. Triples are counted by 64-bit hashes, and
   an accident can only make a stretch longer.
2. The words of a stretch, by their bytes, make a suffix automaton (``automaton``): one state per set
   of ends, linked to the state of the longest suffix that has more ends.
3. The words are appended one after the other (``squares``). The state of each prefix is accessed in a
   link-cut forest over the links, which makes the path from the root to it one segment of the colour of
   this end. The older segments that the path is made of say where each suffix ended before: a
   segment of colour e whose deepest state on the path has strings of up to L words means that the
   last L words end at e too, and no more than L do, and that they did not end since. If the
   distance d = i - e is within L, the last L + d words repeat with smallest period d: a square and what
   precedes it.
4. Squares with one start and one period belong to one run; the last one ends where the run ends.

Segments change a logarithm of times per word, so a text of n words costs n log^2 n steps at most, also
where it is one run. A text is worked on by one task, in memory in proportion to its longest stretch;
nothing is shuffled.

Defined results
* null or empty text, or white space only: no words, no runs, an empty collapsed text.
* null doc_id and repeated rows: each row by itself.
* an empty table: no rows. Other columns are left out.
"""

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import Texts, Words, chunks

LEAST = 6
TIMES = 4
TRIPLE = 3  # words that are counted together
Run = tuple[int, int, int]


def seen_again(least: int, times: int, k: int = TRIPLE) -> int:
    """How often at least each ``k`` consecutive words of a run occur in the run."""

    def often(q: int) -> int:  # windows of the shortest run of period q, dealt over their q kinds
        return (max(least, times * q) - k + 1) // q

    # beyond q = least the quotient no longer falls: it is times - 1 from there on
    return max(1, min(often(q) for q in range(1, least + 2)))


def automaton(ids: list[int]) -> tuple[array, array, array]:
    """Length of the longest string and link of each state of the suffix automaton, and the state of each prefix.

    The first edge of a state is kept beside it; only states with more edges have a table.
    """
    length, link = array("i", [0]), array("i", [-1])
    symbol, target = array("i", [-1]), array("i", [-1])
    more: dict[int, dict[int, int]] = {}
    prefixes, last = array("i"), 0
    for c in ids:
        new = len(length)
        length.append(length[last] + 1)
        link.append(0)
        symbol.append(-1)
        target.append(-1)
        p, q = last, -1
        while p >= 0:
            if symbol[p] == c:
                q = target[p]
                break
            if symbol[p] < 0:
                symbol[p], target[p] = c, new
            else:
                table = more.setdefault(p, {})
                if c in table:
                    q = table[c]
                    break
                table[c] = new
            p = link[p]
        if p >= 0:
            if length[q] != length[p] + 1:
                twin = len(length)  # the strings of q that are suffixes of more
                length.append(length[p] + 1)
                link.append(link[q])
                symbol.append(symbol[q])
                target.append(target[q])
                if q in more:
                    more[twin] = dict(more[q])
                while p >= 0:
                    if symbol[p] == c:
                        if target[p] != q:
                            break
                        target[p] = twin
                    else:
                        if more[p][c] != q:
                            break
                        more[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[new] = q
        prefixes.append(new)
        last = new
    return length, link, prefixes


class Paths:
    """A link-cut forest over the automaton's links; every preferred path has the end it was last part of.

    ``up`` is the parent in a path's splay tree, or for its top the state above the path. The
    colour of a path is kept at its top.
    """

    def __init__(self, link: array):
        n = len(link)
        self.up = array("i", link)
        self.left, self.right, self.colour = (array("i", [-1]) * n for _ in range(3))

    def splay(self, x: int) -> None:
        """Make ``x`` the top of its path's tree."""
        up, left, right = self.up, self.left, self.right
        p = up[x]
        if p < 0 or (left[p] != x and right[p] != x):
            return
        while True:
            g = up[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            if inner and (left[g] == p) == (left[p] == x):
                self._rotate(p, g)
                self._rotate(x, p)
            elif inner:
                self._rotate(x, p)
                self._rotate(x, g)
            else:
                self._rotate(x, p)
                self.colour[x] = self.colour[p]  # p was the top
                return
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                self.colour[x] = self.colour[g]
                return

    def _rotate(self, x: int, p: int) -> None:
        up, left, right = self.up, self.left, self.right
        g = up[p]
        if g >= 0:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[x] = g
        if left[p] == x:
            child = left[p] = right[x]
            right[x] = p
        else:
            child = right[p] = left[x]
            left[x] = p
        if child >= 0:
            up[child] = p
        up[p] = x

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Colour the path from the root to ``state`` with ``end``.

        Returns the colour and the deepest state of each segment that the path was made of.
        """
        up, right, colour = self.up, self.right, self.colour
        seen, below, x = [], -1, state
        while x >= 0:
            self.splay(x)
            seen.append((colour[x], x))
            if right[x] >= 0:
                colour[right[x]] = colour[x]
            right[x] = below
            below, x = x, up[x]
        self.splay(state)
        colour[state] = end
        return seen


def squares(ids: list[int], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """The runs of a sequence as (start, length, period), in this order."""
    length, link, prefixes = automaton(ids)
    paths = Paths(link)
    ends: dict[tuple[int, int], int] = {}
    for i, state in enumerate(prefixes):
        for e, x in paths.access(state, i):
            if e >= 0:
                d, common = i - e, length[x]
                if common >= (times - 1) * d and common + d >= least:
                    ends[e - common + 1, d] = i
    return sorted((start, end - start + 1, d) for (start, d), end in ends.items())


def stretches(texts: Texts, words: Words, least: int, times: int) -> list[tuple[int, int]]:
    """First and last word, as numbers of the chunk, of the parts of texts that runs lie in."""
    k = min(TRIPLE, least)
    grams, start = words.windows(words.hashes(texts.data), k, 21)
    if not len(start):
        return []
    keys = grams + words.doc[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    again = seen_again(least, times, k)
    ordered = np.sort(keys)
    often = ordered[again - 1 :][ordered[again - 1 :] == ordered[: len(ordered) - again + 1]]
    if not len(often):
        return []
    at = start[np.isin(keys, np.unique(often))]
    new = np.flatnonzero(np.diff(at) != 1) + 1
    first = at[np.concatenate([[0], new])]
    last = at[np.append(new, len(at)) - 1] + k - 1
    long = last - first + 1 >= least
    return list(zip(first[long].tolist(), last[long].tolist()))


def text_runs(texts: Texts, least: int, times: int) -> tuple[Words, list[list[Run]]]:
    """The runs of each text of a chunk, by start and period."""
    words = Words(texts)
    found: list[list[Run]] = [[] for _ in range(texts.n)]
    data, begins, ends = texts.data, words.first, words.last
    for first, last in stretches(texts, words, least, times):
        known: dict[bytes, int] = {}
        spans = zip(begins[first : last + 1].tolist(), ends[first : last + 1].tolist())
        ids = [known.setdefault(data[i:j].tobytes(), len(known)) for i, j in spans]
        doc = int(words.doc[first])
        shift = first - int(words.at[doc])
        found[doc] += [(s + shift, n, q) for s, n, q in squares(ids, least, times)]
    return words, [sorted(own) for own in found]


def collapsed(raw: bytes, own: list[Run]) -> bytes:
    """The words that are not after the first period of a run, with one space between them."""
    words = raw.split()
    if own:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, n, q in own:
            gone[start + q] += 1
            gone[start + n] -= 1
        words = [w for w, drop in zip(words, np.cumsum(gone).tolist()) if not drop]
    return b" ".join(words)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row of ``docs``.

    ``runs`` has start, length and period of every run of ``least`` words and ``times`` periods (two at
    least), by start and period; ``collapsed`` is the text with one period of each run left.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                texts = Texts(chunk.column(1))
                words, found = text_runs(texts, least, times)
                ends = np.cumsum([0, *map(len, found)])
                flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
                rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN))
                left = [collapsed(texts.bytes(i), own) for i, own in enumerate(found)]
                yield pa.RecordBatch.from_arrays(
                    [
                        chunk.column(0),
                        pa.array(words.counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows),
                        pa.array(left, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return slim.mapInArrow(run, schema)
