"""CSV files of any size whose quoted values hold line breaks, read by many tasks each.

Whether a line break ends a record depends on the number of quotes before it, back to the start of the
file. So the lines are read twice, each file in as many blocks as Spark makes of it:

1. Every block gives the number of its quotes; the sum over the earlier blocks of a file says whether a
   block starts inside a quoted value. What passes the driver is the list of those that do.
2. Every block is cut at the line breaks outside of quotes. Whole records stay in their task. What
   a record has left in the blocks it lies across, two pieces for most of them, meets in a small shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..skew import carried

WHOLE, HEAD, MIDDLE, TAIL = 0, 1, 2, 3
ROWS = 10_000  # records that leave a task at a time


def _lines(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    # a value may hold a carriage return: only a line feed ends a line
    return spark.read.options(**options).text(paths, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )


def _inside(lines: DataFrame) -> set[tuple[str, int]]:
    """The blocks that start inside a quoted value."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    blocks = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = carried(blocks, ["file"], "block", F.sum("quotes"), "before", 0)
    return {(r.file, r.block) for r in before.where("before % 2 = 1").select("file", "block").collect()}


class _Block:
    """The records of one block, from its lines in order."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block, self.odd = file, block, int(inside)
        self.begun = not inside  # false as long as the record of an earlier block goes on
        self.held: list[str] = []

    def cut(self, lines: pa.Array) -> Iterator[tuple[int, str]]:
        quotes = np.asarray(pc.count_substring(lines, '"'), np.int64)
        odd = (self.odd + np.cumsum(quotes)) % 2
        texts, at = lines.to_pylist(), 0
        for end in np.flatnonzero(odd == 0).tolist():
            if self.held or end > at:
                text = "\n".join([*self.held, *texts[at : end + 1]])
                self.held = []
            else:
                text = texts[end]
            yield (WHOLE if self.begun else HEAD), text
            self.begun, at = True, end + 1
        self.held += texts[at:]
        self.odd = int(odd[-1])

    def rest(self) -> Iterator[tuple[int, str]]:
        if self.held:
            yield (TAIL if self.begun else MIDDLE), "\n".join(self.held)


def csv_records(spark: SparkSession, paths: str | list[str], header: bool = True, **options: str) -> DataFrame:
    """``record``: the text of every record of the files, without their first ones if ``header``.

    A quote inside a quoted value is written twice. Blank lines are no records. A last value whose
    quote is not closed ends with its file.
    """
    lines = _lines(spark, paths, **options)
    inside = _inside(lines)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block | None = None
        first, out = False, []

        def rows() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int8(), pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["file", "block", "kind", "record"])

        for batch in batches:
            files, starts, texts = batch.columns
            files = pc.dictionary_encode(files)
            marks = np.asarray(files.indices, np.int64), np.asarray(starts, np.int64)
            change = (np.diff(marks[0]) != 0) | (np.diff(marks[1]) != 0)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:]):
                key = files[i].as_py(), starts[i].as_py()
                if block is None or (block.file, block.block) != key:
                    if block is not None:
                        out += [(block.file, block.block, *piece) for piece in block.rest()]
                    block = _Block(*key, key in inside)
                    first = header and key[1] == 0
                for kind, text in block.cut(texts.slice(i, j - i)):
                    if first and kind == WHOLE and text:
                        first = False
                    elif text or kind != WHOLE:
                        out.append((*key, kind, text))
                    if len(out) >= ROWS:
                        yield rows()
                        out = []
        if block is not None:
            out += [(block.file, block.block, *piece) for piece in block.rest()]
        if out:
            yield rows()

    pieces = lines.mapInArrow(run, "file string, block bigint, kind tinyint, record string")
    # a record that lies across blocks: the tail of one, whole blocks, the head of the last one
    across = pieces.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "kind")
    number = F.count_if(F.col("kind") == TAIL).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    part = F.struct("block", "kind", "record")
    joined = (
        across.withColumn("number", number)
        .groupBy("file", "number")
        .agg(F.array_sort(F.collect_list(part)).alias("parts"))
        .select(F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    )
    return pieces.where(F.col("kind") == WHOLE).select("record").union(joined)


def read_csv_records(spark: SparkSession, paths: str | list[str], schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """The files as a table: what Spark's multi-line reader gives, by any number of tasks a file."""
    header = options.get("header", "false").lower() == "true"
    parsing = {k: v for k, v in options.items() if k != "header"}
    row = F.from_csv("record", F.lit(schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")), parsing)
    return csv_records(spark, paths, header).select(row.alias("row")).select("row.*")
