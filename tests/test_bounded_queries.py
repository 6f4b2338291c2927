"""Queries whose tasks hold a bounded part of their input."""

from pyspark.sql import functions as F

import catalog.files
from catalog.streams import line_lots


def test_a_long_ledger_lies_in_several_files(spark, tmp_path, monkeypatch):
    docs = spark.range(95).select(
        F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("src1").alias("source"), F.lit("en").alias("lang"), F.lit(9).alias("n_chars")
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(catalog.files, "FILE_ROWS", 30)
    paths = []
    write = catalog.files.append_ledger
    monkeypatch.setattr(catalog.files, "append_ledger", lambda df, path: (paths.append(path), write(df, path)))
    rows = catalog.files.scanned_ledger(spark, str(tmp_path))
    assert sorted(int(r.original_file_id) for r in rows.collect()) == [*range(95)]
    files = spark.read.text(paths[0]).select(F.input_file_name()).distinct().count()
    assert files == 4


def test_lots_of_lines_are_bounded_in_order_and_whole(spark):
    numbers = [*range(100), *range(1000, 2000, 7), 50, 50]
    lines = spark.createDataFrame([(n,) for n in numbers], "line_no long")
    lots = [sorted(r.line_no for r in lines.where(lot).collect()) for lot in line_lots(lines, 20)]
    assert [n for lot in lots for n in lot] == sorted(numbers)
    assert max(map(len, lots)) <= 25 and len(lots) == 13
    assert len(line_lots(lines, 1000)) == 5
    assert len(line_lots(lines.limit(0), 20)) == 1
