"""The queries on streams of tables, whose tables may be one file or a folder of them."""

import pytest
from pyspark.sql import functions as F

from catalog import QUERIES
from colloquy.streaming import incremental_ingest, run_available


@pytest.fixture(scope="module", params=["one file", "a folder"])
def tables(spark, tmp_path_factory, request):
    root = tmp_path_factory.mktemp("tables")
    docs = spark.range(30).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.col("id").cast("int") + 1).alias("text"), F.concat(F.lit("src"), F.col("id") % 2).alias("source")
    )
    docs.repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.range(5).write.parquet(f"{root}/others.parquet")
    if request.param == "one file":
        docs.coalesce(1).write.parquet(f"{root}/x")
        (part,) = (root / "x").glob("part-*.parquet")
        root = root / "flat"
        root.mkdir()
        (root / "documents.parquet").write_bytes(part.read_bytes())
    return str(root)


def test_transcripts(spark, tables):
    rows = QUERIES["streamed_transcripts"](spark, tables)
    assert sorted(r.doc_id for r in rows.collect()) == [*range(30)]


def test_ledger(spark, tables):
    rows = QUERIES["streamed_ledger"](spark, tables).collect()
    assert sorted(int(r.original_file_id) for r in rows) == [*range(30)]
    assert all((r.status == "success") == ((int(r.original_file_id) + 1) % 4 < 3) for r in rows)


def test_step_times(spark, tables):
    rows = {r.step: r.rows for r in QUERIES["streamed_step_times"](spark, tables).collect()}
    assert rows == {"replies": 30, "ledger": 30, "addBatch": 30, "summaries": sum((i + 1) % 4 < 3 for i in range(30))}


def test_a_file_with_a_glob_in_its_name(spark, tmp_path):
    for name in ("a[1].txt", "a1.txt"):
        (tmp_path / name).write_text(name)
    out = str(tmp_path / "out")
    run_available(incremental_ingest(spark, f"file://{tmp_path}/a[1].txt"), out, str(tmp_path / "cp"))
    assert [bytes(r.content) for r in spark.read.parquet(out).collect()] == [b"a[1].txt"]
