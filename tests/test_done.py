"""The filter of done files, against the anti join."""

import pytest
from pyspark.sql import functions as F

from colloquy.operators import add_done, maybe_done, merged_done, unprocessed, unprocessed_by_filter


@pytest.fixture
def tables(spark):
    ids = spark.range(4000).select(F.concat(F.lit("fü "), "id").alias("file_id"), F.col("id"))
    listed = ids.select("file_id", F.lit("u").alias("user_folder_id")).union(spark.sql("select null, 'u'"))
    status = F.when(F.col("id") % 5 == 0, "failed").otherwise("success")
    ledger = ids.where("id < 3000").select(F.col("file_id").alias("original_file_id"), status.alias("status"), "id")
    return listed, ledger.union(spark.sql("select null, 'success', 1"))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("buckets", [1, 4, 4096])
def test_gives_the_rows_of_the_anti_join(spark, tables, tmp_path, buckets):
    listed, ledger = tables
    out = str(tmp_path / "out")
    for lot in range(3):
        add_done(ledger.where(F.col("id") % 3 == lot), out, f"b{lot}", buckets)
    done = merged_done(spark, out)
    assert rows(unprocessed_by_filter(listed, done, ledger, buckets)) == rows(unprocessed(listed, ledger))
    tested = maybe_done(listed, done, buckets)
    known = ledger.where("status = 'success'").select(F.col("original_file_id").alias("file_id"))
    assert tested.join(known, "file_id").where(~F.col("maybe_done")).count() == 0  # what is done is never missed
    wrong = tested.where("maybe_done").join(known, "file_id", "left_anti").count()
    assert wrong <= {1: 500, 4: 30, 4096: 8}[buckets]
    with pytest.raises(FileExistsError):
        add_done(ledger, out, "b0", buckets)


def test_an_empty_filter_knows_nothing(spark, tables, tmp_path):
    listed, ledger = tables
    done = merged_done(spark, str(tmp_path / "none"))
    assert maybe_done(listed, done).where("maybe_done").count() == 0


def test_files_that_are_new_for_certain_do_not_meet_the_ledger(spark, tables, tmp_path):
    listed, ledger = tables
    ledger.write.parquet(str(tmp_path / "ledger"))
    stored = spark.read.parquet(str(tmp_path / "ledger"))
    add_done(stored, str(tmp_path / "out"), "b")
    df = unprocessed_by_filter(listed, merged_done(spark, str(tmp_path / "out")), stored)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,success)" in plan  # pushed to the scan of the ledger
