"""CSV files cut into blocks of every size, against Spark's multi-line reader."""

import random

import pytest

from colloquy.schemas import LEDGER
from colloquy.sources import append_ledger, read_ledger, scan_ledger
from colloquy.sources.records import csv_records

PIECES = ["", 'say "no", then\nstop', "a,b", " padded ", "back\\slash", '"', "\n", "\n\n\n", "ü" * 40, 'x"\n"y', "plain", "a\r\nb", "#c", "null"]


@pytest.fixture
def ledger(spark, tmp_path):
    rng = random.Random(4)
    rows = [
        (str(i), "\n".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 4))), "b", "t", rng.choice(PIECES), "failed", rng.choice(PIECES))
        for i in range(300)
    ]
    rows += [("long", "line\n" * 4000, "b", "t", "u", "failed", "e"), ("last", "n", "b", "t", "u", "failed", 'ends with "\n')]
    append_ledger(spark.createDataFrame(rows, LEDGER).coalesce(1), str(tmp_path / "ledger"))
    return str(tmp_path / "ledger"), rows


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [64, 257, 1000, 4096, 1 << 20])
def test_any_block_size_gives_the_same_rows(spark, ledger, size):
    path, rows = ledger
    want = as_rows(read_ledger(spark, path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        df = scan_ledger(spark, path)
        got = as_rows(df)
        tasks = csv_records(spark, path).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want
    assert [r[0] for r in got] == sorted(r[0] for r in rows)
    assert tasks > 20_000 // size


def test_several_small_files_in_a_task(spark, tmp_path):
    rows = [(str(i), "a\nb", "b", "t", "u", "failed", '"\n"') for i in range(60)]
    append_ledger(spark.createDataFrame(rows, LEDGER).repartition(12), str(tmp_path / "ledger"))
    assert as_rows(scan_ledger(spark, str(tmp_path / "ledger"))) == sorted(rows)


def test_blank_lines_open_quotes_and_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h1,h2\n\n1,"a\n\nb"\n\n\n2,"never\nclosed\n')
    (tmp_path / "b.csv").write_text("h1,h2\n")
    (tmp_path / "c.csv").write_text("")
    got = sorted(r.record for r in csv_records(spark, str(tmp_path)).collect())
    assert got == ['1,"a\n\nb"', '2,"never\nclosed']
    assert csv_records(spark, str(tmp_path / "b.csv")).count() == 0
