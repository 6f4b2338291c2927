"""Folders listed by tasks, against Spark's own source."""

import os
import time

import pytest
from pyspark.sql import functions as F

from colloquy.sources import scan_folders, scan_transcripts, stream_folders, write_folders
from colloquy.streaming import run_available

FILES = "user_folder_id string, file_name string, content binary"


def as_rows(df):
    return sorted((r.file_id, r.file_name, r.user_folder_id, r.is_valid_utf8, r.text or "") for r in df.collect())


@pytest.fixture
def tree(spark, tmp_path):
    rows = [(f"u {i % 5}", f"f{i} ü.txt", f"text {i}\n".encode() * (i + 1)) for i in range(60)]
    rows += [("u 1", "latin.txt", "caf\xe9".encode("latin-1")), ("u 2", "big.txt", b"x" * (9 << 20))]
    root = str(tmp_path / "in")
    write_folders(spark.createDataFrame(rows, FILES).repartition(4), root)
    return root, [f"{root}/u {i}" for i in range(5)]


@pytest.mark.parametrize("splits", [1, 3])
def test_equals_the_files_as_spark_reads_them(spark, tree, splits, tmp_path):
    root, folders = tree
    manifest = tmp_path / "folders.txt"
    manifest.write_text("\n".join(folders))
    want = as_rows(scan_transcripts(spark, root))
    assert len(want) == 62
    for given in (folders, str(manifest), [f"file://{f}" for f in folders]):
        df = scan_folders(spark, given, splits)
        assert df.rdd.getNumPartitions() == 5 * splits
        assert as_rows(df) == want
    assert df.columns == scan_transcripts(spark, root).columns


def test_empty_files_hidden_files_and_no_folders(spark, tmp_path):
    (tmp_path / "u").mkdir()
    for name in ("empty.txt", ".hidden", "_temporary"):
        (tmp_path / "u" / name).write_text("")
    (row,) = scan_folders(spark, [str(tmp_path / "u"), str(tmp_path / "no such folder")]).collect()
    assert (row.file_name, row.text) == ("empty.txt", "")
    assert scan_folders(spark, []).count() == 0


def test_names_do_not_change_the_bytes(spark, tmp_path):
    rows = [("u", "a.txt.gz", b"plain"), ("u", "b.zst", b"\x28\xb5\x2f\xfd"), ("u", "c.bz2", b"")]
    write_folders(spark.createDataFrame(rows, FILES), str(tmp_path))
    assert {p.name: p.read_bytes() for p in (tmp_path / "u").iterdir()} == {name: content for _, name, content in rows}
    got = {r.file_name: r.text for r in scan_folders(spark, [str(tmp_path / "u")]).collect()}
    assert got == {"a.txt.gz": "plain", "b.zst": None, "c.bz2": ""}


def test_offsets_are_kept_over_two_runs(spark, tree, tmp_path):
    root, folders = tree
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        run_available(stream_folders(spark, folders, settle=0), out, checkpoint)
        return sorted(r.file_name for r in spark.read.parquet(out).select("file_name").collect())

    first = run()
    assert len(first) == 62
    time.sleep(0.05)
    write_folders(spark.createDataFrame([("u 3", "later.txt", b"new")], FILES), root)
    assert run() == sorted([*first, "later.txt"])
    assert run() == sorted([*first, "later.txt"])


def test_a_file_that_is_not_settled_waits(spark, tree, tmp_path):
    root, folders = tree
    old = time.time() - 100
    for folder, _, names in os.walk(root):
        for name in names:
            os.utime(os.path.join(folder, name), (old, old))
    write_folders(spark.createDataFrame([("u 0", "now.txt", b"new")], FILES), root)
    out = str(tmp_path / "out")
    run_available(stream_folders(spark, folders, settle=60), out, str(tmp_path / "cp"))
    assert spark.read.parquet(out).count() == 62
    assert spark.read.parquet(out).where(F.col("file_name") == "now.txt").count() == 0
