import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from colloquy.llm import warc as w


FRAME = "".join(f'<li class="menu entry"><a href="/topics/{i * 7919 % 1000}">Topic {i}</a></li>' for i in range(40))


@pytest.fixture(scope="module")
def pages(spark, prose):
    big, other = f"<p>{prose(400, 1)}</p>", f"<p>é {prose(500, 2)}</p>"
    rows = [(i, f"http://a/{i}", f"<html>{FRAME}{prose(120 + i % 50, i)}</html>") for i in range(300)]
    rows += [(1000 + i, f"http://b/{i}", big) for i in range(40)] + [(2000, "http://c\r\nX: y", other), (2001, None, other)]
    rows += [(3000, "u", None), (3001, "u", ""), (3002, "u", "x" * 999), (3003, "u", "x" * 999), (3004, "u", "y" * 1000), (3005, "u", "y" * 1000)]
    rows += [(None, "u", big), (None, "u", "z" * 2000), (None, "u", "z" * 2000), (2001, "again", other), (4000, "u", prose(200_000, 9))]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def expected(rows):
    out = []
    payloads = [(r.page_id, (r.html or "").encode()) for r in rows]
    best = {}
    for page, payload in payloads:
        if page is not None:
            best[payload] = max(best.get(payload, page), page)
    for page, payload in payloads:
        refers = best.get(payload) if len(payload) >= 1000 and page is not None and page != best[payload] else None
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "response" if refers is None else "revisit", refers))
    return out


def test_records_read_back(spark, pages):
    records = w.verified(w.read_warc(w.write_warc(spark, pages)))
    got = [tuple(r) for r in records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == sorted(expected(pages.collect()), key=str)
    for r in records.where("record_type = 'response'").collect():
        assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest


def test_archive_is_a_dictionary_and_a_frame_per_record(spark, pages):
    rows = w.write_warc(spark, pages.where("page_id < 2000").coalesce(1)).collect()
    assert len(rows) == 1
    content = bytes(rows[0].content)
    magic, size = struct.unpack_from("<II", content)
    assert magic == w.MAGIC and size > 1000
    known = zstandard.ZstdCompressionDict(content[8 : 8 + size])
    records = w.read_warc(spark.createDataFrame(rows)).orderBy("at").collect()
    assert records[0].at == 8 + size and records[-1].at + records[-1].length == len(content)
    for r in records[::17]:  # any record by itself, with the dictionary alone
        raw = zstandard.ZstdDecompressor(dict_data=known).decompress(content[r.at : r.at + r.length])
        assert raw.startswith(b"WARC/1.1\r\n") and w.parse(raw)["page_id"] == r.page_id
    plain = sum(len(zstandard.compress(bytes(r.payload))) for r in records if r.payload)
    assert len(content) - size < 0.65 * plain  # the dictionary is one for up to 32 MB


def test_parts_of_an_archive(spark, pages):
    archives = w.write_warc(spark, pages.coalesce(2), archive_bytes=400_000, part_bytes=20_000)
    assert archives.agg(F.max("part")).first()[0] > 0
    assert w.verified(w.read_warc(archives)).count() == pages.count()


def test_damage_is_an_error(spark, pages):
    archives = w.write_warc(spark, pages.where("page_id < 5").coalesce(1))
    broken = archives.withColumn("content", F.expr("substring(content, 1, octet_length(content) - 20)"))
    with pytest.raises(Exception, match="ends within a record"):
        w.read_warc(broken).count()


def test_empty(spark, pages):
    assert w.read_warc(w.write_warc(spark, pages.limit(0))).count() == 0


def test_files_are_the_archives(spark, pages, tmp_path):
    more = pages.withColumns({"archive": F.lit("x"), "payload": F.lit(1)})
    archives = w.write_warc(spark, more, archive_bytes=300_000, part_bytes=40_000)
    assert archives.where("part > 0").count() > 0
    w.export_warc(archives, f"file://{tmp_path}/out/archives")
    want = {}
    for r in archives.orderBy("archive", "part").collect():
        want[r.archive] = want.get(r.archive, b"") + bytes(r.content)
    assert {p.name: p.read_bytes() for p in (tmp_path / "out" / "archives").iterdir()} == want
    records = w.verified(w.read_warc(w.read_files(spark, f"{tmp_path}/out/archives")))
    got = [tuple(r) for r in records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == sorted(expected(pages.collect()), key=str)


@pytest.mark.parametrize("n", [1, 3, 7, 30])
def test_few_or_unlike_records_have_a_dictionary_too(spark, n):
    rows = [(i, f"http://a/{i}", hashlib.sha512(str(i).encode()).hexdigest() * (1 + 2000 * (i == 0))) for i in range(n)]
    (row,) = w.write_warc(spark, spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    magic, size = struct.unpack_from("<II", bytes(row.content))
    assert magic == w.MAGIC and 0 < size <= w.DICTIONARY_BYTES
    archives = spark.createDataFrame([(row.archive, 0, row.content)], w.ARCHIVES)
    got = {r.page_id: bytes(r.payload).decode() for r in w.verified(w.read_warc(archives)).collect()}
    assert got == {i: html for i, _, html in rows}


def test_no_archives(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert w.read_warc(w.write_warc(spark, none)).count() == 0
