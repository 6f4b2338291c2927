"""WARC archives compressed record by record with a dictionary of their own.

Each archive is a ``.warc.zst`` file: a skippable frame that holds a Zstandard dictionary built
from the archive's records, then one frame per record, so that any record can be read by itself
with the dictionary alone. The archives are rows of a table, ``(archive, part, content)``; the
parts of an archive in their order are its bytes, and no part is larger than ``PART_BYTES`` unless
one record is. ``export_warc`` writes them as files.

A payload is what a page's text is in UTF-8; there is no HTTP head, as the pages carry none, and all records
have the date ``DATE``.

Of the pages with equal payloads of ``REVISIT_BYTES`` or more, the one with the largest page_id is
a response record and the others are revisits of it, without payload. Digests are counted first;
only digests that occur more than once are joined back, so pages without a copy are not compared.

Defined results
* null html: an empty payload. null url: an empty target.
* null page_id: a record of its own, never the one that others refer to.
* pages with one id and one payload: each is a response if its id is the largest of its group.
* very long payloads stay whole. Other columns are left out. An empty table: no archives.
"""

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources import write_folders

from .shared import Scratch

REVISIT_BYTES = 1000
MAGIC = 0x184D2A5D  # fixed value: the skippable frame that holds a dictionary
ARCHIVE_BYTES = 32 << 20  # of records before compression; one archive is built in memory
PART_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20  # of an archive's records, evenly spread, that the dictionary is built from
PIECE = 8 << 10  # what one record adds to the sample at most
PLACES = 8  # of a long record, that its piece may be from
LEVEL = 3
STEP = 4 << 10
DATE = "2024-01-01T00:00:00Z"  # of records whose pages carry no date

ARCHIVES = "archive string, part int, content binary"
RECORDS = (
    "archive string, at bigint, length bigint, record_type string, page_id bigint, refers_to bigint, "
    "target string, payload_digest string, payload_bytes bigint, payload binary"
)


def record(page: int | None, url: str, kind: str, digest: str, refers: int | None, payload: bytes, n: int) -> bytes:
    """One record. A revisit has no block; its headers keep the digest and length of the payload."""
    name = "null" if page is None else page
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {n}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers}>",
        ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """What a record says, and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    payload = rest[: int(fields["Content-Length"])]
    number = lambda name: None if name == "null" else int(name)
    refers = fields.get("WARC-Refers-To")
    return {
        "record_type": fields["WARC-Type"],
        "page_id": number(fields["WARC-Record-ID"][len("<urn:page:") : -1]),
        "refers_to": number(refers[len("<urn:page:") : -1]) if refers else None,
        "target": fields["WARC-Target-URI"],
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload": payload,
    }


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary from pieces of records that are spread evenly over the archive.

    A long record gives a piece from another place than the one before it did. Where there are too
    few pieces to train on, or nothing they share, the pieces themselves are the dictionary: Zstandard
    takes any content for one.
    """
    step = max(1, sum(min(len(r), PIECE) for r in records) // SAMPLE_BYTES)
    sample = []
    for i, raw in enumerate(records[::step]):
        start = max(0, len(raw) - PIECE) * (i % PLACES) // (PLACES - 1)
        sample.append(raw[start : start + PIECE])
    size = min(DICTIONARY_BYTES, sum(map(len, sample)) // 10)
    if len(sample) >= 8 and size >= 1024:
        try:
            return zstandard.train_dictionary(size, sample, k=512, d=8, steps=1, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(sample)[:DICTIONARY_BYTES]


def written(records: list[bytes], name: str, part_bytes: int) -> Iterator[pa.RecordBatch]:
    """The parts of an archive."""
    found = dictionary(records)
    known = zstandard.ZstdCompressionDict(found) if found else None
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
    part, held = 0, [struct.pack("<II", MAGIC, len(found)), found]
    size = sum(map(len, held))
    for raw in records:
        frame = packer.compress(raw)
        if size and size + len(frame) > part_bytes:
            yield _part(name, part, held)
            part, held, size = part + 1, [], 0
        held.append(frame)
        size += len(frame)
    yield _part(name, part, held)


def _part(name: str, part: int, held: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([name]), pa.array([part], pa.int32()), pa.array([b"".join(held)], pa.binary())],
        ["archive", "part", "content"],
    )


def judged(spark: SparkSession, pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``pages`` with the digest, the length and the record it revisits."""
    own = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce(F.encode("html", "utf-8"), F.lit(b"")).alias("payload"),
    )
    measured = own.withColumn("n", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha1("payload"))
    groups = (
        measured.where(F.col("n") >= REVISIT_BYTES)
        .groupBy("digest", "n")
        .agg(F.count("*").alias("rows"), F.max("page_id").alias("best"))
        .where((F.col("rows") > 1) & F.col("best").isNotNull())
        .select("digest", "n", "best")
    )
    repeated = scratch.keep(groups, "repeated")
    joined = measured.join(repeated, ["digest", "n"], "left")
    refers = F.when(F.col("page_id") != F.col("best"), F.col("best"))
    return joined.select("page_id", "url", "payload", "n", "digest", refers.alias("refers"))


def write_warc(
    spark: SparkSession, pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, part_bytes: int = PART_BYTES
) -> DataFrame:
    """The archives of ``pages``, a record per row, as a table in the shared folder."""
    scratch = Scratch(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for page, url, payload, n, digest, refers in zip(*[c.to_pylist() for c in batch.columns]):
                kind = "response" if refers is None else "revisit"
                raw = record(page, url, kind, digest, refers, payload if refers is None else b"", n)
                held.append(raw)
                size += len(raw)
                if size >= archive_bytes:
                    yield from written(held, f"pages-{task:06d}-{number:05d}.warc.zst", part_bytes)
                    number, held, size = number + 1, [], 0
        if held:
            yield from written(held, f"pages-{task:06d}-{number:05d}.warc.zst", part_bytes)

    return scratch.keep(judged(spark, pages, scratch).mapInArrow(run, ARCHIVES), "archives")


def export_warc(archives: DataFrame, folder: str) -> None:
    """Write the archives as files ``<name>.warc.zst`` below ``folder``, each by one task."""
    parts = F.array_sort(F.collect_list(F.struct("part", "content")))
    whole = archives.groupBy("archive").agg(parts.alias("parts"))
    content = F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["content"]))
    path, name = folder.rstrip("/").rsplit("/", 1)
    write_folders(whole.select(F.lit(name).alias("user_folder_id"), F.col("archive").alias("file_name"), content.alias("content")), path)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Archive files as rows of one part."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), F.lit(0).alias("part"), "content")


def read_warc(archives: DataFrame) -> DataFrame:
    """A row per record of the archives; ``at`` and ``length`` are its frame in the part.

    Only the first part of an archive has the dictionary, so parts of later ones are joined with
    it; an archive of one part, which is the rule, is read where it lies.
    """
    first = archives.where("part = 0").select("archive", F.col("content").alias("first"))
    one = archives.groupBy("archive").agg(F.max("part").alias("last"))
    more = one.where("last > 0").select("archive")
    late = archives.join(more, "archive", "left_semi").where("part > 0").join(first, "archive")
    both = archives.where("part = 0").select("archive", "content", F.lit(None).cast("binary").alias("first"))
    both = both.union(late.select("archive", "content", "first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for batch in batches:
            for name, content, head in zip(*[c.to_pylist() for c in batch.columns]):
                magic, size = struct.unpack_from("<II", head or content)
                if magic != MAGIC:
                    raise ValueError(f"{name} does not start with a dictionary")
                found = (head or content)[8 : 8 + size]
                known = zstandard.ZstdCompressionDict(found) if found else None
                reader = zstandard.ZstdDecompressor(dict_data=known)
                at, rows, held = 0 if head else 8 + size, [], 0
                while at < len(content):
                    raw, length = _frame(reader, content, at)
                    rows.append({"archive": name, "at": at, "length": length, **parse(raw)})
                    at += length
                    held += len(raw)
                    if held >= PART_BYTES:
                        yield _rows(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows, names)

    return both.mapInArrow(run, RECORDS)


def _frame(reader: zstandard.ZstdDecompressor, content: bytes, at: int) -> tuple[bytes, int]:
    """The record in the frame at ``at``, and the frame's length; it is fed in steps, as its end is
    known only when it is reached."""
    frame, out, to = reader.decompressobj(), [], at
    while not frame.eof:
        if to >= len(content):
            raise ValueError("an archive ends within a record")
        out.append(frame.decompress(content[to : to + STEP]))
        to = min(to + STEP, len(content))
    return b"".join(out), to - len(frame.unused_data) - at


def _rows(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = dict.fromkeys(("at", "length", "page_id", "refers_to", "payload_bytes"), pa.int64())
    kinds["payload"] = pa.binary()
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)


def verified(records: DataFrame) -> DataFrame:
    """Records as read back; a response whose payload is not what its headers say is an error."""
    fine = (F.sha1("payload") == F.col("payload_digest")) & (F.octet_length("payload") == F.col("payload_bytes"))
    wrong = F.raise_error(F.concat(F.lit("damaged record of page "), F.col("page_id").cast("string")))
    kind = F.when((F.col("record_type") == "revisit") | fine, F.col("record_type")).otherwise(wrong)
    return records.withColumn("record_type", kind)
