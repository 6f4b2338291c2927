"""Sources, sinks, joins, streams and whole jobs on small files."""

import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from colloquy import work_dir
from colloquy.operators import (
    assemble_parts,
    assemble_transcript,
    assistant_mentions,
    citation_check,
    cue_extract,
    enrich_with_retry,
    files_of_folders,
    latest_summary,
    ledger_row,
    log_error_windows,
    owner_from_speaker,
    transcript_segments,
    unprocessed,
)
from colloquy.plans import outcomes, summarise_batch, to_summarise
from colloquy.sources import (
    append_ledger,
    attach_texts,
    inventory_report,
    list_transcripts,
    read_ledger,
    read_summaries,
    scan_transcripts,
    write_transcript_text,
)
from colloquy.schemas import DOCUMENT_MIME, INVENTORY, LEDGER
from colloquy.streaming import (
    archive_on_commit,
    incremental_ingest,
    land_summaries,
    land_transcripts,
    ledger_stream,
    run_available,
)


def put(folder, name, content):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(content if isinstance(content, bytes) else content.encode())


def test_scan(spark, tmp_path):
    put(tmp_path / "u1", "long.txt", "word " * 20000)
    put(tmp_path / "u1", "lines.txt", "one\n\ntwo ü\n")
    put(tmp_path / "u2", "lines.txt", "same name")
    put(tmp_path / "u2", "empty.txt", "")
    put(tmp_path / "u2", "latin.txt", "caf\xe9".encode("latin-1"))
    got = {
        (r.user_folder_id, r.file_name): (r.is_valid_utf8, r.text)
        for r in scan_transcripts(spark, str(tmp_path)).collect()
    }
    listed = spark.createDataFrame([("f1",), ("f2",)], "file_id string")
    bodies = spark.createDataFrame([("f1", "x")], "file_id string, text string")
    attached = {r.file_id: r.text for r in attach_texts(listed, bodies).collect()}
    assert attached == {"f1": "x", "f2": None}
    assert got == {
        ("u1", "long.txt"): (True, "word " * 20000),
        ("u1", "lines.txt"): (True, "one\n\ntwo ü\n"),
        ("u2", "lines.txt"): (True, "same name"),
        ("u2", "latin.txt"): (False, None),
    }


def test_inventory(spark):
    def person(address, role=None):
        return {"role": role, "emailAddress": address} if role != ... else {"emailAddress": address}

    rows = [
        ("1", "two owners", DOCUMENT_MIME, False, "u1", [("a@x",), ("b@x",)], [("writer", "a@x")]),
        ("2", "no owner", DOCUMENT_MIME, False, "u1", None, [(None, "a@x"), ("reader", None)]),
        ("3", "binned", DOCUMENT_MIME, True, "u1", [("a@x",)], []),
        ("4", "a sheet", "sheet", False, "u1", [("a@x",), (None,)], None),
        ("5", "elsewhere", DOCUMENT_MIME, False, "u3", [("a@x",)], []),
    ]
    inventory = spark.createDataFrame(rows, INVENTORY)
    # A folder named twice is still one folder.
    folders = spark.createDataFrame([("u1",), ("u1",), ("u2",)], "user_folder_id string")
    listed = list_transcripts(inventory, folders).collect()
    assert sorted(r.id for r in listed) == ["1", "2"]
    report = {r.id: (r.owners, r.perms, r.listing_error) for r in inventory_report(inventory, folders).collect()}
    assert report == {
        "1": ("a@x,b@x", "writer:a@x", False),
        "2": ("", ":a@x,reader:", False),
        "4": (None, "", True),
    }


def test_more_files_than_a_page(spark):
    rows = spark.range(1001).select(
        F.col("id").cast("string").alias("id"),
        F.lit("n").alias("name"),
        F.lit(DOCUMENT_MIME).alias("mime_type"),
        F.lit(False).alias("trashed"),
        F.lit("u").alias("parent_id"),
    )
    folders = spark.createDataFrame([("u",)], "user_folder_id string")
    assert list_transcripts(rows, folders).count() == 1001


def test_ledger_round_trip(spark, tmp_path):
    errors = ["", 'say "no", then\nstop', "a,b", " padded ", "back\\slash", '"', "\n"]
    rows = [(str(i), "n", "b", "t", "u", "failed" if e else "success", e) for i, e in enumerate(errors)]
    ledger = spark.createDataFrame(rows, LEDGER)
    path = str(tmp_path / "ledger")
    append_ledger(ledger, path)
    append_ledger(ledger.limit(0), path)
    append_ledger(ledger.where("status = 'success'"), path)
    stored = read_ledger(spark, path)
    assert stored.schema.names == LEDGER.names
    assert sorted(tuple(r) for r in stored.collect()) == sorted(rows + rows[:1])


def test_ledger_rows(spark):
    df = spark.createDataFrame(
        [("1", "n", None), (None, "lost", "x")], "file_id string, file_name string, error string"
    )
    (row,) = ledger_row(df, F.lit("2024-01-01T00:00:00")).collect()
    assert tuple(row) == ("1", "n", "", "2024-01-01T00:00:00", "", "", "")


def test_unprocessed_and_latest(spark):
    files = spark.createDataFrame([("1",), ("2",), ("3",)], "file_id string")
    ledger = spark.createDataFrame(
        [("1", "failed", "t1"), ("1", "success", "t2"), ("1", "success", "t3"), ("2", "failed", "t1")],
        "original_file_id string, status string, date_moved string",
    )
    assert sorted(r.file_id for r in unprocessed(files, ledger).collect()) == ["2", "3"]
    newest = latest_summary(ledger, ["original_file_id"], ["date_moved"])
    assert newest.columns == ledger.columns
    assert sorted(tuple(r) for r in newest.collect()) == [
        ("1", "success", "t3"),
        ("2", "failed", "t1"),
    ]


def test_one_folder_may_hold_most_files(spark):
    files = spark.range(2000).select(
        F.col("id").cast("string").alias("file_id"),
        F.when(F.col("id") % 3 == 0, "small").otherwise("hot").alias("user_folder_id"),
    )
    folders = spark.createDataFrame([("hot",), ("empty",)], "user_folder_id string")
    found = files_of_folders(files, folders)
    assert found.count() == files.where("user_folder_id = 'hot'").count()


TURNS = [
    ("m", 3, "Cy", "I will prepare it. Fine."),
    ("m", 1, "Ann", "Hello. Who will send the notes?"),
    ("m", 2, "Ann", "Is it unclear? Bo, follow up please."),
    ("n", 10, "Di", "Nothing."),
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(TURNS, "file_id string, turn long, speaker string, text string")


@pytest.mark.parametrize("size", [1, 2, 1000])
def test_assemble(turns, size):
    got = {r.file_id: r.text for r in assemble_transcript(turns, size).collect()}
    assert got == {
        "m": "Ann: Hello. Who will send the notes?\nAnn: Is it unclear? Bo, follow up please.\n"
        "Cy: I will prepare it. Fine.",
        "n": "Di: Nothing.",
    }
    assert assemble_parts(turns, 1).count() == 4


def test_cues_and_owners(turns):
    tasks = owner_from_speaker(turns).collect()
    assert sorted((r.turn, r.pos, r.owner, r.task) for r in tasks) == [
        (1, 2, "Ann", "Who will send the notes?"),
        (2, 2, "Ann", "Bo, follow up please."),
        (3, 1, "Cy", "I will prepare it."),
    ]
    cut = transcript_segments(turns.where("turn = 2"))
    kinds = cue_extract(cut).collect()
    assert sorted((r.pos, r.kind) for r in kinds) == [
        (1, "open_question"),
        (1, "unclear"),
        (2, "action_item"),
    ]


def test_segments_and_mentions(spark):
    df = spark.createDataFrame(
        [("1", "One. Two!? Three\n\n four...\nAda, five"), ("2", ""), ("3", " \n .")],
        "file_id string, text string",
    )
    cut = transcript_segments(df).collect()
    assert [(r.file_id, r.pos, r.segment) for r in cut] == [
        ("1", 1, "One."),
        ("1", 2, "Two!?"),
        ("1", 3, "Three"),
        ("1", 4, "four..."),
        ("1", 5, "Ada, five"),
        ("3", 1, "."),
    ]
    paragraphs = transcript_segments(df, "paragraph").where("file_id = '1'").collect()
    assert [r.pos for r in paragraphs] == [1, 2, 3]
    found = {r.file_id: (r.mentioned, r.positions) for r in assistant_mentions(df, "ada").collect()}
    assert found["1"] == (True, [5]) and found["2"] == (False, [])


def model():
    """A stand-in that is shipped with the task."""

    def reply(text):
        if "refuse" in text:
            return "no"
        return '{"title":"' + str(len(text)) + '","date":"2024-03-01"}'

    return reply


def transcripts(spark, rows):
    return spark.createDataFrame(
        rows, "file_id string, file_name string, user_folder_id string, text string"
    )


def test_batch_runs_again_only_where_it_failed(spark, tmp_path):
    rows = [("1", "a", "u1", "fine"), ("2", "b", "u1", ""), ("3", "c", "u2", "refuse")]
    out = str(tmp_path / "out")
    first = summarise_batch(
        spark, transcripts(spark, rows), None, model(), out, "b1", F.lit("t1"), backoff=0
    )
    assert sorted(tuple(r) for r in first.collect()) == [("u1", "b1", 1, 1), ("u2", "b1", 0, 1)]

    rows += [("4", "d", "u2", "new")]
    ledger = read_ledger(spark, f"{out}/ledger")
    second = summarise_batch(
        spark, transcripts(spark, rows), ledger, model(), out, "b2", F.lit("t2"), backoff=0
    )
    assert sorted(tuple(r) for r in second.collect()) == [("u1", "b2", 0, 1), ("u2", "b2", 1, 1)]
    summaries = spark.read.parquet(f"{out}/summaries").collect()
    assert sorted((r.file_id, r.user_folder_id) for r in summaries) == [("1", "u1"), ("4", "u2")]
    assert read_ledger(spark, f"{out}/ledger").count() == 6
    # The same batch cannot be written over itself.
    with pytest.raises(FileExistsError):
        summarise_batch(
            spark, transcripts(spark, rows), ledger, model(), out, "b2", F.lit("t2"), backoff=0
        )


def test_a_failed_batch_goes_on_with_its_slice(spark, tmp_path):
    rows = [(str(i), f"n{i}", "u", f"text {i}") for i in range(40)]
    log, out = tmp_path / "calls", str(tmp_path / "out")
    log.mkdir()

    def counting(broken):
        def reply(text):
            if broken and "text 7" in text:
                raise SystemExit("the worker is gone")
            (log / f"{broken}-{hash(text)}-{len(list(log.iterdir()))}").touch()
            return '{"title":"t","date":"2024-03-01"}'

        return reply

    def run(broken):
        return summarise_batch(
            spark, transcripts(spark, rows), None, counting(broken), out, "b1", F.lit("t"), slices=8, partitions=2
        )

    with pytest.raises(Exception):
        run(True)
    stored = [p.name for p in (tmp_path / "out" / "replies" / "archive_batch_id=b1").glob("slice=*/_SUCCESS")]
    before = spark.read.parquet(*[str(p.parent) for p in (tmp_path / "out").glob("replies/*/slice=*/_SUCCESS")]).count() if stored else 0
    (counts,) = run(False).collect()
    assert (counts.succeeded, counts.failed) == (40, 0)
    again = sum(p.name.startswith("False") for p in log.iterdir())
    assert again == 40 - before  # nothing that was stored is asked for again


def test_list_skip_read(spark, tmp_path):
    inventory = spark.createDataFrame(
        [(str(i), f"n{i}", DOCUMENT_MIME if i else "image/png", i == 1, "u1", None, None) for i in range(6)], INVENTORY
    )
    folders = spark.createDataFrame([("u1",)], "user_folder_id string")
    ledger = spark.createDataFrame([("2", "success"), ("3", "failed")], "original_file_id string, status string")
    bodies = spark.createDataFrame([(str(i), f"text {i}") for i in range(5)], "file_id string, text string")
    bodies.write.parquet(str(tmp_path / "bodies"))
    todo = to_summarise(inventory, folders, ledger, spark.read.parquet(str(tmp_path / "bodies")))
    assert {r.file_id: r.text for r in todo.collect()} == {"3": "text 3", "4": "text 4", "5": None}
    plan = todo._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():  # listing and ledger meet without any text
        if "LeftAnti" in line or "LeftSemi" in line:
            assert "text" not in line


def test_stages_of_an_outcome(spark):
    rows = [(str(i), f"n{i}", a, '{"title":"t"}' if a else None, u, r) for i, (a, u, r) in enumerate([(0, None, None), (1, "full", "x"), (1, None, "gone"), (1, None, None)])]
    df = spark.createDataFrame(rows, "file_id string, file_name string, attempts int, reply string, upload_error string, archive_error string")
    assert {r.file_id: r.error for r in outcomes(df).collect()} == {
        "0": "Transcript download failed: Transcript download failed",
        "1": "Summary upload failed: full",
        "2": "Could not archive n2 (2): gone",
        "3": "",
    }


def test_newest_row_of_summaries_with_variants(spark):
    df = spark.sql("select * from values ('a', 1, parse_json('1')), ('a', 2, parse_json('{\"x\":2}')) t(k, n, v)")
    (row,) = latest_summary(df, ["k"], ["n"]).collect()
    assert row.n == 2


def test_stream_of_files_equals_batch(spark, tmp_path):
    inbox, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for i in range(4):
        put(inbox / "u1", f"{i}.txt", f"text {i}")
    options = {"recursiveFileLookup": "true"}
    run_available(incremental_ingest(spark, str(inbox), **options), out, checkpoint)
    assert spark.read.parquet(out).count() == 4
    put(inbox / "u2", "late.txt", "text late")
    run_available(incremental_ingest(spark, str(inbox), **options), out, checkpoint)
    streamed = spark.read.parquet(out).select("path", "content")
    batch = spark.read.format("binaryFile").options(**options).load(str(inbox))
    batch = batch.select("path", "content")
    assert streamed.count() == 5
    assert streamed.exceptAll(batch).count() == batch.exceptAll(streamed).count() == 0


def test_archive(spark, tmp_path):
    inbox, archive = tmp_path / "in", tmp_path / "archive"
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = archive_on_commit(
            spark, str(inbox), str(archive), maxFilesPerTrigger="2"
        )
        run_available(stream, out, checkpoint)
        return spark.read.parquet(out).count(), len(list(archive.rglob("*.txt")))

    for i in range(6):
        put(inbox, f"{i}.txt", f"text {i}")
    seen, moved = run()
    # The last batch's files move in the next run.
    assert seen == 6 and moved < 6
    put(inbox, "6.txt", "text 6")
    seen, moved_later = run()
    assert seen == 7 and moved_later > moved
    assert moved_later + len(list(inbox.glob("*.txt"))) == 7


def test_ledger_stream_replays_without_change(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("1", "a", "u1", "fine"), ("2", "b", "u1", ""), ("3", "c", "u2", "refuse")]
    transcripts(spark, rows).write.parquet(inbox)
    schema = spark.read.parquet(inbox).schema
    reply = model()

    def enrich(batch):
        return enrich_with_retry(batch, reply, backoff=0, keep=("file_name", "user_folder_id"))

    def run(checkpoint):
        stream = incremental_ingest(spark, inbox, "parquet", schema)
        ledger_stream(stream, enrich, out, checkpoint, F.lit("t"))
        ledger = sorted(tuple(r) for r in spark.read.parquet(f"{out}/ledger").collect())
        return ledger, spark.read.parquet(f"{out}/summaries").count()

    def table(found):
        return [(r[0], r[5]) for r in found[0]]

    first = run(str(tmp_path / "cp"))
    assert [(r[0], r[5]) for r in first[0]] == [("1", "success"), ("2", "failed"), ("3", "failed")]
    assert first[1] == 1
    # With the checkpoint, only what is new becomes a batch.
    transcripts(spark, [("4", "d", "u2", "new")]).write.mode("append").parquet(inbox)
    later = run(str(tmp_path / "cp"))
    assert table(later) == [*table(first), ("4", "success")] and later[1] == 2
    # A batch that is tried again takes its own place.
    log = tmp_path / "cp" / "commits"
    for name in ("1", ".1.crc"):
        (log / name).unlink(missing_ok=True)
    assert table(run(str(tmp_path / "cp"))) == table(later)
    # A new checkpoint counts from 0 again, in a run of its own: with the earlier files archived,
    # their rows stay.
    shutil.rmtree(inbox)
    transcripts(spark, [("5", "e", "u1", "more")]).write.parquet(inbox)
    after = run(str(tmp_path / "cp2"))
    assert table(after) == [*table(later), ("5", "success")] and after[1] == 3


def test_text_per_file(spark, tmp_path):
    df = transcripts(spark, [("1", "a", "u", "x y"), ("2", "b", "u", "z")])
    path = str(tmp_path / "text")
    write_transcript_text(df, path, per_file=True)
    stored = spark.read.text(path)
    assert sorted((str(r.file_id), r.value) for r in stored.collect()) == [("1", "x y"), ("2", "z")]


def test_work_folder_follows_the_cluster(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    first, second = work_dir(spark, "a"), work_dir(spark, "a")
    assert first != second
    if before:
        assert first.startswith(before)


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(Session, "a")


def test_error_windows_close_with_the_time_of_all_lines(spark, tmp_path):
    inbox, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    layout = "ts timestamp_ntz, level string"

    def add(*rows):
        spark.createDataFrame([(datetime(2031, *at), level) for at, level in rows], layout).write.mode("append").parquet(inbox)

    def run():
        stream = incremental_ingest(spark, inbox, "parquet", spark.read.parquet(inbox).schema)
        run_available(log_error_windows(stream, "1 hour", "10 minutes"), out, checkpoint)
        return [(r.window_start, r.errors) for r in spark.read.parquet(out).orderBy("window_start").collect()]

    add(((3, 1, 9, 5), "ERROR"), ((3, 1, 9, 20), "ERROR"), ((3, 1, 9, 30), "INFO"))
    assert run() == []
    add(((3, 20, 12, 0), "INFO"))  # no error for days, but the log goes on
    assert run() == [(datetime(2031, 3, 1, 9), 2)]


def test_citations(spark):
    items = [("f", 1, "Para 2"), ("f", 2, "Para 3"), ("f", 3, 'he said "Blue Sky"'), ("f", 4, 'Para 1, "red"'), ("f", 5, "context"), ("f", 6, None), ("g", 7, "Para 1")]
    df = spark.createDataFrame(items, "file_id string, pos int, citation string")
    texts = spark.createDataFrame([("f", "One blue sky.\n\nTwo.")], "file_id string, text string")
    got = {r.pos: (r.paragraph, r.cited, r.grounded) for r in citation_check(df, texts).collect()}
    assert got == {
        1: (2, True, True), 2: (3, True, False), 3: (None, True, True), 4: (1, True, False),
        5: (None, False, False), 6: (None, False, False), 7: (1, True, False),
    }


def test_landed_replies_are_those_of_the_files(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    for lot, names in enumerate((["a+b.json", "ü c.json"], ["d.json"])):
        for name in names:
            put(inbox / "u 1", name, '{"response": ```json\n{"title": "%s"}\n```}' % name)
        landed = land_summaries(spark, str(inbox), out, str(tmp_path / "cp"))
        files = read_summaries(spark, str(inbox))
        assert landed.columns == files.columns and landed.count() == (2, 3)[lot]
        title = F.try_variant_get("v", "$.title", "string").alias("title")
        rows = [sorted(map(tuple, df.select("file_id", "raw", title).collect())) for df in (landed, files)]
        assert rows[0] == rows[1] and rows[0][0][2] == "a+b.json"


def test_every_citation_of_an_item_must_hold(spark):
    said = ["Para 2 and Para 99", "Para 1, para. 3", '"alpha" and "zzz"', '"Alpha", "one" (paragraph 2)', '"one" "', "Para 0", '"" Para 1', "Para 9999999999"]
    df = spark.createDataFrame([("f", i, c) for i, c in enumerate(said)], "file_id string, pos int, citation string")
    texts = spark.createDataFrame([("f", "One alpha.\n\nTwo.\nThree.")], "file_id string, text string")
    got = {r.pos: (r.paragraph, r.cited, r.grounded) for r in citation_check(df, texts).collect()}
    assert got == {
        0: (2, True, False), 1: (1, True, True), 2: (None, True, False), 3: (2, True, True),
        4: (None, True, True), 5: (0, True, False), 6: (1, True, True), 7: (None, False, False),
    }


def test_landing(spark, tmp_path):
    put(tmp_path / "in" / "u 1", "a b.txt", "one\ntwo")
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "cp")
    assert land_transcripts(spark, str(tmp_path / "in"), table, checkpoint).count() == 1
    put(tmp_path / "in" / "u2", "c.txt", "three")
    landed = land_transcripts(spark, str(tmp_path / "in"), table, checkpoint)
    assert {(r.user_folder_id, r.file_name, r.text) for r in landed.collect()} == {
        ("u 1", "a b.txt", "one\ntwo"), ("u2", "c.txt", "three"),
    }
    # Stored summaries carry the path in the same form.
    ids = {r.file_id.split("/in/")[1] for r in read_summaries(spark, str(tmp_path / "in")).collect()}
    assert ids == {r.file_id.split("/in/")[1] for r in landed.collect()}
