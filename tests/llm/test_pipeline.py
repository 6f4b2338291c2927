"""The pipeline against a plain Python version of it."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from colloquy.llm import packing

from .test_decontaminate import brute as contaminated
from .test_near_dedup import brute as components
from .test_packing import unpacked
from .test_quality_rules import brute as counts

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_stages_one_after_the_other(spark, tmp_path):
    docs = table(spark, "documents")
    columns, seen = docs.columns, [docs]
    for name, stage in cp.STAGES:
        path = f"file://{tmp_path}/{name}"
        stage(spark, seen[-1], SF).write.parquet(path)
        seen.append(spark.read.parquet(path))
    start, clean, unique, decontaminated, mixed, packed = seen
    assert all(df.columns == columns for df in seen[:-1])

    texts = {r.doc_id: r.text for r in start.collect()}
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    for i, text in texts.items():  # with so few labels no cutoff is safe: the base rules alone decide
        c = counts(text)
        assert (i in kept) == (c["n_words"] >= 20 and 100 * c["n_repeat_words"] <= 30 * c["n_words"])

    comps = components([(i, texts[i]) for i in kept])
    ones = {r.doc_id for r in unique.select("doc_id").collect()}
    assert unique.count() == len(ones) and ones == {i for i, c in comps.items() if i == c}

    items = [(str(r.item_id), r.text) for r in table(spark, "benchmark").collect()]
    left = {r.doc_id: r for r in decontaminated.collect()}
    for i in ones:
        n, hit, _ = contaminated(texts[i], items, 10)
        if not hit:
            assert left[i].text == texts[i]
        else:
            assert (i in left) == (len(hit) <= 0.5 * n)
    for r in left.values():
        assert not contaminated(r.text, items, 10)[1] and r.n_chars == len(r.text)

    drawn = {}
    for r in mixed.collect():
        assert (r.text, r.source) == (left[r.doc_id].text, left[r.doc_id].source)
        drawn[r.doc_id] = drawn.get(r.doc_id, 0) + 1
    assert max(drawn.values()) <= 3
    size = lambda i: len(left[i].text.split())
    total = sum(size(i) for i in left)
    assert sum(size(i) * n for i, n in drawn.items()) == pytest.approx(total, rel=0.03)

    with open(packing.VOCABULARY, "rb") as file:
        encoder = packing.Encoder(file.read())
    pieces = unpacked(packed.collect(), encoder, packing.LENGTH)
    assert set(pieces) == set(drawn)
    for i, n in drawn.items():
        own = sorted(pieces[i])
        whole = [ids for at in sorted({at for at, _ in own}) for ids in [next(p for a, p in own if a == at)]]
        assert len(own) == n * len(whole)
        assert encoder.encoding.decode([x for part in whole for x in part][:-1]) == left[i].text


def test_run_gives_the_last_stage(spark):
    out = cp.run(spark, SF)
    assert [f.name for f in out.schema] == [c.split()[0] for c in packing.SCHEMA.split(", ")]
    assert out.count() > 0


def test_empty_and_null_documents(spark):
    docs = table(spark, "documents")
    odd = docs.limit(0).union(
        spark.createDataFrame(
            [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, None), (3, "w " * 30, "en", "a", 60)], docs.schema
        )
    )
    for df in (docs.limit(0), odd):
        for name, stage in cp.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == docs.columns
        cp.STAGES[-1][1](spark, df, SF).collect()
    assert cp.STAGES[1][1](spark, odd, SF).count() == 4 and odd.where(F.col("text").isNull()).count() == 2
