"""The registered queries: against their SQL, or over a small table against what tests/llm checks."""

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from check import compare, connect
from colloquy.llm import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1": ["doc_id", "held_out", "lang_pred", "score"],
    "op2": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op4": ["doc_id", "n_shingles", "component_id", "kept"],
    "op5": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op6": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7": ["doc_id", "held_out", "score", "predicted"],
    "op8": ["doc_id", "size", "source_size", "target", "taken"],
    "op10": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op11": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12": ["doc_id", "fingerprint", "component_id"],
    "op13": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_registered():
    names = contract.queries()
    assert set(QUERIES) < set(names) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    need = COLUMNS.get(name.split("_")[0], [])
    assert df.columns[: len(need)] == need
    if name in ORACLE:
        assert compare(df, duck.execute(ORACLE[name])) is None
    elif "doc_id" in df.columns:
        ids = [r.doc_id for r in df.select("doc_id").collect()]
        assert sorted(ids) == sorted(x for (x,) in duck.execute("select doc_id from documents").fetchall())
    else:
        assert df.count() > 0


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_dedup", "decontamination", "mixing", "packing",
    ]
