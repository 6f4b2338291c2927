import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import packing as p


@pytest.fixture(scope="module")
def encoder():
    with open(p.VOCABULARY, "rb") as file:
        return p.Encoder(file.read())


@settings(deadline=None, max_examples=300)
@given(st.text(alphabet="ab é1,'\n\t 　😀st", max_size=40))
def test_pieces_give_the_ids_of_the_whole_text(encoder, text):
    ids = encoder.encode(text).tolist()
    assert ids == [*encoder.encoding.encode_ordinary(text), encoder.end]
    assert encoder.encoding.decode(ids[:-1]) == text


def slow_best_fit(sizes, length):
    rows, rooms = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [r for r in range(len(rows)) if rooms[r] >= sizes[i]]
        if fits:
            r = min(fits, key=lambda r: rooms[r])
            rows[r].append(i)
            rooms[r] -= sizes[i]
        else:
            rows.append([i])
            rooms.append(length - sizes[i])
    return rooms


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 33), max_size=60))
def test_best_fit_decreasing(sizes):
    rows = p.best_fit_decreasing(sizes, 33)
    assert sorted(i for row in rows for i in row) == list(range(len(sizes)))
    rooms = [33 - sum(sizes[i] for i in row) for row in rows]
    assert sorted(rooms) == sorted(slow_best_fit(sizes, 33)) and all(r >= 0 for r in rooms)


def unpacked(rows, encoder, length):
    pieces = {}
    for r in rows:
        ids = np.frombuffer(bytes(r.input_ids), encoder.dtype)
        places = np.frombuffer(bytes(r.position_ids), "<u4")
        assert len(ids) == len(places) == length and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        assert len(r.doc_ids) == len(r.offsets) == len(r.cu_seqlens) - 1
        assert (ids[r.n_tokens :] == encoder.end).all()
        for k, (a, b) in enumerate(zip(r.cu_seqlens, r.cu_seqlens[1:])):
            assert places[a:b].tolist() == list(range(b - a))
            pieces.setdefault(r.doc_ids[k], []).append((r.offsets[k], ids[a:b].tolist()))
    return pieces


def test_round_trip(spark, docs, prose, encoder):
    texts = {1: prose(10), 2: prose(3000, 2), 3: "", 4: None, 5: "  spaces\n\n and é 😀 ", 6: prose(60_000, 6), 9: "w " * 64}
    table = docs([*texts.items()], extra=("q",)).withColumnRenamed("_0", "row_id")
    out = p.pack(spark, table.repartition(3), length=64, window=3000).collect()
    assert len({r.row_id for r in out}) == len(out)
    pieces = unpacked(out, encoder, 64)
    for i, text in texts.items():
        own = sorted(pieces[i])
        ids = [x for at, part in own for x in part]
        assert [at for at, _ in own] == list(range(0, len(ids), 64))
        assert ids[-1] == encoder.end and encoder.encoding.decode(ids[:-1]) == (text or "")


def test_repeated_rows_null_ids_and_empty_table(spark, docs, encoder):
    out = p.pack(spark, docs([(1, "a b"), (1, "a b"), (None, "c")]).coalesce(1), length=16).collect()
    pieces = unpacked(out, encoder, 16)
    assert len(out) == 1 and len(pieces[1]) == 2 and len(pieces[None]) == 1
    assert p.pack(spark, docs([])).count() == 0


def test_rows_are_nearly_full(spark, docs, prose):
    out = p.pack(spark, docs([(i, prose(20 + i % 300, i)) for i in range(800)]).coalesce(1), length=512).collect()
    assert sum(r.n_tokens for r in out) / (512 * len(out)) > 0.97
