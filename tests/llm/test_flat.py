import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm.flat import Texts, Words, chunks

TEXT = st.one_of(st.none(), st.text(alphabet="ab \n\t\x0b\x85é Z", max_size=30))


@settings(deadline=None, max_examples=150)
@given(st.lists(TEXT, max_size=8), st.integers(1, 40))
def test_words_are_those_of_each_text(rows, limit):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(rows, pa.string())})
    seen = []
    for chunk in chunks(batch, "text", limit):
        texts = Texts(chunk.column(0))
        words = Words(texts)
        hashes = words.hashes(texts.data)
        for i in range(texts.n):
            span = range(words.at[i], words.at[i + 1])
            seen.append([(texts.data[words.first[k] : words.last[k]].tobytes(), int(hashes[k])) for k in span])
    assert [[w for w, _ in own] for own in seen] == [(t or "").encode().split() for t in rows]
    by_word = {}
    for word, number in (pair for own in seen for pair in own):
        assert by_word.setdefault(word, number) == number
    assert len(set(by_word.values())) == len(by_word)


def test_hashes_do_not_depend_on_blocks():
    long = "x" * (3 << 20)
    texts = Texts(pa.array(["ab cd", f"ab {long} cd", long]))
    words = Words(texts)
    h = words.hashes(texts.data)
    assert h[0] == h[2] and h[1] == h[4] and h[3] == h[5] and len(set(h.tolist())) == 3


def test_windows_stay_within_a_text():
    texts = Texts(pa.array(["a b c", "d", "a b c d"]))
    words = Words(texts)
    found, start = words.windows(words.hashes(texts.data), 3, 1)
    assert start.tolist() == [0, 4, 5]
    assert found[0] == found[1] != found[2]
    assert len(np.unique(found)) == 2
