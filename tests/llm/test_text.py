import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import text
from loomgraph.llm.text import buffers, one_hash, slices, words_of

words = st.text(st.sampled_from("aB é\n\t\x0b\x1c\x85字"), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), words), max_size=8))
def test_words_are_those_of_a_split(texts):
    data, bounds = buffers(pa.array(texts, pa.string()))
    w = words_of(data, bounds)
    for i, t in enumerate(texts):
        want = (t or "").encode().split()
        got = [bytes(data[w.start[k] : w.end[k]]) for k in range(w.first[i], w.first[i + 1])]
        assert got == want
        assert [int(h) for h in w.hash[w.first[i] : w.first[i + 1]]] == [one_hash(x.lower()) for x in want]


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(text, "SEGMENT", 64)
    texts = ["word%d " % i * 40 for i in range(5)] + ["x" * 500, "a " + "y" * 300 + " b"]
    data, bounds = buffers(pa.array(texts))
    w = words_of(data, bounds)
    assert [int(n) for n in np.diff(w.first)] == [len(t.split()) for t in texts]


def test_slices_keep_rows_and_order():
    batch = pa.record_batch([pa.array(range(50)), pa.array([None if i % 7 == 0 else "t" * i for i in range(50)])], names=["i", "text"])
    parts = list(slices(iter([batch, batch.slice(3, 5)]), size=40))
    assert [x for p, _, _ in parts for x in p.column(0).to_pylist()] == [*range(50), 3, 4, 5, 6, 7]
    assert all(len(b) == p.num_rows + 1 and b[0] == 0 for p, _, b in parts)
