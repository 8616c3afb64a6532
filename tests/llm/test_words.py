import numpy as np
import pyarrow as pa
from conftest import words_of
from hypothesis import given, settings
from hypothesis import strategies as st

from opsloom.llm.shared import slices
from opsloom.llm.words import shingles, weighted, words

TEXTS = st.lists(st.text(alphabet="aB9 .é中-\n", max_size=40), min_size=1, max_size=8)


@settings(deadline=None, max_examples=60)
@given(TEXTS)
def test_words_of_a_batch_are_those_of_each_text(texts):
    seen = {}
    for first, last, raw, bounds in slices(pa.array(texts), 32):
        hashes, starts, ends, per_text = words(raw, bounds)
        for i in range(last - first):
            own = range(per_text[i], per_text[i + 1])
            found = [bytes(raw[starts[j] : ends[j]]).decode() for j in own]
            expected = words_of(texts[first + i])
            assert [w.lower() if w.isascii() else w.translate(str.maketrans("B", "b")) for w in found] == expected
            for j, word in zip(own, expected, strict=True):
                assert seen.setdefault(word, hashes[j]) == hashes[j]
    assert len(set(seen.values())) == len(seen)


def test_shingles_and_counts():
    texts = ["a b c d e f a b c d e f", "a b", "", "a b c d e"]
    (_, _, raw, bounds), = slices(pa.array(texts))
    hashes, _, _, per_text = words(raw, bounds)
    items, ends = shingles(hashes, per_text)
    assert np.diff(ends).tolist() == [8, 1, 0, 1]
    distinct, counts, ends = weighted(items, ends)
    assert np.diff(ends).tolist() == [6, 1, 0, 1]
    assert sorted(counts[: ends[1]].tolist()) == [1, 1, 1, 1, 2, 2]
    assert distinct[ends[3]] in distinct[: ends[1]]


def test_a_null_text_is_empty():
    (_, _, raw, bounds), = slices(pa.array(["ab", None, "c"]))
    assert np.diff(words(raw, bounds)[3]).tolist() == [1, 0, 1]
