from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from marisma.llm.words import ALNUM, SOLID, shingles, slices, split_words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aBé ß\n\t.,7中\x00", max_size=60)), max_size=8)


def found(texts, inside, limit):
    out = [None] * len(texts)
    for first, last, data, bounds in slices(pa.array(texts, pa.string()), limit):
        w = split_words(data, bounds, inside)
        for i in range(last - first):
            out[first + i] = [w.word(j).decode() for j in range(w.first[i], w.first[i + 1])]
    return out


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([1, 7, 1000]))
def test_words_equal_the_patterns(texts, limit):
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    assert found(texts, ALNUM, limit) == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) for t in lower]
    assert found(texts, SOLID, limit) == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in lower]


def test_hashes_follow_the_words_only():
    words = ["a", "b", "ab", "a" * 7, "a" * 8, "a" * 9, "a" * 16, "a" * 17, "é" * 900]
    texts = [" ".join(words), "x " + "  ".join(reversed(words)), *words]
    seen: dict[str, set[int]] = {}
    for first, last, data, bounds in slices(pa.array(texts)):
        w = split_words(data, bounds, SOLID)
        for j in range(len(w.begin)):
            seen.setdefault(w.word(j).decode(), set()).add(int(w.hash[j]))
    assert all(len(v) == 1 for v in seen.values())
    assert len({next(iter(v)) for v in seen.values()}) == len(words) + 1


def test_shingles_depend_on_order():
    h = np.array([1, 2, 3, 1, 2], np.uint64)
    two = shingles(h, 2)
    assert two[0] == two[3] and two[0] != shingles(h[::-1], 2)[0] and len(shingles(h, 5)) == 1


def test_a_sliced_column_keeps_its_rows():
    column = pa.array(["no", "a b", None, "c"]).slice(1)
    assert [w for w in found(column.to_pylist(), SOLID, 100)] == [["a", "b"], [], ["c"]]
    rows = [(a, b) for a, b, _, _ in slices(column, 1)]
    assert rows[0][0] == 0 and rows[-1][1] == 3
