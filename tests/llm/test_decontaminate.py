from __future__ import annotations

import random
import re

import pytest

from marisma.llm.decontaminate import WindowConfig, find_windows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    spans = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1) if n else ():
            spans.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for i in range(len(w)):
            for n in range(1, size + 1):
                if tuple(w[i : i + n]) in spans and i + n <= len(w):
                    hit |= set(range(i, i + n))
                    names |= {str(x) for x in spans[tuple(w[i : i + n])] if x is not None}
        out.append((doc, len(w), len(hit), tuple(sorted(names)), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, cfg=None):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = find_windows(d, b, cfg).select("doc_id", "n_words", "n_hit", "item_ids", "contaminated").collect()
    return sorted([(r[0], r[1], r[2], tuple(r[3]), r[4]) for r in rows], key=str)


def cases(seed):
    rng = random.Random(seed)
    pool = ["a", "b", "c", "dé", "E7", "of", "the"]
    text = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choice(pool) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 5, 9, 10, 11, 14]))) for i in range(6)]
    docs = [(i, text(rng.randrange(0, 30))) for i in range(15)]
    docs += [(100 + i, f"{text(4)} {rng.choice(items)[1].upper()} {text(3)}") for i in range(10)]
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    docs, items = cases(seed)
    assert run(spark, docs, items) == brute(docs, items)


def test_a_full_bitmap_changes_nothing(spark):
    docs, items = cases(9)
    assert run(spark, docs, items, WindowConfig(bitmap_bits=2)) == brute(docs, items)


def test_a_very_common_item_word_leaves_in_batches(spark):
    docs = [(i, "the cat " * 3000) for i in range(4)] + [(9, "a dog the end"), (10, None)]
    items = [(1, "the"), (2, "cat the cat"), (3, "absent words")]
    assert run(spark, docs, items) == brute(docs, items)


def test_odd_rows(spark):
    docs = [(None, None), (None, "one two"), (None, "one two"), (3, ""), (3, "!!"), (4, "x " * 70_000 + "one two"), (4, "one two")]
    items = [(1, "One, two!"), (1, None), (2, ""), (None, "x x"), (10, "one two")]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, (), False)]
