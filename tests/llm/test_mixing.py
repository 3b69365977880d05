from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from marisma.llm import mixing

SCHEMA = "doc_id long, source string, text string, size string, target int, copies int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1) for r in rows], SCHEMA).repartition(3)


def brute_targets(words, weights, cap=3):
    names = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = sum(words.values()), set()
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(cap * words[s] for s in held)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * words[s]}
        if not over:
            return {s: cap * words[s] if s in held else share[s] for s in names}
        held |= over


def brute_rate(sizes, target, cap=3):
    """lambda by halving."""
    total = lambda x: sum(s * min(cap, math.exp(min(x * s, 5))) for s in sizes)
    low, high = -10.0, 10.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < target else (low, mid)
    return low


def corpus():
    rng = random.Random(5)
    rows, i = [], 0
    for source, n, top in (("a", 400, 300), ("b", 60, 80), (None, 90, 40), ("", 70, 500), ("é", 3, 20), ("hot", 900, 30), ("none", 4, 0)):
        for _ in range(n):
            rows.append((i, source, " \n".join(["w"] * rng.randrange(top + 1))))
            i += 1
    rows += [(i + k, "hot", "the same text again") for k in range(700)]
    return rows + [(None, "a", None), (None, None, "x y"), (None, None, "x y"), (1, "b", "twice here")]


def test_against_brute_force(spark):
    rows = corpus()
    got = mixing.mix(frame(spark, rows), [1, 2, 3]).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes.setdefault(s, []).append(len((t or "").split()))
    want = brute_targets({s: sum(v) for s, v in sizes.items()}, [1, 2, 3])
    for s, v in sizes.items():
        mine = [r for r in got if r.source == s]
        assert sorted(r.size for r in mine) == sorted(v)
        assert all(r.source_size == sum(v) and math.isclose(r.target, want[s], rel_tol=1e-12, abs_tol=1e-9) for r in mine)
        assert all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in mine)
        # a source ends as near as its smaller documents allow
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(2.0, 0.01 * want[s])
        if 0 < want[s] < 2.999 * sum(v):
            x = brute_rate(v, want[s])
            assert all(math.isclose(r.rate, min(3, math.exp(min(x * r.size, 5))), rel_tol=1e-6) for r in mine if r.size)
        # copies follow the rate: only few documents are moved further than to the next whole number
        assert sum(abs(r.copies - r.rate) >= 1 for r in mine if r.size) <= 0.1 * len(mine) + 2


def test_runs_agree_whatever_the_layout(spark):
    rows = corpus()
    one, two = (mixing.mix(frame(spark, rows).repartition(n), [1, 2, 3]).select("doc_id", "source", "size", "taken", "rate") for n in (2, 7))
    key = lambda r: tuple(map(str, r))
    assert sorted(one.collect(), key=key) == sorted(two.collect(), key=key)


def test_targets_stop_at_three_times(spark):
    rows = [(1, "a", "w " * 1000), (2, "b", "w w"), (3, "c", "w")]
    got = {r.source: r for r in mixing.mix(frame(spark, rows), [1, 2, 3]).collect()}
    assert (got["b"].target, got["c"].target, got["a"].target) == (6.0, 3.0, 994.0)
    assert (got["b"].taken, got["c"].taken) == (6, 3)


def test_empty_table_and_texts(spark):
    empty = frame(spark, [(1, "a", "x")]).filter(F.lit(False))
    assert mixing.mix(empty, [1, 2, 3]).collect() == []
    got = mixing.mix(frame(spark, [(1, "a", None), (2, None, " ")]), [1, 2, 3]).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0), (0, 0.0, 0)]
