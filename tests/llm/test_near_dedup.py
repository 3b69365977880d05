from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from marisma.llm import near_dedup as N


def brute(docs, k, percent=80):
    sets = [(i, N.word_shingles(t, k)) for i, t in docs]
    parent = {i: i for i, _ in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            a, b = sorted((top(a), top(b)))
            parent[b] = a
    return sorted((i, len(s), top(i), top(i) == i) for i, s in sets)


def run(spark, docs, cfg):
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, leader string")
    return sorted(tuple(r) for r in N.near_duplicates(d, cfg).select("doc_id", "n_shingles", "component_id", "kept").collect())


def corpus(seed, families=6, copies=9):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(families):
        base = [rng.choice(pool) for _ in range(rng.choice([1, 4, 12, 60, 150]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 9)):
                text[rng.randrange(len(text))] = rng.choice(pool)
            docs.append(" ".join(text) if rng.random() < 0.8 else "\n".join(text).upper())
    docs += ["", None, "  \n", "solo", "SOLO "]
    rng.shuffle(docs)
    return list(enumerate(docs, 5))


@pytest.mark.parametrize("seed,k", [(0, 2), (1, 5), (2, 2)])
def test_equals_brute_force(spark, seed, k):
    docs = corpus(seed)
    assert run(spark, docs, N.NearConfig(shingle=k)) == brute(docs, k)


def test_small_tiles_lose_no_link(spark):
    docs = corpus(4, families=2, copies=40)
    assert run(spark, docs, N.NearConfig(shingle=2, tile_docs=7)) == brute(docs, 2)


def star(spark, far):
    """250 near copies of a leader, and `far` texts that are near those only."""
    words = [f"s{i}" for i in range(100)]
    docs = [(i, " ".join([*words[:90], *(f"u{i}_{j}" for j in range(5))])) for i in range(1, 251)]
    docs += [(1000 + i, " ".join([*words[:77], *(f"v{i}_{j}" for j in range(8))])) for i in range(far)]
    return [(0, " ".join(words)), *docs]


def test_linked_members_ship_once(spark):
    """Members linked to the leader ship once, and once per block of loose ones where there are any."""
    cfg = N.NearConfig(shingle=1, tile_docs=25)
    frame = lambda rows: spark.createDataFrame([(0, i, 95) for i, _ in rows], "leader long, doc_id long, n_shingles long")
    for far in (0, 3, 60):
        rows = star(spark, far)
        home = N.home_tiles(frame(rows), cfg)
        assert home.filter("block >= 0").count() == len(rows) - 1
        links = spark.createDataFrame([(0, i) for i, _ in rows if 0 < i < 1000], "low long, high long")
        per = N.loose_tiles(home, links, cfg).groupBy("doc_id").count().collect()
        blocks = -(-far // 25)
        assert {r["count"] for r in per if r.doc_id < 1000} == ({blocks} if far else set())
        assert {r["count"] for r in per if r.doc_id >= 1000} == ({blocks + 10} if far else set())


@pytest.mark.parametrize("far", [0, 3, 60])
def test_loose_members_meet_linked_ones(spark, far):
    docs = star(spark, far)
    assert run(spark, docs, N.NearConfig(shingle=1, tile_docs=25)) == brute(docs, 1)


def test_chain_of_links_is_one_component(spark):
    words = [f"c{i}" for i in range(400)]
    docs = [(i, " ".join(words[i * 12 : i * 12 + 140])) for i in range(20)]
    assert {r[2] for r in run(spark, docs, N.NearConfig(shingle=1))} == {0} == {r[2] for r in brute(docs, 1)}


def test_odd_rows(spark):
    docs = [(None, "a b c"), (None, None), (7, "a b c"), (7, "a b c"), (8, "A  b c"), (9, "x " * 50_000), (3, "x x x")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r) for r in N.near_duplicates(d, N.NearConfig(shingle=2)).collect()), key=str)
    assert got == sorted([
        (None, 2, None, True), (None, 0, None, True), (7, 2, 7, True), (7, 2, 7, True), (8, 2, 7, False), (9, 1, 3, False), (3, 1, 3, True),
    ], key=str)


def test_empty_table(spark):
    assert run(spark, [], N.NearConfig()) == []


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 905)], "low long, high long")
    got = {r.doc_id: r.component_id for r in N.components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 905: 900}


def test_posterior_bound_keeps_similar_pairs():
    cfg = N.NearConfig(shingle=1)
    rng = np.random.default_rng(3)
    lost = 0
    for _ in range(300):
        shared = rng.integers(0, 2**63, 80, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2**63, 10, dtype=np.uint64)])) for _ in "ab")
        add, times = N._permutations(cfg)
        same = N.minima_of(a, add, times) == N.minima_of(b, add, times)
        lost += any(same[:n].sum() < need for n, need in cfg.need)
    assert lost == 0
    assert [n for n, _ in cfg.need] == [32, 64, 96, 128] and N.matches_needed(16, 0.8, 1e-5) < 13


def test_sets_of_short_texts():
    got = [len(s) for s in N.shingle_sets(pa.array(["a b", "a", "", None, "a b a b", "a b c"]), 3)]
    assert got == [1, 1, 0, 0, 2, 1]
