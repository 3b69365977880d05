"""Stored search structures against scoring everything, sites, and lookups by many terms."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marisma.functions import fixed_values as fv
from marisma.functions.site_scan import Rule, scan_site
from marisma.operators import dedup, pages, search, text_index, vector_cells
from marisma.plans.functions import register_contains_lookup
from marisma.session import work_dir

# ---------------------------------------------------------------- keyword index


@pytest.fixture(scope="module")
def corpus(spark):
    """Few common words, many rare ones, a hot document size, empty and null texts."""
    rnd = random.Random(4)
    rare = [f"raro{i}" for i in range(300)]
    texts = []
    for _ in range(1500):
        n = rnd.choice([3, 8, 8, 8, 40])
        texts.append(" ".join(rnd.choice(["el", "la", "de"]) if rnd.random() < 0.7 else rnd.choice(rare) for _ in range(n)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000, ""), (5001, None), (5002, "... !!"), (5003, texts[0]), (5004, texts[0])]
    return spark.createDataFrame(rows, "id long, t string").repartition(5)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(
        [(0, "el raro1 raro2"), (1, "la de"), (2, "nada de nada"), (3, "desconocido"), (4, ""), (5, None), (6, "raro7"), (7, " ".join(f"raro{i}" for i in range(40)) + " el la de")],
        "qid int, qtext string",
    )


@pytest.fixture(scope="module")
def index(spark, corpus):
    return text_index.build_index(corpus, "id", F.col("t"), work_dir(spark, "index"), block=16)


@pytest.mark.parametrize("k", [1, 10, 5000])
def test_stored_search_equals_scoring_every_document(spark, corpus, asked, index, k):
    want = search.search_keyword(corpus, "id", F.col("t"), asked, k).collect()
    got = text_index.search_index(index, asked, k).collect()
    key = lambda r: (r.qid, r.rango, r.id)
    assert [key(r) for r in sorted(got, key=key)] == [key(r) for r in sorted(want, key=key)]
    assert {(r.qid, r.id): r.bm25 for r in got} == pytest.approx({(r.qid, r.id): r.bm25 for r in want}, abs=1e-8)


def test_lowest_scores(spark, corpus, asked, index):
    want = {r[0]: r[1] for r in search.keyword_scores(corpus, "id", F.col("t"), asked).groupBy("qid").agg(F.min("bm25")).collect()}
    got = {r.qid: r.bajo for r in text_index.lowest_scores(index, text_index._asked(index, asked, "qid", "qtext"), "qid").collect()}
    assert got == pytest.approx(want)


def test_common_words_are_not_read_where_rare_ones_decide(spark, corpus, index):
    one = spark.createDataFrame([(0, "el raro1")], "qid int, qtext string")
    terms = text_index._asked(index, one, "qid", "qtext")
    best = text_index.search_index(index, one, 3).filter("rango = 3").select("qid", F.col("bm25").alias("cota"))
    found = text_index.at_least(index, terms, best, "qid").count()
    holders = corpus.filter(F.array_contains(F.split("t", " "), "raro1")).count()
    every = search.keyword_scores(corpus, "id", F.col("t"), one).count()
    assert 3 <= found <= holders < every / 5


def test_index_of_an_empty_table(spark, corpus, asked):
    empty = text_index.build_index(corpus.filter("false"), "id", F.col("t"), work_dir(spark, "index"))
    assert empty.n == 0 and text_index.search_index(empty, asked, 5).collect() == []


@pytest.mark.parametrize("alpha", [0.0, 0.3, 0.9])
def test_stored_hybrid_equals_hybrid(spark, corpus, asked, index, alpha):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(1500) if i % 4], "id long, v array<double>").repartition(6)
    queries = asked.withColumn("qvec", F.array(*[F.sin(F.col("qid") * 7.0 + i) for i in range(6)]))
    want = search.search_hybrid(corpus, "id", F.col("t"), vectors, "v", queries, 12, alpha).collect()
    got = text_index.search_hybrid_stored(index, vectors, "v", queries, 12, alpha).collect()
    pick = lambda rows: [round(r.puntuacion, 7) for r in sorted(rows, key=lambda r: (r.qid, r.rango))]
    assert len(got) == len(want) == 8 * 12 and pick(got) == pytest.approx(pick(want), abs=2e-7)
    if alpha:
        assert {(r.qid, r.id) for r in got} == {(r.qid, r.id) for r in want}


# ---------------------------------------------------------------- vector cells


def near(vectors, asked, k):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return np.sort(unit(asked) @ unit(vectors).T, axis=1)[:, ::-1][:, :k]


@pytest.mark.parametrize("cells, k", [(1, 5), (12, 5), (40, 1), (12, 900)])
def test_cells_equal_a_scan(spark, monkeypatch, cells, k):
    monkeypatch.setattr(vector_cells, "ROWS_IN_TILE", 64)
    monkeypatch.setattr(vector_cells, "QUERIES_IN_TILE", 8)
    rng = np.random.default_rng(1)
    heart = rng.normal(size=(10, 8)) * 5
    vectors = heart[rng.choice(10, 800, p=[0.55] + [0.05] * 9)] + rng.normal(size=(800, 8)) * 0.3
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, [0.0] * 8), (901, None), (902, [float("nan")] * 8)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "id long, v array<double>, celda string").repartition(4)
    index = vector_cells.build_cells(table, "id", "v", work_dir(spark, "cells"), cells=cells, sample=200)
    picks = rng.choice(800, 40, replace=False)
    queries = spark.createDataFrame([(int(i), vectors[i].tolist()) for i in picks] + [(-1, [0.0] * 8), (-2, None)], "qid long, qvec array<double>")
    got = vector_cells.search_cells(index, queries, k).orderBy("qid", "rango").collect()
    want = near(vectors, vectors[sorted(picks)], k)
    assert [r.similitud for r in got] == pytest.approx(want.ravel().tolist())
    assert {r.qid for r in got} == set(map(int, picks)) and index.size.sum() == 800
    if cells == 12 and k == 5:  # most cells are ruled out
        ways = vector_cells._ways(index, queries, "qid", "qvec", k)
        reach = {r.qid: np.sqrt(2 - 2 * r.similitud) for r in got if r.rango == k}
        open_ = sum(r.cota <= reach[r.qid] for r in ways.collect())
        assert open_ < 0.5 * 40 * (index.size > 0).sum()


def test_cells_of_an_empty_table(spark):
    table = spark.createDataFrame([], "id long, v array<double>")
    index = vector_cells.build_cells(table, "id", "v", work_dir(spark, "cells"))
    assert vector_cells.search_cells(index, spark.createDataFrame([(1, [1.0])], "qid int, qvec array<double>"), 3).collect() == []


# ---------------------------------------------------------------- sites

RULES = [Rule(*r) for r in fv.SITE_SELECTORS]


def test_rules_of_sites():
    voc = '<title>Otro</title><h1 class="a voc-title"> El  <b>sol</b> </h1><p class="voc-author__name">Por <a>Ana</a></p><p class="voc-p">uno<p class="voc-p">dos<br>tres<script>x</script></p><p class=voc-p> </p>'
    got = scan_site(voc, "https://www.ABC.es/x", RULES)
    assert got == {"titulo": "El sol", "autor": "Ana", "fecha": None, "subtitulo": None, "cuerpo": ["uno", "dos tres"]}
    assert scan_site("<title>Solo</title>", "https://diariosur.es", RULES)["titulo"] == "Solo"
    assert scan_site("<title>Solo</title>", "https://otro.es", RULES)["titulo"] is None
    body = '<div class="bbnx-body"><p>corto</p><p>un texto que pasa de veinte letras</p></div>'
    assert scan_site(body, "http://www.diariodesevilla.es/a", RULES)["cuerpo"] == ["un texto que pasa de veinte letras"]
    long_, other = "x" * 50, "y" * 50
    assert scan_site(f"<p>{other}</p><main><p>{long_}</p></main>", "https://elpais.com/a", RULES)["cuerpo"] == [long_]
    assert scan_site(f"<p>{other}</p>", "https://elpais.com/a", RULES)["cuerpo"] == [other]
    assert scan_site(None, None, RULES)["titulo"] is None and scan_site("<p", "http://[", RULES)["cuerpo"] is None


def test_site_article_falls_back(spark):
    long_ = "Una frase bastante larga para que cuente como párrafo del cuerpo"
    ld = '<script type="application/ld+json">{"@type": "NewsArticle", "headline": "LD", "articleBody": "' + f"{long_} a\\n\\n{long_} b" + '"}</script>'
    rows = [(1, "https://abc.es/1", f'{ld}<h1 class="voc-title">Sitio</h1><p class="voc-p">uno</p>'), (2, "https://otro.es/2", ld),
            (3, "https://otro.es/3", f"<article><p>{long_} uno</p><p>{long_} dos</p></article>"), (4, None, None)]
    got = {r.id: (r.titulo, r.cuerpo) for r in pages.site_article(spark.createDataFrame(rows, "id int, url string, html string"), "id").collect()}
    assert got[1] == ("Sitio", ["uno"]) and got[2][0] == "LD" and got[2][1] == [f"{long_} a", f"{long_} b"]
    assert got[3][1] == [f"{long_} uno", f"{long_} dos"] and got[4] == (None, None)


# ---------------------------------------------------------------- lookups, keys


def test_lateral_lookup_is_an_equi_join(spark):
    names = [(i, f"C{i}", n) for i, n in enumerate(["Pernoctaciones", "Estancia media", "Grado de ocupación", "ab", None])]
    spark.createDataFrame(names, "k int, c string, n string").createOrReplaceTempView("lk_dim")
    spark.createDataFrame([(1, "Noches"), (3, "x y")], "a int, alias string").createOrReplaceTempView("lk_alias")
    register_contains_lookup(spark, "lk", "lk_dim", "lk_alias", "k", "c", "n", "a")
    terms = ["NOCHES", "a", "ab", "media", "c4", "ación", "", None, "Estancia m", "zz"]
    spark.createDataFrame([(t,) for t in terms], "t string").createOrReplaceTempView("lk_terms")
    out = spark.sql("SELECT t, b.id FROM lk_terms, LATERAL lk(t) b")
    low = lambda s: (s or "").lower()
    want = {(t, i) for t in terms if t for i, c, n in names if (n and low(t) in low(n)) or low(c) == low(t)} | {("NOCHES", 1)}
    assert {(r.t, r.id) for r in out.collect()} == want and out.count() == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_null_keys_are_keys(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, None, "a"), (3, 1, None), (4, 1, "b")], "o int, x int, y string")
    once = dedup.insert_ignore(rows.filter("o = 3"), rows, ["x", "y"], "o")
    assert {r.o for r in once.collect()} == {1, 3, 4}
    assert dedup.insert_ignore(once, rows, ["x", "y"], "o").count() == 3
    known = rows.filter("x IS NULL")
    assert {r.o for r in dedup.seen_before(rows, known, "x").collect()} == {1, 2} and {r.o for r in dedup.not_seen(rows, known, "x").collect()} == {3, 4}


def test_a_path_that_wins_one_key_and_loses_another(spark):
    rows = spark.createDataFrame([("A", "p", 2), ("B", "p", 1), ("B", "q", 5)], "h string, path string, n int")
    kept, moved = dedup.dedup_keep(rows, F.col("h"), "path", "mtime", mtime="n")
    assert {(r.h, r.path) for r in kept.collect()} == {("A", "p"), ("B", "q")}
    assert {(r.h, r.path, r.kept_path) for r in moved.collect()} == {("B", "p", "q")}
