"""Work that has to keep its bounds as tables grow, on small tables."""

from __future__ import annotations

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marisma.functions import chunking
from marisma.operators import articles, pages, search, text_index
from marisma.plans.functions import register_contains_lookup
from marisma.session import work_dir
from marisma.streaming import jobs


def test_cut_references_are_decoded_on_both_sides(spark, tmp_path):
    """A title that ends inside a character reference: &amp and &quot count without their semicolon, &am is text."""
    heads = ["uno &amp;&amp", "dos &quot", "tres &am", "cuatro &#x27", "cinco &lt;x &gt"]
    pages = [(i, "u", f"<html><head><title>{t}</title><style></style></head><body><article><h1>{t}</h1><p>un párrafo &amp; otro, de más de cuarenta letras {t}</p></article></body></html>") for i, t in enumerate(heads)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = entry.queries()["H03_site_article"](spark, str(tmp_path)).select("page_id", "titulo", "cuerpo").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, titulo, cuerpo FROM ({entry.oracle_sql()['H03_site_article']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert [t for _, t, _ in sorted(want)] == ["uno &&", 'dos "', "tres &am", "cuatro '", "cinco <x >"]


def test_blocks_have_no_paragraph_that_the_site_finds_too_short(spark, tmp_path):
    """elpais.com takes 41 letters: two paragraphs of 40 are no body there, as in its SQL; elsewhere they are one."""
    def page(*lengths):
        body = "".join(f"<p>{'b' * n}</p>" for n in lengths)
        return f"<html><head><title>t</title><style></style></head><body><article><h1>t</h1>{body}</article></body></html>"

    rows = [(i, "u", page(*lengths)) for i, lengths in enumerate([(40, 40), (0, 0), (20, 20), (40, 40), (1,), (), (21, 20), (40, 41)])]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = entry.queries()["H03_site_article"](spark, str(tmp_path)).select("page_id", "titulo", "cuerpo").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT page_id, titulo, cuerpo FROM ({entry.oracle_sql()['H03_site_article']})").fetchall())

    html, short = page(40, 40), ["b" * 40] * 2
    sites = [(1, "https://elpais.com/a", html), (2, "https://www.abc.es/a", html), (3, "https://otro.es/a", html), (4, "https://www.diariodesevilla.es/a", html), (5, None, html)]
    out = pages.site_article(spark.createDataFrame(sites, "id int, url string, html string"), "id")
    assert "_minimo" not in out.columns
    assert {r.id: r.cuerpo for r in out.collect()} == {1: None, 2: short, 3: short, 4: short, 5: short}


def test_letters_of_names_are_not_taken_for_small(spark, tmp_path):
    """The table of letters is larger than its file; a plan that does not know it broadcasts it."""
    rows = spark.range(5000).selectExpr("id AS k", "concat('C', id) AS c", "concat('una denominación larga ', id) AS n")
    rows.coalesce(1).write.parquet(f"{tmp_path}/dim")
    spark.read.parquet(f"{tmp_path}/dim").createOrReplaceTempView("bl_dim")
    spark.createDataFrame([(1, "x")], "a bigint, alias string").createOrReplaceTempView("bl_alias")
    register_contains_lookup(spark, "bl", "bl_dim", "bl_alias", "k", "c", "n", "a")
    letters = spark.table("bl_por_letras")
    estimate = int(str(letters._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert estimate > letters.count() * 40
    found = spark.sql("SELECT t, b.id FROM VALUES ('LARGA 4999'), ('c7'), ('ción larga 12'), ('zz') x(t), LATERAL bl(t) b")
    want = {("LARGA 4999", 4999), ("c7", 7)} | {("ción larga 12", i) for i in range(5000) if str(i).startswith("12")}
    assert {(r.t, r.id) for r in found.collect()} == want


def test_equal_scores_stay_bounded_in_a_task(spark):
    """Copies of one vector tie with each other: a task keeps k of them, the smallest keys, not all."""
    rows = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3000, 0, -1)], "id bigint, v array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], "qid bigint, qvec array<double>")
    kept = search.vector_scores(rows, "id", "v", asked, k=3).collect()
    assert sorted((r.qid, r.id) for r in kept) == [(q, i) for q in (1, 2) for i in (1, 2, 3)]
    sims = np.array([[0.5, 1.0], [0.5, 0.0], [0.5, 1.0], [0.9, 1.0]])
    assert search.first_k(sims, 2).tolist() == [[True, True], [False, False], [False, True], [True, False]]


def test_words_are_hashed_once(monkeypatch):
    calls = []
    real = chunking.hashlib.md5
    monkeypatch.setattr(chunking.hashlib, "md5", lambda x: calls.append(x) or real(x))
    known = {}
    a, b = chunking.hash_vector("uno dos uno", 16, known), chunking.hash_vector("dos UNO uno", 16, known)
    assert len(calls) == 2 and (a == b).all() and (a == chunking.hash_vector("uno uno dos", 16)).all()


def test_paragraphs_leave_in_bounded_batches(spark, monkeypatch):
    """Pages are read one by one; what is found goes on by its length, not by the number of paragraphs."""
    monkeypatch.setattr(pages, "CHARACTERS_IN_MEMORY", 1000)
    html = "<article>" + "".join(f"<p>{'x' * 400} {i}</p>" for i in range(9)) + "</article>"
    rows = spark.createDataFrame([(1, html), (2, None), (None, html)], "id int, html string").coalesce(1)
    out = pages.paragraph_candidates(rows, "id")
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert out.groupBy("id").count().orderBy("id").collect() == [(None, 9), (1, 9)]


def test_a_level_of_candidates_is_parsed_once(spark):
    rows = spark.createDataFrame([(1, '{"title": "a", "x": [{"titulo": " b ", "y": "t"}, 3, {"url": "u"}]}'), (2, None), (3, "no"), (4, '[{"headline": "c"}]'), (5, '"s"')], "id int, p string")
    out = articles.flatten_candidates(rows, "p", ["id"])
    assert sorted((r.id, r.title) for r in out.collect()) == [(1, "a"), (1, "b"), (4, "c")]
    assert "parse_json" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_state_call_takes_a_bucket_of_keys(spark, tmp_path):
    """Keys share state rows; numbers go on over batches, null keys apart."""
    schema = "k string, t timestamp, e bigint, mejora boolean, nuevas int"
    days = [[("a", 2, 1, True, 1), ("b", 1, 2, False, 2), (None, 1, 3, False, None), ("a", 1, 4, False, 3)], [("b", 5, 5, True, 1), ("a", 6, 6, False, 1), (None, 7, 7, False, 4), ("c", 7, 8, None, 1)]]
    got = []
    for n, day in enumerate(days):
        spark.createDataFrame([(k, f"2024-01-0{d}", e, m, x) for k, d, e, m, x in day], "k string, t string, e bigint, mejora boolean, nuevas int").selectExpr("k", "CAST(t AS timestamp) t", "e", "mejora", "nuevas").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.stream_articles(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, "parquet")
        jobs.append_to(jobs.stream_plateau(stream, "k", "t", "e", buckets=1), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {r.e: (r.k, r.iteracion, r.estancamiento, r.fuentes) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {4: ("a", 1, 1, 3), 1: ("a", 2, 0, 4), 6: ("a", 3, 1, 5), 2: ("b", 1, 1, 2), 5: ("b", 2, 0, 3), 3: (None, 1, 1, 0), 7: (None, 2, 2, 4), 8: ("c", 1, 1, 1)}


def test_keyword_hits_are_dealt_by_document(spark, monkeypatch):
    """As many tasks as the hits need."""
    monkeypatch.setattr(search, "HITS_IN_TASK", 10)
    docs = spark.createDataFrame([(i, "uno dos " + "tres " * (i % 3)) for i in range(60)], "id bigint, t string")
    asked = spark.createDataFrame([(1, "uno tres"), (2, "dos"), (3, "nada")], "qid bigint, qtext string")
    out = search.keyword_scores(docs, "id", F.col("t"), asked)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ", 16), REPARTITION_BY_NUM" in plan
    assert out.count() == 120 and {r.qid for r in out.select("qid").distinct().collect()} == {1, 2}


def test_words_of_a_document_are_counted_in_place(spark):
    """Neither texts nor words are shuffled for an index; documents of one key are one, null keys only count."""
    docs = spark.createDataFrame([(1, "b a b ñ"), (2, ""), (3, None), (4, "a"), (4, "c a"), (4, "a"), (None, "b b")], "id bigint, t string")
    counted = text_index._counted(docs, "id", F.col("t"))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert [(r.terminos, r.veces, r.largo) for r in counted.collect() if r.id == 1] == [(["a", "b", "ñ"], [1, 2, 1], 4)]
    index = text_index.build_index(docs, "id", F.col("t"), work_dir(spark, "index"))
    assert (index.n, index.mean) == (7, 10 / 7)
    assert {r.termino: r.n for r in index.words(spark).collect()} == {"a": 3, "b": 1, "c": 1, "ñ": 1}
    rows = {r.id: sorted(zip(r.terminos, r.veces, r.largos)) for r in index.rows(spark).collect()}
    assert rows[4] == [("a", 1, 2), ("a", 2, 1), ("c", 1, 2)] and rows[2] == rows[3] == [] and len(rows) == 5


def test_scores_are_not_shuffled(spark, monkeypatch):
    """A document's scores are made where its row is; blocks and steps of any size give the same."""
    rnd = np.random.default_rng(5)
    texts = [(i, " ".join(f"w{int(x)}" for x in rnd.integers(0, 40, rnd.integers(0, 12)))) for i in range(300)] + [(i, "w1 w2") for i in range(400, 320, -1)] + [(7, "w3 w9 " * 7)]
    docs = spark.createDataFrame(texts, "id bigint, t string").repartition(3)
    asked = spark.createDataFrame([(q, " ".join(f"w{(q * 7 + j * j) % 45}" for j in range(q % 6))) for q in range(30)] + [(50, "w1 w2")], "qid bigint, qtext string")
    index = text_index.build_index(docs, "id", F.col("t"), work_dir(spark, "index"), block=50)
    for name, size in (("WORDS_AT_ONCE", 40), ("QUERIES_IN_STEP", 3), ("CELLS_IN_STEP", 200), ("FOUND_IN_MEMORY", 10)):
        monkeypatch.setattr(text_index, name, size)
    terms = text_index._asked(index, asked, "qid", "qtext")
    found = text_index._scan(index, terms, "qid", 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan
    score = search.keyword_scores(docs, "id", F.col("t"), asked).collect()
    every = {(r.qid, r.id): r.bm25 for r in score}
    want = {(r.qid, r.id): r.rango for r in search.search_keyword(docs, "id", F.col("t"), asked, 4).collect()}
    got = text_index.search_index(index, asked, 4).collect()
    assert {(r.qid, r.id): r.rango for r in got} == want and sorted(i for q, i in want if q == 50) == [321, 322, 323, 324]
    bounds = spark.createDataFrame([(q, 3.0) for q in range(0, 60, 2)], "qid bigint, cota double")
    reach = text_index.at_least(index, terms, bounds, "qid").collect()
    assert {(r.qid, r.id) for r in reach} == {(q, i) for (q, i), s in every.items() if q % 2 or s >= 3.0}
    assert max(abs(r.bm25 - every[r.qid, r.id]) for r in reach) < 1e-9


def test_hits_of_hybrid_search_are_not_dealt_by_query(spark):
    """A hit meets its query's vector where it is: no exchange carries vectors."""
    docs = spark.createDataFrame([(i, f"uno dos{i % 3} tres{i % 7}") for i in range(80)], "id bigint, t string")
    vectors = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(0, 90, 2)], "id bigint, v array<double>")
    asked = spark.createDataFrame([(q, f"uno tres{q}", [1.0, float(q), 0.5]) for q in range(5)], "qid bigint, qtext string, qvec array<double>")
    index = text_index.build_index(docs, "id", F.col("t"), work_dir(spark, "index"))
    got = text_index.search_hybrid_stored(index, vectors, "v", asked, 6)
    dealt = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(qid" in x]
    assert len(dealt) <= 1  # the k best at last
    want = search.search_hybrid(docs, "id", F.col("t"), vectors, "v", asked, 6)
    pick = lambda rows: sorted((r.qid, r.rango, r.id, round(r.puntuacion, 7)) for r in rows.collect())
    assert pick(got) == pick(want)
