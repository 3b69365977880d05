"""Operators against brute force and on literal rows."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marisma.functions import chunking
from marisma.operators import articles, dedup, evidence, facts, grids, pages, search, series, upserts
from marisma.plans import questions
from marisma.schemas import CELL_GRID, NEWS_DEFAULTS, NEWS_V2
from marisma.session import work_dir
from marisma.sources import corpus, reference_data, reports

# ---------------------------------------------------------------- facts


def test_expand_categories(spark):
    cases = [["britanicos"], ["franceses"], ["litoral", "franceses"], ["otros_mercados"], ["alemanes", "otros_mercados"]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c array<string>")
    got = [r[0] for r in df.orderBy("i").select(facts.expand_categories(F.col("c"))).collect()]
    assert got == [["britanicos"], ["otros_mercados", "britanicos", "alemanes"], ["litoral", "otros_mercados", "britanicos", "alemanes"],
                   ["otros_mercados", "britanicos", "alemanes"], ["alemanes", "otros_mercados", "britanicos"]]


def test_metric_terms():
    assert facts.metric_terms(["Turistas"], ["cruceros"]) == ["turistas", "pasajeros"]
    assert "viajeros" in facts.metric_terms(["viajeros"], ["alemanes"])
    assert facts.metric_terms(["Gasto"], ["alemanes"]) == ["gasto"]


def test_contains_join_equals_nested_loop(spark):
    rnd = random.Random(1)
    texts = [(i, "".join(rnd.choice("abC ") for _ in range(rnd.randint(0, 12)))) for i in range(120)]
    terms = [(t,) for t in {"".join(rnd.choice("Abc ") for _ in range(rnd.randint(1, 5))) for _ in range(40)}]
    out = facts.contains_join(spark.createDataFrame(texts, "id int, t string"), "t", spark.createDataFrame(terms, "q string"), "q")
    got = {(r.id, r.q) for r in out.collect()}
    assert out.count() == len(got)
    assert got == {(i, q) for i, t in texts for (q,) in terms if q.lower() in t.lower()}


def test_scope_of_token(spark):
    names = ["Sevilla", "alemanes", "litoral", "resto-espana", "gran_total", "marte"]
    df = spark.createDataFrame([(n,) for n in names], "token string")
    got = {r.token: (r.ambito, r.valor) for r in facts.scope_of_token(df).collect()}
    assert got == {"Sevilla": ("provincia", "sevilla"), "alemanes": ("mercado", "alemanes"), "litoral": ("segmento", "litoral"),
                   "resto-espana": ("mercado", "resto_espana"), "gran_total": ("total", "total_turistas"), "marte": ("desconocido", "marte")}


def test_change_without_base_has_no_percent(spark):
    df = spark.createDataFrame([("a", 2023, 0.0), ("a", 2024, 5.0), ("a", 2025, 10.0)], "k string, anio int, metrica_valor double")
    got = {r.anio: (r.diferencia, r.variacion_pct) for r in facts.year_over_year(df, ["k"]).collect()}
    assert got == {2023: (None, None), 2024: (5.0, None), 2025: (5.0, 100.0)}


def test_arg_max_breaks_ties_by_name(spark):
    df = spark.createDataFrame([("p", "b", 5.0), ("p", "a", 5.0), ("p", "c", 1.0)], "k string, e string, metrica_valor double")
    assert [tuple(r) for r in questions.arg_max(df, "e", ["k"]).collect()] == [("p", "a", 5.0)]


def test_dimension_tables(spark):
    dims = reference_data.build_dims(spark)
    assert {k: v.count() for k, v in dims.items() if not k.endswith("alias")} == {"provincias": 8, "mercados": 7, "tipos_turismo": 5, "indicadores": 19}
    for name, key in (("provincias", "id_provincia"), ("mercados", "id_mercado"), ("tipos_turismo", "id_tipo_turismo"), ("indicadores", "id_indicador")):
        assert reference_data.duplicate_aliases(dims[f"{name}_alias"], key).count() == 0
    asked = spark.createDataFrame([("SVQ",), ("almería",), ("41",), ("nada",)], "termino string")
    hits = facts.lookup_alias(asked, dims["provincias"], dims["provincias_alias"], "id_provincia", "codigo_provincia", "nombre_provincia")
    assert {(r.termino, r.nombre_provincia) for r in hits.collect()} == {("SVQ", "Sevilla"), ("almería", "Almería"), ("41", "Sevilla")}
    found = facts.lookup_contains(spark.createDataFrame([("viajeros",)], "termino string"), dims["indicadores"], dims["indicadores_alias"],
                                  "id_indicador", "codigo_indicador", "nombre_indicador")
    assert found.count() == 3
    assert reference_data.build_calendar(spark).count() == 60


# ---------------------------------------------------------------- grids


def test_grid_to_metrics(spark):
    f = "01_total_turistas_ene25.xlsx"
    cells = {
        10: {2: "DATOS MENSUALES", 5: "DATOS ACUMULADO AÑO"},
        11: {1: "PERNOCTACIONES EN ESTABLECIMIENTOS HOTELEROS DE ANDALUCÍA"},
        12: {1: "Total", 2: "1847648", 3: "-0,3", 4: "abril - 2024", 5: "5000", 6: "2,5", 7: "enero-abril - 2024"},
        13: {1: "Desplazado", 4: "700", 5: "0,9", 6: "texto"},
        14: {1: "Cuota", 2: "0,25", 3: "0,01"},
        15: {1: "Otra sección"},
        16: {1: "Plazas", 2: "10", 3: "25", 4: "3"},
    }
    rows = [(f, "ficha", r, c, v) for r, line in cells.items() for c, v in line.items()]
    grid = spark.createDataFrame(rows, CELL_GRID)
    got = {(r.metrica_nombre, r.periodo_tipo): (r.metrica_valor, r.variacion_interanual, r.periodo_descripcion) for r in grids.grid_to_metrics(grid, min_abs=1.0, first_row=10).collect()}
    sec = "Número de pernoctaciones en establecimientos hoteleros - "
    assert got[(sec + "Total", "mensual")] == (1847648.0, -0.3, "abril - 2024")
    assert got[(sec + "Total", "acumulado")] == (5000.0, 2.5, "enero-abril - 2024")
    assert got[(sec + "Desplazado", "mensual")][0] == 700.0
    # nothing of one or more to the right of 0,9, so the value left of it is taken
    assert got[(sec + "Desplazado", "acumulado")][0] == 700.0
    assert not any("Cuota" in k[0] for k in got)
    assert got[("Otra sección - Plazas", "mensual")] == (10.0, 3.0, "3")
    loose = {r.metrica_nombre for r in grids.grid_to_metrics(grid, first_row=10).collect()}
    assert sec + "Cuota" in loose


def test_grid_without_headings_guesses_its_columns(spark):
    rows = [("05_extranjeros_feb24.xlsx", "ficha", 12, 1, "Viajeros"), ("05_extranjeros_feb24.xlsx", "ficha", 12, 3, "120"),
            ("05_extranjeros_feb24.xlsx", "ficha", 12, 4, "1,5"), ("05_extranjeros_feb24.xlsx", "ficha", 12, 5, "enero-febrero - 2024")]
    got = grids.grid_to_metrics(spark.createDataFrame(rows, CELL_GRID), min_abs=1.0, first_row=10).collect()
    assert [(r.periodo_tipo, r.metrica_valor, r.variacion_interanual) for r in got] == [("acumulado", 120.0, 1.5)]


def test_grid_lines_far_down_are_read(spark):
    head = [("05_extranjeros_feb24.xlsx", "ficha", r, 1, f"Viajeros {r}") for r in (12, 201, 350, 5000)]
    rows = [*head, *[(f, s, r, 3, str(r)) for f, s, r, _, _ in head], *[(f, s, r, 4, "1,5") for f, s, r, _, _ in head]]
    got = grids.grid_to_metrics(spark.createDataFrame(rows, CELL_GRID), min_abs=1.0, first_row=10).collect()
    assert {r.metrica_valor for r in got} == {12.0, 201.0, 350.0, 5000.0}
    assert {r.metrica_valor for r in grids.grid_to_metrics(spark.createDataFrame(rows, CELL_GRID), min_abs=1.0, first_row=10, last_row=200).collect()} == {12.0}


def test_objects_are_found_at_any_depth(spark):
    import json

    deep = {"title": "t", "publisher": " p ", "publishedDate": "2024"}
    for n in range(12):
        deep = {f"k{n}": [deep, {"title": f"t{n}"}] if n % 3 == 0 else deep}
    rows = spark.createDataFrame([(1, json.dumps(deep)), (2, None), (3, "no json"), (4, "[]")], "k int, p string")
    got = sorted((r.k, r.title, r.source, r.published) for r in articles.flatten_candidates(rows, "p", ["k"]).collect())
    assert got == sorted([(1, "t", "p", "2024"), *[(1, f"t{n}", "", "") for n in range(0, 12, 3)]])


def test_work_folders(spark):
    from marisma import session

    for master in ("local", "local[4]", "local[*]"):
        session.require_local(master)
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.require_local(master)
    kept, session._GIVEN[:] = list(session._GIVEN), []
    df = session.cut_lineage(spark.range(3), "gone")
    path = session._GIVEN[0]
    assert df.count() == 3 and session.clear_work(spark) == 1 and not session._GIVEN
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(path).count()
    session._GIVEN[:] = kept


def test_sheet_choice(spark):
    rows = [("a", "HojaFinal", 0, 0, "x"), ("a", "Ficha", 0, 0, "y"), ("b", "hojafinal", 0, 0, "z"), ("c", "otra", 0, 0, "w")]
    got = reports.choose_sheet(spark.createDataFrame(rows, CELL_GRID)).collect()
    assert {(r.file, r.value) for r in got} == {("a", "y"), ("b", "z")}


# ---------------------------------------------------------------- duplicates


def test_dedup_policies(spark):
    t = dt.datetime
    rows = [("k", "p1", t(2024, 1, 1), 5), ("k", "p2", t(2024, 1, 2), 1), ("k", "p3", None, 9), ("k", "p4", t(2024, 1, 2), 1), ("", "p5", None, 1)]
    df = spark.createDataFrame(rows, "k string, path string, ts timestamp, mtime int")
    kept, moved = dedup.dedup_keep(df, F.col("k"), "path", "date", "ts", "mtime")
    assert {r.path for r in kept.collect()} == {"p2", "p5"} and {r.path for r in moved.collect()} == {"p1", "p3", "p4"}
    kept, _ = dedup.dedup_keep(df, F.col("k"), "path", "mtime", None, "mtime", blank_is_error=True)
    assert {r.path for r in kept.collect()} == {"p3"}


def test_dedup_of_a_hot_key_keeps_every_row(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"),
        F.format_string("%08d", "id").alias("path"), (F.col("id") % 100).alias("mtime"))
    kept, moved = dedup.dedup_keep(df, F.col("k"), "path", "mtime", None, "mtime")
    assert (kept.count(), moved.count()) == (20001, 9999)
    assert kept.filter("k = 'hot'").first().path == "00000099"


def test_null_texts_share_one_hash(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",)], "t string")
    assert dedup.hash_census(df, "t").first().asDict() == {"filas": 3, "hashes": 2, "duplicados": 1}


# ---------------------------------------------------------------- ordered state


def _brute_state(rows):
    out, state = {}, {}
    for k, ts, i, score, gain, new in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        n, last, sources, hist = state.get(k, (0, 0, 0, []))
        n, sources, hist = n + 1, sources + new, hist + [score]
        last = n if gain else last
        tail = hist[-3:]
        slope = 0.0 if len(tail) < 2 else float(np.polyfit(range(len(tail)), tail, 1)[0])
        out[i] = (n, n - last, sources, round(slope, 6))
        state[k] = (n, last, sources, hist)
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_iteration_state_equals_brute_force(spark, parts):
    rnd = random.Random(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    base = dt.datetime(2024, 1, 1)
    rows = [(rnd.choice("aaab"), base + dt.timedelta(minutes=rnd.choice([0, 20, 3000, rnd.randint(0, 4000)])), i, rnd.random(), rnd.random() < 0.2, rnd.randint(0, 2))
            for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i int, score double, gain boolean, new int")
    out = series.iteration_state(df, "k", "ts", "i", "score", F.col("gain"), F.col("new"))
    got = {r.i: (r.iteracion, r.estancamiento, r.fuentes, round(r.tendencia, 6)) for r in out.collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got == _brute_state(rows)


def test_ordered_state_keeps_null_keys_and_orders(spark):
    rows = [("a", 1, 5), (None, 2, None), ("a", None, None), (None, 1, 7), ("a", 3, None), (None, None, 8)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = {(r.k, r.o): r.numero for r in series.number_rows(df, ["k"], "o").collect()}
    assert got == {("a", 1): 1, ("a", 3): 2, ("a", None): 3, (None, 1): 1, (None, 2): 2, (None, None): 3}
    got = {(r.k, r.o): r.f for r in series.fill_down(df, ["k"], "o", "v", "f").collect()}
    assert got == {("a", 1): 5, ("a", 3): 5, ("a", None): 5, (None, 1): 7, (None, 2): 7, (None, None): 8}
    log = df.select("k", F.timestamp_seconds("o").alias("t"), F.coalesce("o", F.lit(9)).alias("i"), F.lit(0.5).alias("s"))
    out = series.iteration_state(log, "k", "t", "i", "s", F.lit(False), F.lit(1)).collect()
    assert sorted((str(r.k), r.iteracion, r.fuentes) for r in out) == [(k, n, n) for k in ("None", "a") for n in (1, 2, 3)]


def test_a_burst_of_one_key_is_cut(spark):
    df = spark.range(4000).select(F.lit("k").alias("k"), F.col("id").alias("o"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    cut = series.sliced(df, ["k"], ["o"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert cut.groupBy("_slice").count().count() > 4
    assert series.number_rows(df, ["k"], "o").filter("numero != o + 1").count() == 0


def test_numbering_and_fill_down_across_slices(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), i, rnd.choice([None, None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    numbered = {r.o: r.numero for r in series.number_rows(df, ["k"], "o").collect()}
    filled = {r.o: r.f for r in series.fill_down(df, ["k"], "o", "v", "f").collect()}
    n, last = {}, {}
    for k, o, v in rows:
        n[k] = n.get(k, 0) + 1
        last[k] = v if v is not None else last.get(k)
        assert numbered[o] == n[k] and filled[o] == last[k]


# ---------------------------------------------------------------- chunks and search


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_chunks_are_small_and_lose_no_word(body, size, overlap):
    pieces = chunking.split_text(body, size, overlap)
    assert all(0 < len(p) <= size for p in pieces)
    assert "".join(sorted(set("".join(body.split())))) == "".join(sorted(set("".join("".join(pieces).split()))))
    if overlap == 0:
        assert "".join("".join(pieces).split()) == "".join(body.split())


def test_chunks_overlap_by_whole_words():
    assert chunking.split_text("uno dos tres cuatro cinco", 12, 5) == ["uno dos tres", "tres cuatro", "cinco"]
    assert chunking.split_text("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9]


def test_hashed_vectors():
    a, b = chunking.hash_vector("Uno dos", 32), chunking.hash_vector("dos UNO", 32)
    assert np.array_equal(a, b) and abs(float(np.linalg.norm(a)) - 1) < 1e-6
    assert not chunking.hash_vector("", 32).any()


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "hola " * 500), (2, ""), (3, None), (4, "  \n ")], "id long, t string")
    out = search.chunk_table(df, "id", "t", 100, 20).collect()
    assert {r.id for r in out} == {1} and out[0].vector_id == "1_0"
    assert [r.chunk_index for r in sorted(out, key=lambda r: r.chunk_index)] == list(range(len(out)))


@pytest.mark.parametrize("block", [16 * 1024 * 1024, 8 * 8 * 3])
def test_vector_search_is_exact_in_any_number_of_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK_BYTES", block)
    monkeypatch.setattr(search, "SCORES_IN_MEMORY", 50)
    rng = np.random.default_rng(0)
    rows, asked = rng.normal(size=(200, 8)), rng.normal(size=(7, 8))
    rows[5] = 0.0
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id long, v array<double>").repartition(4)
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(asked)], "qid long, qvec array<double>")
    got = {}
    for r in search.search_vector(table, "id", "v", queries, 5).collect():
        got.setdefault(r.qid, []).append((r.rango, r.id))
    with np.errstate(invalid="ignore"):
        sims = (asked @ rows.T) / (np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None])
    for q in range(7):
        best = np.argsort(-np.nan_to_num(sims[q], nan=-9))[:5]
        assert [i for _, i in sorted(got[q])] == best.tolist()


def test_bm25_equals_brute_force(spark):
    docs = {1: "gato perro gato", 2: "perro", 3: "pez Gato pájaro mesa", 4: ""}
    df = spark.createDataFrame(list(docs.items()), "id long, t string")
    queries = spark.createDataFrame([(0, "gato perro"), (1, "nada")], "qid int, qtext string")
    got = {(r.qid, r.id): r.bm25 for r in search.keyword_scores(df, "id", F.col("t"), queries).collect()}
    toks = {i: t.lower().split() for i, t in docs.items()}
    mean = sum(map(len, toks.values())) / len(toks)
    want = {}
    for term in ("gato", "perro"):
        holders = [i for i, t in toks.items() if term in t]
        idf = math.log(1 + (len(docs) - len(holders) + 0.5) / (len(holders) + 0.5))
        for i in holders:
            tf = toks[i].count(term)
            want[(0, i)] = want.get((0, i), 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks[i]) / mean))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_relevance(spark):
    rows = [("turismo en Sevilla", "El turismo en Sevilla crece", 1.0), ("de la", "x", 0.5), ("turismo rural", "solo turismo", 0.5)]
    df = spark.createDataFrame(rows, "q string, t string, w double")
    assert all(abs(r.r - r.w) < 1e-9 for r in df.select("w", search.relevance(F.col("q"), F.col("t")).alias("r")).collect())


# ---------------------------------------------------------------- evidence


def _brute_spans(body, claims):
    low, at, out = body.lower(), 0, []
    for c in claims:
        n = c.strip().lower()
        pos = low.find(n, at) if n else -1
        if n and pos == -1:
            pos = low.find(n)
        if not n or pos == -1:
            out.append((0, 0))
            continue
        out.append((pos, pos + len(n)))
        at = pos + len(n)
    return out


def test_claim_spans_and_heat_equal_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        body = "".join(rnd.choice("abA ") for _ in range(rnd.randint(0, 40)))
        claims = [body[a: a + rnd.randint(0, 9)] if rnd.random() < 0.8 else "zz" for a in (rnd.randint(0, 40) for _ in range(rnd.randint(1, 6)))]
        rows.append((i, body, claims, [rnd.choice([-0.9, 0.0, 0.5, 1.0]) for _ in claims]))
    df = spark.createDataFrame(rows, "id int, body string, claims array<string>, scores array<double>")
    spans = {r.id: [tuple(s) for s in r.s] for r in df.withColumn("low", F.lower("body")).select("id", evidence.claim_spans(F.col("low"), F.col("claims")).alias("s")).collect()}
    heat = {(r.id, r.pos): (r.intensidad, r.marca) for r in evidence.per_character(evidence.heat_spans(df, "body", "claims", "scores", ["id"]), ["id"]).collect()}
    for i, body, claims, scores in rows:
        want = _brute_spans(body, claims)
        assert spans[i] == want
        color = [(0.0, 0)] * len(body)
        for (a, b), s in zip(want, scores):
            for p in range(a, b):
                color[p] = (min(1.0, abs(s)), 1 if s > 0.2 else -1 if s < -0.2 else 0)
        assert [heat[(i, p)] for p in range(len(body))] == color


def test_heat_of_ten_thousand_claims(spark):
    """Nested, overlapping, equal and absent claims on one long text; a claim without a score covers with 0."""
    rnd = random.Random(11)
    body = "".join(rnd.choice("abcdefghij") for _ in range(30_000))
    places = [(a, a + rnd.choice([1, 5, 40, 4000])) for a in (rnd.randrange(29_990) for _ in range(10_000))]
    starts, ends = [a for a, _ in places] + [0, 7], [min(b, len(body)) for _, b in places] + [0, 7]
    color = [None] * len(body)
    for n, (a, b) in enumerate(zip(starts, ends)):
        color[a:b] = [n] * (b - a)
    pieces = list(evidence.sweep(starts, ends, len(body)))
    assert [n for a, b, n in pieces for _ in range(a, b)] == color
    assert pieces[0][0] == 0 and all(x[1] == y[0] for x, y in zip(pieces, pieces[1:])) and pieces[-1][1] == len(body)

    # through Spark: the claims are the text's own pieces in order, then one that covers them all
    claims = [body[i: i + 6] for i in range(0, 12_000, 6)]
    rows = [(1, body, [*claims, None, "zz"], [0.5] * len(claims)), (2, "", ["a"], [1.0]), (3, None, ["a"], [1.0]), (4, "abc", None, None), (5, "abc", [], []), (6, "abc", ["ab", "b"], [0.9])]
    df = spark.createDataFrame(rows, "id int, body string, claims array<string>, scores array<double>")
    got = [tuple(r) for r in evidence.heat_spans(df, "body", "claims", "scores", ["id"]).collect()]
    want = [(1, i, i + 6, 0.5, 1) for i in range(0, 12_000, 6)] + [(1, 12_000, 30_000, 0.0, 0)]
    assert sorted(r for r in got if r[0] == 1) == want
    assert sorted(r for r in got if r[0] > 1) == [(5, 0, 3, 0.0, 0), (6, 0, 1, 0.9, 1), (6, 1, 2, 0.0, 0), (6, 2, 3, 0.0, 0)]
    assert evidence.heat_spans(df.limit(0), "body", "claims", "scores", ["id"]).collect() == []


def test_claim_with_offline_evidence(spark):
    claim = spark.createDataFrame([(1, "El informe indica que en 2023 llegaron 2.5 millones de turistas a Andalucía", True, 2.5e6, "")],
                                  "claim_id int, texto string, tagged boolean, claim_value double, resumen string")
    mentions = spark.createDataFrame([(1, "Diario de Sevilla"), (1, "ABC Andalucía")], "claim_id int, fuente string")
    web = spark.createDataFrame([(1, "official", "supportive"), (1, "independent", "supportive")], "claim_id int, type string, stance string")
    official = spark.createDataFrame([(1, 2.5e6)], "claim_id int, value double")
    r = evidence.score_claims(claim, mentions, web, official).first()
    assert (r.prensa, r.web, r.oficial, r.total, r.apoyos, r.veredicto, r.escala) == (3, 2, 3, 8, 4, "Verdadera", 0.8)
    denied = claim.withColumn("resumen", F.lit("El dato fue DESMENTIDO"))
    assert evidence.score_claims(denied, mentions, web, official).first().veredicto == "Falsa"


# ---------------------------------------------------------------- articles and pages


def test_template_keeps_what_is_there(spark):
    raw = spark.createDataFrame([("x", ("fr", 7)), (None, (None, None))], "id string, text struct<lang: string, word_count: int>")
    rows = articles.merge_template(raw, NEWS_V2, NEWS_DEFAULTS).collect()
    assert rows[0].id == "x" and rows[0].text.lang == "fr" and rows[0].text.word_count == 7
    assert rows[1].id == "" and rows[1].text.lang == "es" and rows[1].text.quotes == []
    assert rows[0].classify.stance_by_party["bng"] == 0.0 and rows[0].signals.radar["vivienda"]["pp"] == [None] * 5
    assert rows[0].audit.pipeline_version == "etl-news-1.0.0" and rows[0].geo.country is None


def test_static_enrichment(spark):
    body = "palabra " * 150 + "\n\nHazte suscriptor"
    rows = [("https://www.elpais.com/espana/una-noticia.html", "Un Título", body, "2023-02-23T05:00:00+01:00"), ("elpais.com/2024", "T", "corto", "ayer")]
    a, b = articles.enrich_static(spark.createDataFrame(rows, "url string, title string, body string, date string")).collect()
    assert a.domain == "elpais.com" and a.media_name == "El País" and a.country == "ES" and a.word_count == 150 and a.reading_time_min == 1
    assert a.paywall and a.fixed and a.errors == [] and a.warnings == ["paywall_overlay_stripped"] and a.iso_week == 8
    assert b.errors == ["url_invalid:invalid_format", "non_article_index:too_short"] and b.id_confidence == "low"
    assert b.warnings == ["id_uses_domain_fallback", "no_publish_time"] and b.url_original_repaired == "https://elpais.com/t.html"


def test_model_rules(spark):
    df = spark.sql("""select array('pp') parties_present, map('pp', 0.5D, 'vox', -0.5D) stance_by_party, 0.3D sentiment_score, 0.7D argument_affinity_index,
        map('economia', map('pp', array(1D), 'vox', array(2D), 'programa', array(3D))) radar, cast(null as string) excluded_reason
        union all select array('pp'), map('pp', 0.5D), 0.0D, 0.7D, map('economia', map('pp', array(1D))), 'too_short'""")
    a, b = articles.apply_model_fields(df).collect()
    assert a.stance_by_party == {"pp": 0.5, "vox": 0.0} and a.coverage_label == "positive" and a.affinity_contrib == 0.7
    assert a.radar["economia"] == {"pp": [1.0], "vox": [None] * 5, "programa": [3.0]}
    assert set(b.stance_by_party.values()) == {0.0} and b.affinity_contrib == 0.0 and b.axes_method == "skipped"


def test_page_article_sources(spark):
    ld = """<script type="application/ld+json">[{"@type":"Org"},{"@type":["NewsArticle"],"headline":"Del JSON","author":[{"name":"Ana"}],
      "datePublished":"2024-05-01T10:00:00+02:00","keywords":["a"," b "],"image":{"url":"http://i"},"articleBody":"Un párrafo bastante largo para pasar de cuarenta letras.\\n\\ncorto"}]</script>"""
    og = '<meta property="og:title" content=" De OG "><meta property="article:tag" content="x"><meta name="news_keywords" content="y, z"><meta content="Luis" name="author">'
    dl = '<script>window.DTM = {"pageDataLayer": {"articleTitle": "Del layer", "author": [{"name": "Eva"}], "tags": [{"name": "t"}]}};</script>'
    h1 = '<h1>De <b>H1</b></h1><time datetime="2024-01-02T03:04:05Z">x</time>'
    df = spark.createDataFrame([(0, ld + og), (1, og + h1), (2, dl + h1), (3, h1), (4, "<p>nada</p>")], "i int, html string")
    r = pages.page_article(df).orderBy("i").collect()
    assert [x.titulo for x in r] == ["Del JSON", "De OG", "Del layer", "De H1", None]
    assert [x.autor for x in r] == ["Ana", "Luis", "Eva", None, None]
    assert [x.tags for x in r] == [["a", "b"], ["x", "y", "z"], ["t"], [], []]
    assert r[0].fecha == dt.datetime(2024, 5, 1, 8) and r[3].fecha == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert r[0].imagen == "http://i" and r[0].cuerpo_ld == ["Un párrafo bastante largo para pasar de cuarenta letras."]


def test_best_paragraph_block(spark):
    long = "Este párrafo tiene más de cuarenta caracteres, número {}."
    html = (f"<div class='content ads'><p>{long.format(9)}</p><p>{long.format(8)}</p><p>{long.format(7)}</p></div>"
            f"<article><p>{long.format(1)}<p>corto</p><p>Ver también: {long.format(5)}</p><div class='article-body'><p>{long.format(2)}</p></div></article>"
            "<footer><p>pie de página que también supera los cuarenta caracteres</p></footer>")
    out = pages.best_paragraph_block(spark.createDataFrame([(1, html), (2, "<p>solo</p>")], "id int, html string"), "id").collect()
    assert [(r.id, r.contenido) for r in out] == [(1, [long.format(1), long.format(2)])]


def test_crawl_frontier(spark):
    edges = [("http://a", "http://b"), ("http://b", "http://c"), ("http://b", "http://a"), ("http://c", "http://d"), ("http://a", "mailto:x")]
    start = spark.createDataFrame([("http://a",)], "url string")
    out = pages.crawl_frontier(spark.createDataFrame(edges, "url string, enlace string"), start, 2)
    assert {(r.url, r.profundidad) for r in out.collect()} == {("http://a", 0), ("http://b", 1), ("http://c", 2)}


def test_json_tree_with_broken_files(spark, tmp_path):
    import gzip
    import json

    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "a.json").write_text(json.dumps({"titulo": "A", "contenido": ["p", "q"]}, indent=2))
    with gzip.open(tmp_path / "x" / "y" / "b.json.gz", "wt") as f:
        json.dump({"titulo": "B"}, f)
    (tmp_path / "x" / "c.json").write_text('{"titulo": ')
    (tmp_path / "x" / "d.txt").write_text("no")
    good, bad = corpus.quarantine_corrupt(corpus.scan_json_tree(spark, str(tmp_path)))
    assert {r.titulo for r in good.collect()} == {"A", "B"} and bad.first().path.endswith("c.json") and bad.count() == 1
    assert good.filter("mtime is null").count() == 0
    names = spark.createDataFrame([("a/b.json",), ("a/b.json.gz",), ("a/b.txt",)], "p string")
    assert {r[0] for r in names.select(corpus.output_path(F.col("p"))).collect()} == {"a/b.json.gz"}


# ---------------------------------------------------------------- maintenance


def test_upsert_twice_changes_nothing(spark):
    target = spark.createDataFrame([(1, None, "a", 1.0), (2, "x", "b", 2.0)], "k int, k2 string, v string, w double")
    source = spark.createDataFrame([(1, None, None, 9.0, 1), (1, None, "c", None, 2), (3, None, "n", 3.0, 1)], "k int, k2 string, v string, w double, o int")
    once = upserts.upsert(target, source, ["k", "k2"], "o", merge_fields=True)
    assert {tuple(r) for r in once.collect()} == {(1, None, "c", 1.0, "actualizada"), (2, "x", "b", 2.0, "igual"), (3, None, "n", 3.0, "insertada")}
    twice = upserts.upsert(once.drop("accion"), source, ["k", "k2"], "o", merge_fields=True)
    assert {tuple(r)[:4] for r in twice.collect()} == {tuple(r)[:4] for r in once.collect()}
    assert twice.filter("accion = 'insertada'").count() == 0


def test_stamps(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 2)
    target = spark.createDataFrame([(1, "a", t0, t0)], "k int, v string, created_at timestamp, updated_at timestamp")
    source = spark.createDataFrame([(1, "b", 1), (2, "c", 1)], "k int, v string, o int")
    got = {r.k: (r.v, r.created_at, r.updated_at) for r in upserts.upsert(target, source, ["k"], "o", stamp=F.lit(t1)).collect()}
    assert got == {1: ("b", t0, t1), 2: ("c", t1, t1)}


def test_snapshots_and_partitions(spark):
    root = work_dir(spark, "snap")
    for version, rows in ((1, [(1, "a")]), (2, [(1, "a"), (2, "b")])):
        upserts.write_snapshot(spark.createDataFrame(rows, "k int, v string"), root, version)
    assert upserts.read_snapshot(spark, root, "k int, v string").count() == 2
    base = spark.createDataFrame([(1, 2023), (2, 2024)], "v int, anio int")
    parts = work_dir(spark, "parts")
    for _ in range(2):
        upserts.write_partitions(base, parts, ["anio"])
        upserts.write_partitions(spark.createDataFrame([(9, 2024)], "v int, anio int"), parts, ["anio"])
    assert {(r.v, r.anio) for r in spark.read.parquet(parts).collect()} == {(1, 2023), (9, 2024)}


def test_insert_ignore_and_recency(spark):
    target = spark.createDataFrame([("a", 1)], "k string, i int")
    source = spark.createDataFrame([("a", 2), ("b", 4), ("b", 3)], "k string, i int")
    once = dedup.insert_ignore(target, source, ["k"], "i")
    assert {tuple(r) for r in once.collect()} == {("a", 1), ("b", 3)} == {tuple(r) for r in dedup.insert_ignore(once, source, ["k"], "i").collect()}
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 30)), (2, dt.datetime(2024, 1, 1)), (3, None)], "i int, ts timestamp")
    as_of = F.lit(dt.datetime(2024, 1, 31))
    ids = lambda df: sorted(r.i for r in df.collect())
    assert ids(articles.crawl_recent(rows, "ts", as_of, 5)) == [1, 3]
    assert ids(articles.search_recent(rows, "ts", as_of, 5)) == [1]
    assert ids(articles.search_recent(rows, "ts", F.lit(dt.datetime(2030, 1, 1)), 5)) == [1, 2, 3]
    assert ids(articles.smallest_window(rows, "ts", as_of)) == [1]
    assert ids(articles.smallest_window(rows, "ts", F.lit(dt.datetime(2024, 2, 15)))) == [1]
    assert ids(articles.smallest_window(rows, "ts", F.lit(dt.datetime(2030, 1, 1)))) == [1, 2, 3]


@pytest.mark.parametrize("alpha", [0.0, 0.3, 1.0])
def test_hybrid_search_equals_scoring_every_pair(spark, alpha):
    rng, rnd = np.random.default_rng(2), random.Random(2)
    n, k = 150, 7
    texts = [" ".join(rnd.choice(["gato", "perro", "pez", "ave"]) for _ in range(rnd.randint(1, 6))) for _ in range(n)]
    vecs, asked = rng.normal(size=(n, 6)), rng.normal(size=(3, 6))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs) if i % 4], "id long, v array<double>").repartition(5)
    queries = spark.createDataFrame([(q, w, a.tolist()) for (q, w), a in zip([(0, "gato"), (1, "nada"), (2, "pez ave")], asked)],
                                    "qid int, qtext string, qvec array<double>")
    words = {(r.qid, r.id): r.bm25 for r in search.keyword_scores(docs, "id", F.col("t"), queries).collect()}
    sims = (asked @ vecs.T) / (np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(vecs, axis=1)[None])
    out = search.search_hybrid(docs, "id", F.col("t"), table, "v", queries, k, alpha)
    got = {q: [] for q in range(3)}
    for r in out.orderBy("qid", "rango").collect():
        got[r.qid].append((r.id, r.puntuacion))
    for q in range(3):
        have = [i for i in range(n) if i % 4]
        w = {i: s for (qq, i), s in words.items() if qq == q}
        lo, hi = sims[q][have].min(), sims[q][have].max()
        wlo, whi = (min(w.values()), max(w.values())) if w else (0, 0)
        score = {}
        for i in set(have) | set(w):
            v = (sims[q][i] - lo) / (hi - lo) if i % 4 else 0.0
            b = ((w[i] - wlo) / (whi - wlo) if whi > wlo else 1.0) if i in w else 0.0
            score[i] = round(alpha * v + (1 - alpha) * b, 9)
        want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=2e-9)
        if alpha == 0.3:
            assert [i for i, _ in got[q]] == [i for i, _ in want]


def test_hybrid_search_over_vectors_sorted_by_cosine(spark):
    """Tasks far from the query have a low k-th cosine of their own; it bounds no row of the near ones."""
    rnd, n, k = random.Random(5), 400, 10
    texts = [" ".join(["gato"] * rnd.randint(0, 8) + ["pez"] * rnd.randint(1, 8)) for _ in range(n)]
    angle = np.linspace(0.0, np.pi / 2, n)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    table = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle)], "id long, v array<double>").repartitionByRange(8, "id")
    queries = spark.createDataFrame([(0, "gato", [1.0, 0.0]), (1, "gato", [0.0, 1.0])], "qid int, qtext string, qvec array<double>")
    words = {r.id: r.bm25 for r in search.keyword_scores(docs, "id", F.col("t"), queries.filter("qid = 0")).collect()}
    low, high = min(words.values()), max(words.values())
    got = search.search_hybrid(docs, "id", F.col("t"), table, "v", queries, k).orderBy("qid", "rango").collect()
    for q, sims in enumerate((np.cos(angle), np.sin(angle))):
        unit = (sims - sims.min()) / (sims.max() - sims.min())
        score = {i: 0.5 * unit[i] + (0.5 * (words[i] - low) / (high - low) if i in words else 0.0) for i in range(n)}
        want = sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        mine = [r for r in got if r.qid == q]
        assert [r.id for r in mine] == [i for i, _ in want]
        assert [r.puntuacion for r in mine] == pytest.approx([s for _, s in want], abs=2e-9)


def test_coverage_gaps_by_key(spark):
    rows = [("a", 2020, "x"), ("a", 2021, "y"), (None, 2020, "y"), (None, 2020, None)]
    df = spark.createDataFrame(rows, "provincia string, anio int, categoria string")
    got = {tuple(r) for r in facts.coverage_gaps(df, ["x", "y"], by=["provincia"]).collect()}
    assert got == {("a", 2020, "y"), ("a", 2021, "x"), (None, 2020, "x")}
    assert {tuple(r) for r in facts.coverage_gaps(df, ["x", "y"]).collect()} == {(2021, "x")}
