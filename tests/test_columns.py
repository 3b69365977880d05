"""Column functions on literal rows."""

from __future__ import annotations

import datetime as dt
import uuid
from urllib.parse import urljoin

from pyspark.sql import functions as F

from marisma.functions import numbers, text, times, urls
from marisma.sources import reports


def test_titles_and_slugs(values):
    assert values(text.normalize_title, ["El Título Está Aquí", "¿Pregunta?", "  A--b  ", None]) == [
        "el titulo esta aqui", "pregunta", "a b", ""]
    long = "palabra " * 20
    got = values(text.slugify, ["¡Hola, Mundo! -- Niño", long, "x" * 150])
    assert got[0] == "hola-mundo-nino"
    assert got[1] == "-".join(["palabra"] * 12) and len(got[1]) <= 100
    assert got[2] == "x" * 100


def test_words_and_reading_time(values):
    assert values(text.count_words, ["uno, dos_tres 4", "", None]) == [3, 0, 0]
    assert values(lambda c: text.reading_time(c), [0, 1, 200, 201], "x int") == [0, 1, 1, 2]


def test_paywall_paragraphs(spark):
    body = ("Primer párrafo.\n\n¿Quieres añadir otro usuario a tu suscripción?\n\n"
            "SI CONTINÚAS LEYENDO en este dispositivo, no se podrá leer en el otro.\n\nÚltimo.")
    df = spark.createDataFrame([(body,), ("Nada que quitar.\n\n\n\nFin ",)], "b string")
    blocks = text.paywall_blocks(F.col("b"))
    rows = df.select(F.size(blocks).alias("n"), text.strip_paywall(F.col("b"), blocks).alias("c")).collect()
    assert rows[0].n == 2 and rows[0].c == "Primer párrafo.\n\nÚltimo."
    assert rows[1].n == 0 and rows[1].c == "Nada que quitar.\n\n\n\nFin "


def test_non_article_reasons(spark):
    words = "palabra " * 130
    lines = "\n".join(["enlace corto"] * 80)
    repeated = "\n".join(["la misma entradilla larga de siempre, otra vez y otra vez sin parar nunca"] * 12)
    rows = [("uno dos", "http://x/a"), (words, "http://x/Tag/b"), (lines, "http://x/c"), (repeated, "http://x/d"), (words, None)]
    df = spark.createDataFrame(rows, "b string, u string")
    got = [r[0] for r in df.select(text.non_article_reason(F.col("b"), F.col("u"), text.count_words(F.col("b")))).collect()]
    assert got == ["too_short", "index_url_pattern:/tag/", "index_structure_bullets", "repetitive_content", None]


def test_split_body_splits_before_it_cleans(values):
    body = "Primera parte con más de cuarenta caracteres aquí.   Segunda parte también con más de cuarenta letras.\n\ncorta"
    assert values(text.split_body, [body]) == [[
        "Primera parte con más de cuarenta caracteres aquí.", "Segunda parte también con más de cuarenta letras."]]


def test_keyword_is_a_whole_word(values):
    assert values(text.contains_keyword, ["Gran INCENDIO", "incendios.", "incendiosa", "el níncendio", None]) == [
        True, True, False, False, False]


def test_reply_json(spark):
    replies = ['<think>{"no": 1}</think> {"a": 1}', 'Texto\n```json\n{"a": 2}\n```', 'pre {"a": 3} post', "nada"]
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    got = [r[0] for r in df.select(F.from_json(text.reply_json_text(F.col("r")), "a int")["a"]).collect()]
    assert got == [1, 2, 3, None]


def test_parties(values):
    got = values(text.present_parties, ['["pp", "vox"]', '{"pp": true, "psoe": null, "vox": false, "bng": "sí"}', "[]", "zzz"])
    assert got == [["pp", "vox"], ["pp", "bng"], [], []]


def test_url_checks(values):
    cases = {"": "empty_url", "elpais.com/x": "invalid_format", "https://elpais.com/espana/2024/": "truncated_year",
             "https://elpais.com/espana/": "possible_index", "https://elpais.com/a/b/c/": None, "https://elpais.com/una-noticia/": None}
    assert values(urls.url_reason, list(cases)) == list(cases.values())
    assert values(urls.extract_domain, ["https://www.abc.es:80/x", "abc.es/y", "//www.a.b/c", "", None]) == ["abc.es:80", "abc.es", "a.b", "", ""]


def test_absolute_url_agrees_with_the_standard_library(spark):
    bases = ["https://a.es/x/y.html", "http://a.es", "https://a.es/x/?q=1#f", "https://a.es/x/y/z/"]
    hrefs = ["/p", "q.html", "../r", "./s/../t", "//b.es/u", "?k=2", "#top", "https://c.es/v", "a/b?x=/../", "mailto:x@y", "w/./.."]
    rows = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(rows, "b string, h string")
    got = [r[0] for r in df.select(urls.absolute_url(F.col("b"), F.col("h"))).collect()]
    assert got == [urljoin(b, h) for b, h in rows]


def test_identities(values):
    u = ["https://elpais.com/a", "x", "ñ"]
    assert values(urls.uuid5_url, u) == [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in u]
    assert values(urls.safe_filename, ["a%20b ñ.pdf", "", "c+d.pdf", "100%.pdf"]) == ["a_b__.pdf", "archivo.pdf", "c_d.pdf", "100_.pdf"]


def test_outlets(spark):
    df = spark.createDataFrame([("elpais.com", ""), ("abc.es", "https://abc.es/Sevilla/x"), ("abc.es", "https://abc.es/x"), ("eldiario.es", "")], "d string, u string")
    got = [r.name for r in df.select(urls.outlet_of(F.col("d"), F.col("u")).alias("o")).select("o.name").collect()]
    assert got == ["El País", "ABC Sevilla", "ABC", "Eldiario"]


def test_repair_only_without_scheme(spark):
    df = spark.createDataFrame([("https://x.es/2024", "x.es", "T"), ("x.es/2024", "x.es", "Un Título"), ("", "", "T")], "u string, d string, t string")
    got = [r[0] for r in df.select(urls.repair_url(F.col("u"), F.col("d"), F.col("t"))).collect()]
    assert got == [None, "https://x.es/un-titulo.html", None]


def test_numbers(values):
    assert values(lambda c: numbers.parse_number(c, "eu"), ["1.847.648", "-0,3%", "5,2", "-", "N/A", "", None, "2,48"]) == [
        1847648.0, -0.3, 5.2, None, None, None, None, 2.48]
    assert values(lambda c: numbers.parse_number(c, "grid"), ["1.847.648,5", "5,2", "1847.5", "1.847,5"]) == [1847648.5, 5.2, 1847.5, None]
    assert values(lambda c: numbers.parse_number(c, "us"), ["1,847,648.5", "-"]) == [1847648.5, None]
    assert values(lambda c: numbers.parse_number(c, "digits"), ["5,2", "1.847.648"]) == [52.0, 1847648.0]
    v = values(numbers.parse_value_and_change, ["1.847.648 -0,3% abril - 2024", "sin datos"])
    assert (v[0].value, v[0].change) == (1847648.0, -0.3) and v[1].value is None


def test_claim_numbers_by_default_and_strict(values):
    claims = ["llegaron 2,5 millones en 2023", "1.847.648 viajeros", "2 mil", "3k y 4 M", "nada"]
    assert values(numbers.claim_numbers, claims) == [[2.5e6, 2023.0], [1.847, 648.0], [2e6], [3000.0, 4e6], []]
    assert values(lambda c: numbers.claim_numbers(c, strict=True), claims) == [[2.5e6], [1847648.0], [2000.0], [3000.0, 4e6], []]
    assert values(lambda c: numbers.primary_number(numbers.claim_numbers(c)), claims)[0] == 2.5e6
    assert values(numbers.claim_years, ["en 1999 y 2023, no 12023"]) == [["1999", "2023"]]
    assert values(numbers.claim_entities, ["El Informe de Juan Pérez y de Juan Pérez López en Jaén"]) == [["Juan Pérez", "Juan Pérez López"]]


def test_periods(values):
    d = dt.date
    got = values(times.period_from_name, ["08_x_jun25.xlsx", "z-abr2024.xlsx", "datos enero_2023", "s_202407", "nada"])
    assert got == [d(2025, 6, 1), d(2024, 4, 1), d(2023, 1, 1), d(2024, 7, 1), None]
    assert values(times.period_from_text, ["Realizado: 05/01/2024", "Realizado : 11/03/2024", "x"]) == [d(2023, 12, 1), d(2024, 3, 1), None]
    assert values(times.period_type, ["Año completo 2024", "Acumulado", "enero-abril - 2025", "abril - 2025", ""]) == [
        "anual", "acumulado", "acumulado", "mensual", "mensual"]


def test_to_utc(values):
    got = values(lambda c: times.to_utc(c).cast("string"), ["2023-02-23T05:00:00+01:00", "2024-05-01T10:00:00Z", "2024-05-01T10:00:00",
                                                           "2024-05-01 10:00:00", "2024-05-01", "1/5/2024", "01/05/2024 10:00:00", "mayo", ""])
    assert got == ["2023-02-23 04:00:00", "2024-05-01 10:00:00", "2024-05-01 10:00:00", "2024-05-01 10:00:00", "2024-05-01 00:00:00",
                   "2024-05-01 00:00:00", "2024-05-01 10:00:00", None, None]


def test_report_names(values):
    got = values(reports.parse_report_name, ["01_total_turistas_ene25.xlsx", "11_cruceros_feb24_limpio.xlsx", "20_malaga_mar25.xlsx", "x.xlsx", "01_a_zzz25.xlsx"])
    assert [(g.categoria, g.mes, g.anio, g.es_limpio) if g else None for g in got] == [
        ("total_turistas", 1, 2025, False), ("cruceros", 2, 2024, True), ("malaga", 3, 2025, False), None, None]
    b = values(reports.parse_bulletin_name, ["ultimos-datos_ene25.pdf", "ultimos-datos_ene25_2.pdf", "otros.pdf"])
    assert [(x.mes, x.anio) if x else None for x in b] == [(1, 2025), (1, 2025), None]


def test_fix_encoding_leaves_january_alone(values):
    assert values(text.fix_encoding, ["N(cid:184)mero de Ja(cid:171)n", "Jan 2024"]) == ["Número de Jaín", "Jan 2024"]


def test_page_category(values):
    assert values(text.page_category, ["Portada\nTurismo en CÁDIZ\nSEVILLA", "x", "a\nb\nc\nd\ne\nSEVILLA"]) == ["cadiz", None, None]
