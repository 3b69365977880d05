"""Corpus queries: text, URL, date and number columns, article checks, pages, duplicates, audits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catalog.base import passages, query, table
from marisma.functions import fixed_values as fv
from marisma.functions import numbers, text, times, urls
from marisma.operators import articles, audits, dedup, pages

# ---------------------------------------------------------------- SQL pieces


def sq(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def plain_title(x: str) -> str:
    return sq(f"regexp_replace(strip_accents(lower({x})), '[^a-z0-9\\s]', ' ', 'g')")


def slug(x: str) -> str:
    raw = f"regexp_replace(strip_accents(lower({x})), '[^a-z0-9\\s-]', '', 'g')"
    raw = f"regexp_replace(regexp_replace({raw}, '\\s+', '-', 'g'), '-+', '-', 'g')"
    return f"regexp_replace({raw}, '^-|-$', '', 'g')"


def n_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+'))"


def toks(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda t: t <> '')"


def visible(x: str, tags: list[str], classes: list[str] | None = None) -> str:
    out = f"regexp_replace({x}, '<!--.*?-->', ' ', 'gs')"
    for t in tags:
        out = f"regexp_replace({out}, '<{t}\\b[^>]*>.*?</{t}>', ' ', 'gis')"
    if classes:
        alt = "|".join(classes)
        out = f"""regexp_replace({out}, '<div\\b[^>]*class="(?:[^"]* )?(?:{alt})(?: [^"]*)?"[^>]*>.*?</div>', ' ', 'gis')"""
    out = f"regexp_replace({out}, '<[^>]+>', ' ', 'g')"
    return sq(f"regexp_replace({out}, '&[a-zA-Z0-9]+;', '', 'g')")


TITLE = "regexp_extract(text, '^[^.\\n]*', 0)"
HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"
DROP = fv.PAGE_DROP_TAGS


def title_col():
    return F.regexp_extract("text", r"^[^.\n]*", 0)


def docs(spark, d):
    return table(spark, d, "documents")


# ---------------------------------------------------------------- text columns

@query("F01_normalize_title", f"SELECT doc_id, {plain_title(TITLE)} AS titulo FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", text.normalize_title(title_col()).alias("titulo"))


@query("F01_normalize_whole_text", f"SELECT doc_id, md5({plain_title('text')}) AS h FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.md5(text.normalize_title(F.col("text"))).alias("h"))


@query("F02_slugify", f"""
SELECT doc_id, CASE WHEN length(s) > 100 THEN regexp_replace(s[:100], '-[^-]*$', '') ELSE s END AS slug
FROM (SELECT doc_id, {slug('text')} AS s FROM documents)
""")
def _(spark, d):
    return docs(spark, d).select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query("F03_count_words", f"SELECT doc_id, {n_words('text')} AS palabras FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", text.count_words(F.col("text")).alias("palabras"))


@query("F04_reading_time", f"""
SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE greatest(1, CAST(ceil(n / 200) AS INT)) END AS minutos FROM (SELECT doc_id, {n_words('text')} AS n FROM documents)
""")
def _(spark, d):
    return docs(spark, d).select("doc_id", text.reading_time(text.count_words(F.col("text"))).alias("minutos"))


@query("F05_fix_encoding", "SELECT doc_id, md5(text) AS h, contains(text, 'í') AS tiene FROM documents")
def _(spark, d):
    broken = F.col("text")
    for bad, good in fv.GLYPH_FIXES:
        broken = F.replace(broken, F.lit(good), F.lit(bad))
    fixed = text.fix_encoding(broken)
    return docs(spark, d).select("doc_id", F.md5(fixed).alias("h"), F.contains(fixed, F.lit("í")).alias("tiene"))


@query("F06_clean_text", f"""
SELECT page_id, nullif({sq("regexp_extract(html, '<footer>(.*?)</footer>', 1, 's')")}, '') AS pie FROM pages
""")
def _(spark, d):
    return table(spark, d, "pages").select(
        "page_id", text.clean_text(F.regexp_extract("html", r"(?s)<footer>(.*?)</footer>", 1)).alias("pie")
    )


@query("F07_normalize_pdf_text", "SELECT doc_id, md5(regexp_replace(lower(strip_accents(replace(text, '.', '.'))), '\\s+', ' ', 'g')) AS h FROM documents")
def _(spark, d):
    glyphs = F.replace("text", F.lit("."), F.lit("·"))
    return docs(spark, d).select("doc_id", F.md5(text.normalize_pdf_text(glyphs)).alias("h"))


@query("F08_split_and_join_body", f"""
SELECT doc_id, len(p) AS n, md5(array_to_string(p, chr(10) || chr(10))) AS h FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(replace(text, chr(10), chr(10) || chr(10)),
    '\\n{{2,}}', chr(1), 'g'), '\\.\\s{{2,}}', '.' || chr(1), 'g'), chr(1)), lambda x: {sq('x')}), lambda x: length(x) >= 40) AS p FROM documents)
""")
def _(spark, d):
    parts = text.split_body(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return docs(spark, d).select("doc_id", F.size(parts).alias("n"), F.md5(text.join_body(parts)).alias("h"))


@query("F09_truncation", """
SELECT doc_id, text[:8000] AS cuerpo, CASE WHEN length(text) > 300 THEN text[:300] || '...' ELSE text END AS vista,
  text[:500] AS titulo, text[:200] AS autor, text[:100] AS formato FROM documents
""")
def _(spark, d):
    return docs(spark, d).select(
        "doc_id", F.substring("text", 1, fv.TRUNCATION["prompt_body"]).alias("cuerpo"),
        text.truncate(F.col("text"), fv.TRUNCATION["display"], "...").alias("vista"),
        *[F.substring("text", 1, fv.TRUNCATION[k]).alias(name) for k, name in (("title", "titulo"), ("author", "autor"), ("format", "formato"))],
    )


# ---------------------------------------------------------------- URLs

_URLS = """
WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?://', '')
  WHEN 2 THEN regexp_extract(url, '^https?://[^/]*', 0) || '/2024/' WHEN 3 THEN regexp_extract(url, '^https?://[^/]*/[a-z]*', 0) || '/'
  WHEN 4 THEN replace(replace(url, '.example.org', '.gob.es'), '.example.net', '.abc.es') ELSE replace(url, '.html', '') END AS url FROM pages)
"""


def variants(spark, d):
    u, k = F.col("url"), F.col("page_id") % 6
    spelled = (
        F.when(k == 0, u).when(k == 1, F.regexp_replace(u, "^https?://", ""))
        .when(k == 2, F.concat(F.regexp_extract(u, "^https?://[^/]*", 0), F.lit("/2024/")))
        .when(k == 3, F.concat(F.regexp_extract(u, "^https?://[^/]*/[a-z]*", 0), F.lit("/")))
        .when(k == 4, F.replace(F.replace(u, F.lit(".example.org"), F.lit(".gob.es")), F.lit(".example.net"), F.lit(".abc.es")))
        .otherwise(F.replace(u, F.lit(".html"), F.lit("")))
    )
    return table(spark, d, "pages").select("page_id", spelled.alias("url"))


_REASON = """CASE WHEN url = '' THEN 'empty_url' WHEN NOT regexp_matches(url, '^https?://[A-Za-z0-9.\\-]+(:[0-9]+)?/.*$') THEN 'invalid_format'
  WHEN regexp_matches(url, '/\\d{4}/?$') THEN 'truncated_year'
  WHEN url LIKE '%/' AND NOT (contains(url, '.html') OR contains(url, '.php') OR contains(url, '-')) AND len(string_split(rtrim(url, '/'), '/')) <= 4 THEN 'possible_index' END"""


@query("P12_validate_url", _URLS + f"SELECT page_id, url, ({_REASON}) IS NULL AS ok, {_REASON} AS reason FROM u")
def _(spark, d):
    return variants(spark, d).withColumn("v", urls.validate_url(F.col("url"))).select("page_id", "url", "v.ok", "v.reason")


@query("P13_truncated_url", _URLS + """
SELECT page_id, url = '' OR NOT regexp_matches(url, '^https?://') OR regexp_matches(url, '/\\d{4}/?$') OR length(url) < 30 AS truncada FROM u
""")
def _(spark, d):
    return variants(spark, d).select("page_id", urls.is_truncated_url(F.col("url")).alias("truncada"))


_DOMAIN = "regexp_replace(CASE WHEN contains(url, '://') THEN regexp_extract(url, '://([^/?#]*)', 1) ELSE regexp_extract(url, '^([^/?#]*)', 1) END, '^www\\.', '')"


@query("F10_extract_domain", _URLS + f"SELECT page_id, {_DOMAIN} AS dominio FROM u")
def _(spark, d):
    return variants(spark, d).select("page_id", urls.extract_domain(F.col("url")).alias("dominio"))


_BARE = "replace(replace(dominio, '.es', ''), '.com', '')"


@query("F11_outlet", _URLS + f"""
, m AS (SELECT page_id, replace(url, '/es/', '/Sevilla/') AS url, CASE page_id % 5 WHEN 0 THEN 'elpais.com' WHEN 1 THEN 'abc.es' WHEN 2 THEN 'abc.es' ELSE dominio END AS dominio
  FROM (SELECT page_id, url, {_DOMAIN} AS dominio FROM u))
SELECT page_id, CASE WHEN dominio = 'elpais.com' THEN 'El País' WHEN dominio = 'abc.es' THEN CASE WHEN contains(lower(url), '/sevilla/') THEN 'ABC Sevilla' ELSE 'ABC' END
  ELSE upper({_BARE}[1]) || lower({_BARE}[2:]) END AS nombre,
  CASE WHEN dominio = 'elpais.com' THEN 'https://elpais.com/?ed=es' WHEN dominio = 'abc.es' AND contains(lower(url), '/sevilla/') THEN 'https://www.abc.es/sevilla/'
  WHEN dominio = 'abc.es' THEN 'https://www.abc.es/' ELSE 'https://' || dominio || '/' END AS portada FROM m
""")
def _(spark, d):
    k = F.col("page_id") % 5
    domain = F.when(k == 0, F.lit("elpais.com")).when(k.isin(1, 2), F.lit("abc.es")).otherwise(urls.extract_domain(F.col("url")))
    out = urls.outlet_of(domain, F.replace("url", F.lit("/es/"), F.lit("/Sevilla/")))
    return variants(spark, d).select("page_id", out["name"].alias("nombre"), out["home_url"].alias("portada"))


@query("F12_country_and_zone", _URLS + f"""
SELECT page_id, CASE WHEN es THEN 'ES' END AS pais, CASE WHEN es THEN 'Europe/Madrid' END AS zona FROM (SELECT page_id, {_DOMAIN} LIKE '%.es' AS es FROM u)
""")
def _(spark, d):
    dom = urls.extract_domain(F.col("url"))
    return variants(spark, d).select("page_id", urls.domain_country(dom).alias("pais"), urls.domain_time_zone(dom).alias("zona"))


@query("F13_repair_url", _URLS + f"""
, s AS (SELECT page_id, u.url, {_DOMAIN.replace('url', 'u.url')} AS dominio, {slug("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS slug FROM u JOIN pages USING (page_id))
SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://') AND slug <> '' THEN 'https://' || dominio || '/' ||
  CASE WHEN length(slug) > 100 THEN regexp_replace(slug[:100], '-[^-]*$', '') ELSE slug END || '.html' END AS reparada FROM s
""")
def _(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    rows = variants(spark, d).join(table(spark, d, "pages").select("page_id", title.alias("titulo")), "page_id")
    return rows.select("page_id", urls.repair_url(F.col("url"), urls.extract_domain(F.col("url")), F.col("titulo")).alias("reparada"))


@query("F14_absolute_url", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN regexp_extract(url, '^https?://[^/]*', 0) || '/a/b.html' WHEN 1 THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || 'c.html'
 WHEN 2 THEN regexp_extract(url, '^https?:', 0) || '//otro.es/d' WHEN 3 THEN regexp_replace(url, '#.*$', '') || '#abajo' ELSE regexp_extract(url, '^https?://[^/]*', 0) || '/e?x=1' END AS absoluta FROM pages
""")
def _(spark, d):
    k = F.col("page_id") % 5
    href = (
        F.when(k == 0, F.lit("/a/./z/../b.html")).when(k == 1, F.lit("c.html")).when(k == 2, F.lit("//otro.es/d"))
        .when(k == 3, F.lit("#abajo")).otherwise(F.lit("/../../e?x=1"))
    )
    return table(spark, d, "pages").select("page_id", urls.absolute_url(F.col("url"), href).alias("absoluta"))


@query("F15_safe_filename", """
SELECT page_id, coalesce(nullif(regexp_replace(replace(trim(url_decode(n)), ' ', '_'), '[^A-Za-z0-9._-]+', '_', 'g'), ''), 'archivo.pdf') AS nombre
FROM (SELECT page_id, replace(regexp_extract(url, '^https?://[^/]*/(.*)$', 1), '/', '%20') || '%C3%B1.pdf' AS n FROM pages)
""")
def _(spark, d):
    raw = F.concat(F.replace(F.regexp_extract("url", "^https?://[^/]*/(.*)$", 1), F.lit("/"), F.lit("%20")), F.lit("%C3%B1.pdf"))
    return table(spark, d, "pages").select("page_id", urls.safe_filename(raw).alias("nombre"))


@query("P22_route_by_pattern", """
SELECT page_id, CASE WHEN contains(url, '://blog.') THEN 'blog' WHEN contains(url, '://m.') THEN 'movil' WHEN contains(url, '/es/') THEN 'es' ELSE 'otro' END AS ruta FROM pages
""")
def _(spark, d):
    return table(spark, d, "pages").select(
        "page_id",
        text.first_route(F.col("url"), [("://blog.", "blog"), ("://m.", "movil"), ("/es/", "es")], "otro").alias("ruta"),
    )


_PRESS = "CASE page_id % 6 WHEN 0 THEN 'https://www.DiarioDeSevilla.es/' WHEN 1 THEN 'https://elpais.com/espana/' WHEN 2 THEN 'https://elcorreoweb.es/andalucia/' WHEN 3 THEN 'https://eldiario.es/andalucia/' WHEN 4 THEN 'https://www.ideal.es/' ELSE 'https://otro.es/' END || url"


@query("P22_newspaper_route", f"""
SELECT page_id, CASE WHEN contains(u, 'diariodesevilla.es') THEN 'diariodesevilla' WHEN contains(u, 'elpais.com/espana/') THEN 'elpais' WHEN contains(u, 'elcorreoweb.es/andalucia') THEN 'elcorreoweb'
  WHEN contains(u, 'eldiario.es/andalucia/') THEN 'eldiario' WHEN contains(u, 'www.ideal.es') THEN 'ideal' END AS periodico,
 CASE WHEN contains(u, 'elcorreoweb.es/andalucia') THEN 'El Correo Web' WHEN contains(u, 'diariodesevilla.es') THEN 'Diario de Sevilla' ELSE 'abc_diariosur' END AS origen
FROM (SELECT page_id, lower({_PRESS}) AS u FROM pages)
""".replace("'Diario de Sevilla'", "'" + dict(fv.ORIGIN_ROUTES)["diariodesevilla.es"] + "'"))
def _(spark, d):
    u = F.expr(_PRESS)
    return table(spark, d, "pages").select("page_id", text.newspaper_route(u).alias("periodico"), text.origin_name(u).alias("origen"))


@query("P24_no_result", """
SELECT conv_id, turn, regexp_matches(lower(t), 'no he encontrado|no se encontraron|no dispongo de noticias|no hay noticias|no se hallaron') AS vacia
FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN 'No hay noticias de ' WHEN 3 THEN 'Lo siento, NO SE HALLARON resultados: ' ELSE '' END || text AS t FROM conversations)
""")
def _(spark, d):
    k = F.col("turn") % 4
    reply = F.concat(F.when(k == 1, F.lit("No hay noticias de ")).when(k == 3, F.lit("Lo siento, NO SE HALLARON resultados: ")).otherwise(F.lit("")), "text")
    return table(spark, d, "conversations").select("conv_id", "turn", text.is_no_result(reply).alias("vacia"))


@query("P22_query_intent", """
SELECT conv_id, turn, CASE WHEN regexp_matches(t, 'historicos|historical|museums|monuments|culture|patrimonio') THEN 'historical'
  WHEN regexp_matches(t, 'dias|days|itinerary|trip|viaje|ruta|visit') THEN 'travel'
  WHEN regexp_matches(t, 'price|cost|tiempo|time|hora|when|cuanto') THEN 'factual'
  WHEN regexp_matches(t, 'como|how|que es|what is|explain|funciona') THEN 'educational' ELSE 'general' END AS intencion
FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)
""")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.query_intent(F.col("text")).alias("intencion"))


@query("P23_official_source", _URLS + """
SELECT page_id, regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '(\\.gob\\.es|\\.gov|\\.gov\\.es|\\.eu|\\.edu)$') AS oficial FROM u
""")
def _(spark, d):
    return variants(spark, d).select("page_id", urls.is_official_source(F.col("url")).alias("oficial"))


@query("F34_stable_id", """
SELECT page_id, 'sha1:' || sha1(url || '|' || coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') || '|') AS id FROM pages
""")
def _(spark, d):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, d, "pages").select("page_id", urls.stable_id(F.col("url"), title, F.lit(None).cast("string")).alias("id"))


@query("F35_identities", """
SELECT page_id, md5(url)[:8] AS corto, sha256(url) AS clave, u[:8] || '-' || u[9:12] || '-5' || u[14:16] || '-' ||
  (['8','9','a','b','8','9','a','b','8','9','a','b','8','9','a','b'])[position(u[17] IN '0123456789abcdef')] || u[18:20] || '-' || u[21:32] AS uuid
FROM (SELECT page_id, url, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS u FROM pages)
""")
def _(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", urls.short_hash(u).alias("corto"), urls.payload_key(u).alias("clave"), urls.uuid5_url(u).alias("uuid")
    )


# ---------------------------------------------------------------- dates and numbers

@query("F16_to_utc", """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN date_trunc('second', ts) - INTERVAL 1 HOUR WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN CAST(ts AS DATE)::TIMESTAMP
  WHEN 3 THEN date_trunc('second', ts) WHEN 4 THEN CAST(ts AS DATE)::TIMESTAMP WHEN 5 THEN date_trunc('second', ts) END AS utc FROM events
""")
def _(spark, d):
    k = F.col("event_id") % 7

    def fmt(pattern):
        return F.date_format("ts", pattern)

    spelled = (
        F.when(k == 0, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00"))).when(k == 1, fmt("yyyy-MM-dd HH:mm:ss"))
        .when(k == 2, fmt("yyyy-MM-dd")).when(k == 3, fmt("dd/MM/yyyy HH:mm:ss")).when(k == 4, fmt("d/M/yyyy"))
        .when(k == 5, F.concat(fmt("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).otherwise(fmt("MMM yyyy"))
    )
    return table(spark, d, "events").select("event_id", times.to_utc(spelled).cast("timestamp_ntz").alias("utc"))


@query("F17_time_parts", """
SELECT event_id, year(ts) AS "year", month(ts) AS "month", day(ts) AS "day", weekofyear(ts) AS iso_week FROM events
""")
def _(spark, d):
    return table(spark, d, "events").withColumn("p", times.time_parts(F.col("ts"))).select("event_id", "p.*")


@query("F18_null_time", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE event_type END AS valor FROM events
""")
def _(spark, d):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.lit("")).when(k == 1, F.lit("0")).otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", times.null_time(raw).alias("valor"))


@query("F23_period_type", """
SELECT event_id, (['anual','acumulado','acumulado','mensual','mensual'])[event_id % 5 + 1] AS periodo FROM events
""")
def _(spark, d):
    month = times.month_name(F.month("ts"))
    year = F.year("ts").cast("string")
    k = F.col("event_id") % 5
    spelled = (
        F.when(k == 0, F.concat(F.lit("Año completo "), year)).when(k == 1, F.concat(F.lit("Acumulado "), month))
        .when(k == 2, F.concat(month, F.lit("-abril - "), year)).when(k == 3, F.concat(month, F.lit(" - "), year))
        .otherwise(F.lit(""))
    )
    return table(spark, d, "events").select("event_id", times.period_type(spelled).alias("periodo"))


@query("F25_parse_number", """
SELECT l_orderkey, l_linenumber, l_extendedprice AS eu, l_extendedprice AS us, CAST(round(l_extendedprice * 100) AS DOUBLE) AS digits,
  CASE WHEN l_extendedprice >= 1000000 OR l_extendedprice < 1000 THEN l_extendedprice END AS grid, NULL AS vacio FROM lineitem
""")
def _(spark, d):
    us = F.format_number(F.col("l_extendedprice"), 2)
    eu = F.translate(us, ",.", ".,")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", us.alias("a"), eu.alias("b"))
    return rows.select(
        "l_orderkey", "l_linenumber",
        numbers.parse_number(F.col("b"), "eu").alias("eu"), numbers.parse_number(F.col("a"), "us").alias("us"),
        numbers.parse_number(F.col("b"), "digits").alias("digits"),
        # one group dot and a comma: the grid policy turns it into two decimal points, which is no number
        numbers.parse_number(F.col("b"), "grid").alias("grid"),
        numbers.parse_number(F.lit("-"), "eu").alias("vacio"),
    )


@query("F26_value_and_change", """
SELECT l_orderkey, l_linenumber, l_extendedprice AS valor, CASE WHEN l_linenumber % 2 = 0 THEN -l_discount ELSE l_discount END + CAST(0 AS DOUBLE) AS cambio FROM lineitem
""")
def _(spark, d):
    def eu(c):
        return F.translate(F.format_number(c, 2), ",.", ".,")

    sign = F.when(F.col("l_linenumber") % 2 == 0, F.lit("-")).otherwise(F.lit("+"))
    spelled = F.concat(eu(F.col("l_extendedprice")), F.lit(" "), sign, eu(F.col("l_discount")), F.lit("% abril - 2024"))
    v = numbers.parse_value_and_change(spelled)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", v["value"].alias("valor"), (v["change"] + F.lit(0.0)).alias("cambio"))


_CLAIM_NUM = "regexp_extract_all(text, '(?i)\\d+[.,]?\\d*(?:\\s*(?:millones|millón|m|k))?')"
_NUM_VALUE = """TRY_CAST(trim(regexp_replace(replace(lower(x), ',', '.'), '(millones|millón|m|k)$', '')) AS DOUBLE)
  * CASE WHEN contains(lower(x), 'mill') OR lower(x) LIKE '%m' THEN 1e6 WHEN lower(x) LIKE '%k' THEN 1e3 ELSE 1 END"""


@query("F28_claim_numbers", f"""
SELECT doc_id, len(v) AS n, CASE WHEN len(v) > 0 THEN v[list_position(list_transform(v, lambda y: abs(y)), list_max(list_transform(v, lambda y: abs(y))))] END AS principal
FROM (SELECT doc_id, list_filter(list_transform({_CLAIM_NUM}, lambda x: {_NUM_VALUE}), lambda y: y IS NOT NULL) AS v FROM documents)
""")
def _(spark, d):
    values = numbers.claim_numbers(F.col("text"))
    return docs(spark, d).select("doc_id", values.alias("v")).select(
        "doc_id", F.size("v").alias("n"), numbers.primary_number(F.col("v")).alias("principal"))


@query("F29_claim_years", "SELECT doc_id, array_to_string(regexp_extract_all(text, '\\b((?:19|20)\\d{2})\\b', 1), ',') AS anios FROM documents")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(numbers.claim_years(F.col("text")), ",").alias("anios"))


_ENT = "[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)*"


@query("F30_claim_entities", f"""
SELECT DISTINCT doc_id, e AS entidad FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_ENT}')) AS e FROM documents)
WHERE regexp_matches(e, '\\s') AND lower(e) <> 'el informe'
""")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.explode(numbers.claim_entities(F.col("text"))).alias("entidad"))


@query("F31_claim_type", f"""
SELECT doc_id, CASE WHEN len({_CLAIM_NUM}) > 0 THEN 'numeric' WHEN regexp_matches(text, '\\b(?:19|20)\\d{{2}}\\b') THEN 'temporal' ELSE 'factual' END AS tipo FROM documents
""")
def _(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", numbers.claim_type(numbers.claim_numbers(t), numbers.claim_years(t)).alias("tipo"))


@query("F32_coverage_label", """
SELECT event_id, CASE WHEN s > 0.2 THEN 'positive' WHEN s < -0.2 THEN 'negative' ELSE 'neutral' END AS etiqueta FROM (SELECT event_id, value / 50 - 1 AS s FROM events)
""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", numbers.coverage_label(F.col("value") / 50 - 1).alias("etiqueta"))


@query("F33_color_ramp", """
SELECT event_id, round(1.0 + (0.835 - 1.0) * x, 9) AS r, round(0.65 + (0.0 - 0.65) * x, 9) AS g, round(0.0 * x, 9) AS b
FROM (SELECT event_id, greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 100)) AS x FROM events)
""")
def _(spark, d):
    rgb = numbers.reach_color(F.col("value"))
    return table(spark, d, "events").select("event_id", *[F.round(rgb[c], 9).alias(c) for c in "rgb"])


# ---------------------------------------------------------------- article checks

_P14_URL = "'https://' || source || '.example.es/' || CASE WHEN source = 'src3' THEN 'autor/' WHEN source = 'src4' THEN 'Tag/' ELSE '' END || doc_id"
_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')"


def _p14_url():
    extra = F.when(F.col("source") == "src3", F.lit("autor/")).when(F.col("source") == "src4", F.lit("Tag/")).otherwise(F.lit(""))
    return F.concat(F.lit("https://"), "source", F.lit(".example.es/"), extra, F.col("doc_id").cast("string"))


@query("P14_non_article", f"""
SELECT doc_id, motivo IS NOT NULL AS excluido, motivo FROM (SELECT doc_id, CASE WHEN w < 120 THEN 'too_short'
  WHEN contains(lower(url), '/tag/') THEN 'index_url_pattern:/tag/' WHEN contains(url, '/autor/') THEN 'index_url_pattern:/autor/'
  WHEN len(l) > 20 AND len(list_filter(l, lambda x: length(x) < 50)) / len(l) > 0.7 THEN 'index_structure_bullets'
  WHEN len(l) > 10 AND len(list_distinct(list_transform(list_filter(l, lambda x: length(x) > 20), lambda x: x[:20]))) < len(l) * 0.3 THEN 'repetitive_content' END AS motivo
  FROM (SELECT doc_id, {n_words('text')} AS w, {_P14_URL} AS url, {_LINES} AS l FROM documents))
""")
def _(spark, d):
    t = F.col("text")
    reason = text.non_article_reason(t, _p14_url(), text.count_words(t))
    return docs(spark, d).select("doc_id", reason.alias("motivo")).withColumn("excluido", F.col("motivo").isNotNull())


_PAYWALLED = """(SELECT doc_id, CASE WHEN lang = 'es' THEN b || chr(10) || chr(10) || 'HAZTE SUSCRIPTOR ahora' || chr(10) || chr(10) || chr(10) || 'fin'
  WHEN lang = 'fr' THEN 'Regístrate gratis hoy' || chr(10) || chr(10) || b ELSE b END AS body FROM (SELECT doc_id, lang, replace(text, chr(10), chr(10) || chr(10)) AS b FROM documents))"""


def _paywalled(spark, d):
    b = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    body = (
        F.when(F.col("lang") == "es", F.concat(b, F.lit("\n\nHAZTE SUSCRIPTOR ahora\n\n\nfin")))
        .when(F.col("lang") == "fr", F.concat(F.lit("Regístrate gratis hoy\n\n"), b)).otherwise(b)
    )
    return docs(spark, d).select("doc_id", body.alias("body"))


@query("P15_paywall_blocks", f"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(10))),
  lambda x: regexp_matches(x, '(?i)hazte suscriptor|regístrate gratis')), '|') AS bloques FROM {_PAYWALLED}
""")
def _(spark, d):
    return _paywalled(spark, d).select("doc_id", F.array_join(text.paywall_blocks(F.col("body")), "|").alias("bloques"))


@query("P16_strip_paywall", f"""
SELECT doc_id, md5(CASE WHEN contains(body, 'HAZTE SUSCRIPTOR ahora') OR contains(body, 'Regístrate gratis hoy') THEN
  trim(regexp_replace(replace(replace(body, 'HAZTE SUSCRIPTOR ahora', ''), 'Regístrate gratis hoy', ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) ELSE body END) AS h FROM {_PAYWALLED}
""")
def _(spark, d):
    b = F.col("body")
    return _paywalled(spark, d).select("doc_id", F.md5(text.strip_paywall(b, text.paywall_blocks(b))).alias("h"))


@query("P18_contains_keyword", """
SELECT doc_id, regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])with(s)?($|[^\\p{L}\\p{N}_])') AS aparece FROM documents
""")
def _(spark, d):
    return docs(spark, d).select("doc_id", text.contains_keyword(F.col("text"), "with(s)?").alias("aparece"))


@query("P19_is_blank", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN true WHEN doc_id % 5 = 1 THEN true ELSE trim(text, ' ' || chr(10) || chr(9)) = '' END AS vacio FROM documents
""")
def _(spark, d):
    k = F.col("doc_id") % 5
    body = F.when(k == 0, F.lit(None)).when(k == 1, F.lit(" \n\t ")).otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", text.is_blank(body).alias("vacio"))


@query("P24_text_flags", f"""
SELECT doc_id, contains(l, 'no coincide') OR contains(l, 'contradic') OR contains(l, 'desmentido') OR contains(l, 'no hay evidencia') OR contains(l, 'no se hallaron') OR contains(l, 'no se encontró evidencia') AS contradice,
  regexp_matches(l, 'última|ultimas|último|recientes|actualidad') AS reciente,
  array_to_string(list_filter(['según','de acuerdo','con base en','informe','estudio','ministerio'], lambda w: contains(l, w)), ',') AS citas,
  len(list_filter({toks('text')}, lambda t: t IN ('the','para') OR t LIKE 'tion%')) > 0 AS etiqueta
FROM (SELECT doc_id, text, lower(text) AS l FROM documents)
""")
def _(spark, d):
    t = F.col("text")
    tags = text.domain_tags(t, F.lit(""), ["the", "para"], ["tion"], "x")
    return docs(spark, d).select(
        "doc_id", text.is_contradiction(t).alias("contradice"), text.wants_latest(t).alias("reciente"),
        F.array_join(text.cited_source_words(t), ",").alias("citas"), (F.size(tags) > 0).alias("etiqueta"))


# ---------------------------------------------------------------- articles

@query("P01_coalesce_fields", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://o/' || page_id WHEN page_id % 3 = 1 THEN url ELSE '' END AS url,
  CASE WHEN page_id % 2 = 0 THEN ' ' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title FROM pages
""")
def _(spark, d):
    k3, k2 = F.col("page_id") % 3, F.col("page_id") % 2
    raw = table(spark, d, "pages").select(
        "page_id",
        F.when(k3 == 0, F.lit("")).when(k3 == 1, F.col("url")).alias("url"),
        F.when(k3 == 0, F.concat(F.lit("https://o/"), F.col("page_id").cast("string"))).alias("link"),
        F.when(k2 == 0, F.lit(" ")).otherwise(F.lit("")).alias("title"),
        F.struct(F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")).alias("text"),
    )
    return articles.coalesce_fields(raw).select("page_id", "url", "title")


@query("P03_search_record", f"""
SELECT CASE WHEN doc_id % 4 = 0 THEN '' ELSE {TITLE} END AS title, array_to_string(string_split(text, chr(10)), chr(10) || chr(10)) AS body, source,
  'https://x.es/' || doc_id AS "sourceUrl", CASE WHEN doc_id % 2 = 0 THEN doc_id % 10 END AS depth, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2023-02-23 04:00:00' WHEN doc_id % 3 = 1 THEN TIMESTAMP '2024-03-09' END AS "publishedAt"
FROM documents WHERE text <> '' OR (doc_id % 4 <> 0 AND {TITLE} <> '')
""")
def _(spark, d):
    k = F.col("doc_id")
    raw = docs(spark, d).select(
        F.when(k % 4 != 0, title_col()).alias("titulo"), F.lit(None).cast("string").alias("subtitulo"), F.lit(None).cast("string").alias("autor"),
        F.when(k % 3 == 0, F.lit("2023-02-23T05:00:00+01:00")).when(k % 3 == 1, F.lit("09-03-2024")).otherwise(F.lit("ayer")).alias("fecha"),
        F.split("text", "\n").alias("contenido"), F.col("source").alias("fuente"),
        F.concat(F.lit("https://x.es/"), k.cast("string")).alias("url"),
        F.when(k % 2 == 0, (k % 10).cast("string")).otherwise(F.lit("x1")).alias("depth"),
    )
    return articles.to_search_record(raw).select(
        "title", "body", "source", "sourceUrl", "depth", F.col("publishedAt").cast("timestamp_ntz").alias("publishedAt"))


_EV = "(SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE ts END AS ts FROM events)"


def _dated(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("ts")).alias("ts"))


@query("P09_crawl_recent", f"SELECT event_id, ts FROM {_EV} WHERE ts IS NULL OR ts >= (SELECT max(ts) FROM {_EV}) - INTERVAL 10 DAY")
def _(spark, d):
    rows = _dated(spark, d)
    return articles.crawl_recent(rows, "ts", articles.as_of_max(rows), 10)


@query("P09_enrich_recent", f"""
SELECT event_id, ts FROM {_EV} WHERE ts IS NULL OR floor((epoch(date_trunc('second', (SELECT max(ts) FROM {_EV}))) - epoch(date_trunc('second', ts))) / 86400) <= 5
""")
def _(spark, d):
    rows = _dated(spark, d)
    return articles.enrich_recent(rows, "ts", articles.as_of_max(rows), 5)


@query("P09_search_recent", f"SELECT event_id, ts FROM {_EV} WHERE ts >= (SELECT max(ts) FROM {_EV}) - INTERVAL 7 DAY")
def _(spark, d):
    rows = _dated(spark, d)
    return articles.search_recent(rows, "ts", articles.as_of_max(rows))


@query("P09_search_nothing_recent", f"SELECT event_id, ts FROM {_EV}")
def _(spark, d):
    rows = _dated(spark, d)
    return articles.search_recent(rows, "ts", articles.as_of_max(rows) + F.expr("interval 40 days"))


@query("P10_smallest_window", f"""
SELECT event_id, ts FROM {_EV} WHERE ts >= date_trunc('day', (SELECT max(ts) FROM {_EV}) + INTERVAL 10 DAY - INTERVAL 21 DAY)
""")
def _(spark, d):
    rows = _dated(spark, d)
    return articles.smallest_window(rows, "ts", articles.as_of_max(rows) + F.expr("interval 10 days"))


@query("P11_valid_article", f"""
SELECT page_id, title <> '' AND body <> '' AS es_noticia_valida FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' ELSE regexp_extract(html, '<h1>([^<]*)</h1>', 1) END AS title,
  {visible('html', DROP)} AS body FROM pages)
""")
def _(spark, d):
    rows = table(spark, d, "pages").select(
        "page_id", F.when(F.col("page_id") % 4 != 0, F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("title"),
        pages.strip_markup(F.col("html"), DROP).alias("body"))
    return articles.mark_valid(rows).select("page_id", "es_noticia_valida")


@query("P25_unprocessed", "SELECT doc_id, source FROM documents WHERE lang <> 'fr' AND doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    rows = docs(spark, d).withColumn("radar", F.when(F.col("lang") == "fr", F.lit(1)))
    return articles.unprocessed(rows, table(spark, d, "labels"), "doc_id", "radar").select("doc_id", "source")


_K14 = f"""
WITH raw AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(url, '^https?://', '') WHEN 1 THEN replace(url, '.example.org', '.abc.es') WHEN 2 THEN '' ELSE url END AS url,
    regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, {visible('html', DROP)} AS b,
    CASE page_id % 3 WHEN 0 THEN '2024-02-10T05:30:00+01:00' WHEN 1 THEN 'sin fecha' ELSE '' END AS date FROM pages),
  r AS (SELECT *, {_DOMAIN} AS domain, {_REASON} AS why, {n_words('b')} AS w, page_id % 5 = 0 AS pw FROM raw),
  s AS (SELECT *, CASE WHEN w < 120 THEN 'too_short' END AS excluded FROM r)
SELECT page_id, domain, 'sha1:' || sha1(CASE WHEN why IS NULL THEN url WHEN url <> '' THEN domain ELSE 'unknown' END || '|' || title || '|' || date) AS id,
  CASE WHEN date LIKE '2024%' THEN TIMESTAMP '2024-02-10 04:30:00' END AS published_utc, CASE WHEN date LIKE '2024%' THEN 6 END AS iso_week,
  CASE WHEN domain LIKE '%.es' THEN 'ES' END AS country, {plain_title('title')} AS title_norm, md5(b) AS cuerpo, w AS word_count,
  CASE WHEN w = 0 THEN 0 ELSE greatest(1, CAST(ceil(w / 200) AS INT)) END AS reading_time_min, excluded IS NULL AS es_noticia_valida, excluded AS excluded_reason,
  CASE WHEN why IS NOT NULL THEN 'low' END AS id_confidence, CASE WHEN pw THEN true END AS paywall, why IS NOT NULL OR pw AS fixed,
  array_to_string(list_filter([CASE WHEN why IS NOT NULL THEN 'url_invalid:' || why END, CASE WHEN excluded IS NOT NULL THEN 'non_article_index:' || excluded END], lambda x: x IS NOT NULL), ';') AS errores,
  array_to_string(list_filter([CASE WHEN pw THEN 'paywall_overlay_stripped' END, CASE WHEN why IS NOT NULL THEN 'id_uses_domain_fallback' END,
    CASE WHEN date = 'sin fecha' THEN 'no_publish_time' END], lambda x: x IS NOT NULL), ';') AS avisos
FROM s
"""


def _k14(spark, d):
    k, u = F.col("page_id"), F.col("url")
    body = pages.strip_markup(F.col("html"), DROP)
    raw = table(spark, d, "pages").select(
        "page_id",
        F.when(k % 4 == 0, F.regexp_replace(u, "^https?://", "")).when(k % 4 == 1, F.replace(u, F.lit(".example.org"), F.lit(".abc.es")))
        .when(k % 4 == 2, F.lit("")).otherwise(u).alias("url"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.when(k % 5 == 0, F.concat(body, F.lit("\n\nHazte suscriptor"))).otherwise(body).alias("body"),
        F.when(k % 3 == 0, F.lit("2024-02-10T05:30:00+01:00")).when(k % 3 == 1, F.lit("sin fecha")).otherwise(F.lit("")).alias("date"),
    )
    return articles.enrich_static(raw)


@query("K14_enrich_static", _K14)
def _(spark, d):
    return _k14(spark, d).select(
        "page_id", "domain", "id", F.col("published_utc").cast("timestamp_ntz").alias("published_utc"), "iso_week", "country", "title_norm",
        F.md5("body_plain").alias("cuerpo"), "word_count", "reading_time_min", "es_noticia_valida", "excluded_reason", "id_confidence",
        "paywall", "fixed", F.array_join("errors", ";").alias("errores"), F.array_join("warnings", ";").alias("avisos"))


@query("K13_audit_columns", f"SELECT errores, avisos, fixed, count(*) AS n FROM ({_K14}) GROUP BY ALL")
def _(spark, d):
    return _k14(spark, d).groupBy(
        F.array_join("errors", ";").alias("errores"), F.array_join("warnings", ";").alias("avisos"), "fixed"
    ).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- pages

@query("S14_scan_pages", "SELECT page_id, url, length(html) AS n FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", "url", F.length("html").alias("n"))


@query("H01_page_text", f"""
SELECT page_id, t AS texto FROM (SELECT page_id, {visible('html', DROP)} AS t FROM pages) WHERE length(t) >= 100
""")
def _(spark, d):
    return pages.page_text(table(spark, d, "pages")).select("page_id", "texto")


@query("H01_whole_page_text", f"SELECT page_id, md5({visible('html', DROP)}) AS h FROM pages WHERE length({visible('html', DROP)}) >= 100")
def _(spark, d):
    return pages.page_text(table(spark, d, "pages")).select("page_id", F.md5("texto").alias("h"))


_EVID = visible("html", ["script", "style", "nav", "footer", "aside", "header", "menu"], fv.PAGE_AD_CLASSES)


@query("H01_evidence_text", f"""
SELECT page_id, md5(array_to_string(w, ' ')) AS h, len(w) AS palabras
FROM (SELECT page_id, string_split({_EVID}, ' ') AS w FROM pages) WHERE len(w) >= 30
""")
def _(spark, d):
    return pages.evidence_text(table(spark, d, "pages")).select("page_id", F.md5("contenido").alias("h"), "palabras")


_LINKS = """(SELECT DISTINCT page_id, regexp_extract(url, '^https?://[^/?#]*', 0) || h AS enlace FROM
  (SELECT page_id, url, unnest(regexp_extract_all(html, '<a\\b[^>]*?\\bhref="([^"]*)"', 1)) AS h FROM pages))"""


@query("H02_page_links", f"SELECT page_id, enlace FROM {_LINKS}")
def _(spark, d):
    return pages.page_links(table(spark, d, "pages"), keep=["page_id"])


@query("P17_keep_links", f"SELECT DISTINCT enlace FROM {_LINKS} WHERE contains(lower(enlace), 'th') AND contains(enlace, 'example.com') AND enlace NOT LIKE '%/the'")
def _(spark, d):
    links = pages.page_links(table(spark, d, "pages"))
    seen = links.filter(F.col("enlace").endswith("/the")).select("enlace")
    return pages.keep_links(links, seen, "th", "example.com")


@query("A19_links_per_host", f"SELECT regexp_extract(enlace, '^https?://([^/?#]*)', 1) AS host, count(*) AS n FROM {_LINKS} GROUP BY ALL")
def _(spark, d):
    return pages.links_per_host(pages.page_links(table(spark, d, "pages"), keep=["page_id"]))


@query("H03_page_title", """
SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<h1\\b[^>]*>(.*?)</h1>', 1, 's'), '<[^>]+>', ' ', 'g'), '&[a-zA-Z0-9]+;', '', 'g'), '\\s+', ' ', 'g')), '') AS titulo FROM pages
""")
def _(spark, d):
    return pages.page_article(table(spark, d, "pages")).select("page_id", "titulo")


@query("H03_page_article", f"""
SELECT page_id, nullif({sq('t')}, '') AS titulo, CASE WHEN page_id % 3 = 0 THEN 'Ana' END AS autor, CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '2024-05-01 08:00:00' END AS fecha,
 (['a,b', 'x', ''])[page_id % 3 + 1] AS tags FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN x WHEN 1 THEN replace(x, '"', '') ELSE
  regexp_replace(regexp_replace(regexp_extract(html, '<h1\\b[^>]*>(.*?)</h1>', 1, 's'), '<[^>]+>', ' ', 'g'), '&[a-zA-Z0-9]+;', '', 'g') END AS t
  FROM (SELECT page_id, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS x FROM pages))
""")
def _(spark, d):
    """Pages with structured data, meta tags or only elements, by page: every source is exercised."""
    t = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    ld = F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), t.alias("headline"), F.lit("2024-05-01T10:00:00+02:00").alias("datePublished"),
                            F.array(F.struct(F.lit("Ana").alias("name"))).alias("author"), F.lit("a, b").alias("keywords")))
    head = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>"))).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit('<meta property="og:title" content="'), F.replace(t, F.lit('"'), F.lit("")), F.lit('"><meta property="article:tag" content="x">'))
    ).otherwise(F.lit(""))
    rows = table(spark, d, "pages").select("page_id", "url", F.concat(head, "html").alias("html"))
    return pages.page_article(rows).select("page_id", "titulo", "autor", F.col("fecha").cast("timestamp_ntz").alias("fecha"), F.array_join("tags", ",").alias("tags"))


# as HTML has it, a reference may lack its semicolon; titles end inside of one
_PLAIN = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&quot;?', chr(34), 'g'),
 '&#x27(;|([^0-9A-Fa-f;])|$)', chr(39) || '\\2', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')"""
SITES = ["www.abc.es", "www.diariosur.es", "www.diariodesevilla.es", "elpais.com"]


@query("H03_site_article", f"""
WITH p AS (SELECT page_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT page_id, string_split(replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</p>', ''), '<p>')[2:] AS x FROM pages)),
 c AS (SELECT page_id, i, {sq(_PLAIN.format("regexp_replace(replace(t, '<br>', ' '), '<[^>]+>', '', 'g')"))} AS t FROM p),
 b AS (SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS cuerpo FROM c WHERE length(t) >= CASE page_id % 4 WHEN 3 THEN 41 WHEN 2 THEN 21 ELSE 1 END GROUP BY page_id)
SELECT page_id, CASE WHEN page_id % 4 = 1 THEN {sq(_PLAIN.format("regexp_extract(html, '<title>([^<]*)</title>', 1)"))} ELSE
   {sq(_PLAIN.format("regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '<[^>]+>', '', 'g')"))} END AS titulo,
 CASE page_id % 4 WHEN 0 THEN 'Ana Ruiz' WHEN 1 THEN 'Luis Gil' WHEN 2 THEN 'Eva Sanz' ELSE 'Paz Mora' END AS autor,
 CASE WHEN page_id % 4 = 1 THEN NULL ELSE TIMESTAMP '2024-05-01 08:00:00' + INTERVAL 1 DAY * (page_id % 4) END AS fecha,
 CASE WHEN page_id % 4 <> 1 THEN 'Más sol' END AS subtitulo, cuerpo
FROM pages LEFT JOIN b USING (page_id)
""")
def _(spark, d):
    """The pages as four newspapers would print them, each with its own places for author, time, subtitle and paragraphs."""
    n, h = F.col("page_id") % 4, F.col("html")

    def put(before: str, what: str, html):
        return F.replace(html, F.lit(before), F.lit(what + before))

    def named(css: str, html):
        return F.replace(html, F.lit("<p>"), F.lit(f'<p class="x {css}">'))

    abc = put("<article>", '<p class="voc-author__name">Por <a href="/a">Ana Ruiz</a></p><time class="voc-author__time" datetime="2024-05-01T08:00:00Z">hoy</time><h2 class="voc-subtitle">Más&nbsp;sol</h2>',
              F.replace(named("voc-p", h), F.lit("<h1>"), F.lit('<h1 class="voc-title">')))
    sur = put("<article>", '<p class="voc-author__name">Luis <b>Gil</b></p>', named("voc-p", h))
    sevilla = put("<style>", '<meta property="mrf:authors" content="Eva Sanz"><meta property="article:published_time" content="2024-05-03T10:00:00+02:00">',
                  put("<article>", '<h2 class="subtitle-atom">Más sol</h2>', F.replace(named("paragraph-atom", h), F.lit("<h1>"), F.lit('<h1 class="headline-atom">'))))
    pais = put("<article>", '<h2>Más sol</h2><time datetime="2024-05-04T08:00:00Z">ayer</time>', put("<style>", '<meta name="author" content="Paz Mora">', h))
    page = F.when(n == 0, abc).when(n == 1, sur).when(n == 2, sevilla).otherwise(pais)
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://"), F.get(F.array(*map(F.lit, SITES)), n.cast("int")), F.lit("/a")).alias("url"), page.alias("html"))
    return pages.site_article(rows, "page_id").select("page_id", "titulo", "autor", F.col("fecha").cast("timestamp_ntz").alias("fecha"), "subtitulo", F.array_join("cuerpo", "\n").alias("cuerpo"))


@query("H04_best_paragraph_block", f"""
WITH p AS (SELECT page_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT page_id, string_split(replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '</p>', ''), '<p>')[2:] AS x FROM pages)),
 c AS (SELECT page_id, i, {sq("replace(replace(replace(replace(replace(regexp_replace(replace(t, '<br>', ' '), '<[^>]+>', '', 'g'), '&quot;', chr(34)), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')")} AS t FROM p)
SELECT page_id, 1 AS bloque, sum(length(t)) AS puntos, count(*) AS n_parrafos, string_agg(t, chr(10) || chr(10) ORDER BY i) AS contenido FROM c WHERE length(t) >= 40 GROUP BY page_id HAVING count(*) >= 2
""")
def _(spark, d):
    return pages.best_paragraph_block(table(spark, d, "pages"), "page_id").select(
        "page_id", "bloque", "puntos", "n_parrafos", F.array_join("contenido", "\n\n").alias("contenido"))


@query("H05_crawl_frontier", f"""
WITH l AS (SELECT p.url, x.enlace FROM {_LINKS} x JOIN pages p USING (page_id)), e AS (SELECT url, enlace FROM l UNION SELECT enlace, url FROM l),
 n0 AS (SELECT DISTINCT url FROM pages WHERE page_id = 0), n1 AS (SELECT DISTINCT enlace AS url FROM e WHERE url IN (SELECT url FROM n0) AND enlace NOT IN (SELECT url FROM n0)),
 n2 AS (SELECT DISTINCT enlace AS url FROM e WHERE url IN (SELECT url FROM n1) AND enlace NOT IN (SELECT url FROM n0) AND enlace NOT IN (SELECT url FROM n1))
SELECT url, 0 AS profundidad FROM n0 UNION ALL SELECT url, 1 FROM n1 UNION ALL SELECT url, 2 FROM n2
""")
def _(spark, d):
    """Pages form a graph: every page links to the page with the next id of its host and language."""
    links = pages.page_links(table(spark, d, "pages"))
    back = links.select(F.col("enlace").alias("url"), F.col("url").alias("enlace"))
    start = table(spark, d, "pages").filter("page_id = 0").select("url")
    return pages.crawl_frontier(links.unionByName(back), start, max_depth=2)


@query("T07_sample_links", f"SELECT DISTINCT enlace, md5('7:' || enlace) AS h FROM {_LINKS} ORDER BY h, enlace LIMIT 20")
def _(spark, d):
    links = pages.page_links(table(spark, d, "pages")).select("enlace").distinct()
    return pages.sample_links(links, 20, seed=7).withColumn("h", pages.seeded_hash(F.col("enlace"), 7))


@query("T08_seeded_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5('11:' || doc_id), doc_id) AS puesto FROM documents")
def _(spark, d):
    shuffled = pages.seeded_shuffle(docs(spark, d).select("doc_id"), "doc_id", seed=11)
    # the place of each row in the shuffled order: partitions of a sort are in order, ids inside them too
    placed = shuffled.select("doc_id", F.monotonically_increasing_id().alias("_at"), F.lit(0).alias("_all"))
    parts = placed.withColumns({"_part": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return parts.join(starts, "_part").select("doc_id", (F.col("_start") + F.col("_in") + 1).alias("puesto"))


@query("U06_tag_union", """
SELECT page_id, trim(t) AS tag FROM (SELECT page_id, unnest(list_concat(regexp_extract_all(html, 'href="/([^"]*)"', 1), string_split(regexp_extract(html, 'lang="([^"]*)"', 1), ','))) AS t FROM pages) WHERE trim(t) <> ''
""")
def _(spark, d):
    hrefs = F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))
    tags = pages.tag_list(hrefs, F.split(F.regexp_extract("html", 'lang="([^"]*)"', 1), ","))
    return table(spark, d, "pages").select("page_id", F.explode(tags).alias("tag"))


# ---------------------------------------------------------------- duplicates

_COPIES = """(SELECT 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS path, md5(text) AS h, CASE WHEN doc_id % 7 = 3 THEN NULL ELSE TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (doc_id % 7) END AS ts, doc_id % 3 AS mtime FROM documents)"""
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY h ORDER BY coalesce(ts, TIMESTAMP '1970-01-01') DESC, mtime DESC, path) AS rn, first(path) OVER (PARTITION BY h ORDER BY coalesce(ts, TIMESTAMP '1970-01-01') DESC, mtime DESC, path) AS kept_path FROM {_COPIES})"


def _copies(spark, d):
    k = F.col("doc_id")
    return docs(spark, d).select(
        F.concat(F.lit("d"), F.lpad(k.cast("string"), 9, "0")).alias("path"), "text",
        F.when(k % 7 != 3, F.timestamp_add("DAY", (k % 7).cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))).alias("ts"),
        (k % 3).alias("mtime"))


@query("W01_dedup_kept", f"SELECT path FROM {_RANKED} WHERE rn = 1")
def _(spark, d):
    rows = _copies(spark, d)
    return dedup.dedup_keep(rows, urls.content_md5(F.col("text")), "path", "date", "ts", "mtime")[0].select("path")


@query("M07_move_duplicates", f"SELECT path, kept_path FROM {_RANKED} WHERE rn > 1")
def _(spark, d):
    rows = _copies(spark, d)
    return dedup.dedup_keep(rows, urls.content_md5(F.col("text")), "path", "date", "ts", "mtime")[1].select("path", "kept_path")


@query("W02_latest_per_url", """
SELECT user_id, event_id, d FROM (SELECT user_id, event_id, CAST(ts AS DATE) AS d, row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE) DESC, event_id) AS rn FROM events) WHERE rn = 1
""")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.to_date("ts").alias("d"))
    return dedup.latest_per_key(rows, "user_id", "d", "event_id")


@query("W03_last_write_wins", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1
""")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return dedup.last_write_wins(rows, ["user_id", "event_type"], "event_id")


@query("W08_first_articles", """
SELECT doc_id, source, h FROM (SELECT doc_id, source, md5(text) AS h, row_number() OVER (PARTITION BY md5(text), source ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1
""")
def _(spark, d):
    rows = docs(spark, d).select("doc_id", "source", F.md5("text").alias("h"))
    return dedup.first_articles(rows, ["h", "source"], "doc_id")


@query("J07_seen_before", "SELECT doc_id FROM documents WHERE md5(text) IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id))")
def _(spark, d):
    rows = docs(spark, d).select("doc_id", F.md5("text").alias("h"))
    known = rows.join(table(spark, d, "labels").select("doc_id"), "doc_id")
    return dedup.seen_before(rows, known, "h").select("doc_id")


@query("J08_not_seen", "SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id))")
def _(spark, d):
    rows = docs(spark, d).select("doc_id", F.md5("text").alias("h"))
    known = rows.join(table(spark, d, "labels").select("doc_id"), "doc_id")
    return dedup.not_seen(rows, known, "h").select("doc_id")


@query("J10_cache_lookup", """
SELECT d.doc_id, sha256(d.text) AS payload_key, r.doc_id AS reply FROM documents d LEFT JOIN
  (SELECT sha256(text) AS k, min(doc_id) AS doc_id FROM documents JOIN labels USING (doc_id) GROUP BY ALL) r ON r.k = sha256(d.text)
""")
def _(spark, d):
    rows = docs(spark, d).select("doc_id", urls.payload_key(F.col("text")).alias("payload_key"))
    cache = rows.join(table(spark, d, "labels").select("doc_id"), "doc_id").groupBy("payload_key").agg(F.min("doc_id").alias("reply"))
    return articles.cached_replies(rows, cache).select("doc_id", "payload_key", "reply")


@query("A11_hash_census", "SELECT sum(n) AS filas, count(*) AS hashes, sum(n - 1) AS duplicados FROM (SELECT md5(text), count(*) AS n FROM documents GROUP BY 1)")
def _(spark, d):
    return dedup.hash_census(docs(spark, d), "text")


@query("T06_top_duplicates", "SELECT md5(text) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, hash LIMIT 10")
def _(spark, d):
    return dedup.top_duplicates(docs(spark, d), "text", 10)


@query("A12_collision_check", "SELECT md5(text) AS hash, count(*) AS filas, count(DISTINCT text) AS contenidos FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return dedup.collision_check(docs(spark, d), "text")


@query("A13_blank_ratio", "SELECT count(*) FILTER (doc_id % 5 < 2) AS vacios, count(*) FILTER (doc_id % 5 >= 2) AS no_vacios, round(count(*) FILTER (doc_id % 5 < 2) * 100 / count(*), 4) AS pct_vacios FROM documents")
def _(spark, d):
    k = F.col("doc_id") % 5
    rows = docs(spark, d).select(F.when(k == 0, F.lit(None)).when(k == 1, F.lit(" \n")).otherwise(F.col("text")).alias("text"))
    return dedup.blank_ratio(rows, "text").withColumn("pct_vacios", F.round("pct_vacios", 4))


@query("A14_keyword_ratio", """
SELECT count(*) FILTER (m) AS con_palabra, count(*) AS total, round(count(*) FILTER (m) * 100 / count(*), 4) AS pct
FROM (SELECT regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(para|with)($|[^\\p{L}\\p{N}_])') AS m FROM documents)
""")
def _(spark, d):
    return dedup.keyword_ratio(docs(spark, d), "text", "(para|with)").withColumn("pct", F.round("pct", 4))


# ---------------------------------------------------------------- audits

@query("S15_table_count", "SELECT count(*) AS n FROM documents")
def _(spark, d):
    return docs(spark, d).agg(F.count("*").alias("n"))


@query("A08_distinct_sources", "SELECT DISTINCT source FROM documents")
def _(spark, d):
    return audits.distinct_sources(docs(spark, d), "source")


@query("A09_crawl_report", """
SELECT 'lang' AS dimension, lang AS valor, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL
UNION ALL SELECT 'profundidad', CAST(doc_id % 4 AS VARCHAR), count(*) FROM documents GROUP BY ALL
""")
def _(spark, d):
    rows = docs(spark, d).select("lang", "source", (F.col("doc_id") % 4).alias("profundidad"))
    return audits.crawl_report(rows, ["lang", "source", "profundidad"])


@query("A10_source_audit", """
SELECT count(*) AS total, count(*) FILTER (event_type <> 'view') AS con_url, count(DISTINCT event_type) AS fuentes, max(ts) AS ultimo,
  (SELECT event_type FROM events WHERE event_type <> 'error' ORDER BY ts DESC LIMIT 1) AS titulo_ultimo, min(ts) AS primero,
  (SELECT event_type FROM events WHERE event_type <> 'error' ORDER BY ts LIMIT 1) AS titulo_primero FROM (SELECT event_type, CASE WHEN event_type <> 'error' THEN ts END AS ts FROM events)
""")
def _(spark, d):
    e = F.col("event_type")
    rows = table(spark, d, "events").select(
        F.when(e != "click", e).otherwise(F.lit("")).alias("source"), F.when(e != "view", F.lit("u")).otherwise(F.lit("")).alias("url"),
        F.when(e != "error", F.col("ts")).alias("ts"), e.alias("title"))
    return audits.source_audit(rows, "source", "url", "ts", "title")


@query("A10_source_counts", "SELECT CASE WHEN event_type = 'click' THEN '(sin fuente)' ELSE event_type END AS fuente, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    e = F.col("event_type")
    return audits.source_counts(table(spark, d, "events").select(F.when(e != "click", e).otherwise(F.lit("")).alias("s")), "s")


@query("A15_run_statistics", """
SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS correctos, count(*) FILTER (event_type <> 'error' AND value > 50) AS con_avisos,
  count(*) FILTER (event_type = 'error') AS errores, sum(user_id) AS tokens, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS latencia_ms FROM events
""")
def _(spark, d):
    rows = table(spark, d, "events").select(
        (F.col("event_type") != "error").alias("ok"), (F.col("value") > 50).cast("int").alias("avisos"),
        F.col("user_id").alias("tokens_used"), F.col("value").cast("decimal(18,2)").alias("latency_ms"))
    return audits.run_statistics(rows)


@query("T03_newest_first", f"SELECT event_id, ts FROM {_EV} ORDER BY ts DESC NULLS LAST, event_id")
def _(spark, d):
    return articles.newest_first(_dated(spark, d), "ts", "event_id")


@query("T06_top_sources", "SELECT event_type, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, event_type LIMIT 3")
def _(spark, d):
    return audits.top_counts(table(spark, d, "events"), "event_type", 3)


# ---------------------------------------------------------------- public names

@query("X05_public_functions", f"""
SELECT doc_id, {plain_title(TITLE)} AS titulo, {n_words('text')} AS palabras, 'sha1:' || sha1('https://x.es/' || doc_id || '|' || {TITLE} || '|') AS id,
 true AS url_valida, 'x.es' AS dominio, 'X' AS medio, true AS espanol, 5 AS ejes FROM documents
""")
def _(spark, d):
    from marisma import api

    url = F.concat(F.lit("https://x.es/"), F.col("doc_id").cast("string"))
    url_checked = F.concat(F.lit("https://x.es/noticias/n-"), F.col("doc_id").cast("string"))
    domain = api.extract_domain(url)
    return docs(spark, d).select(
        "doc_id", api.normalize_title(title_col()).alias("titulo"), api.count_words(F.col("text")).alias("palabras"),
        api.create_stable_id(url, title_col(), F.lit("")).alias("id"), api.validate_url(url_checked)["ok"].alias("url_valida"),
        domain.alias("dominio"), api.get_media_info(domain, url)["name"].alias("medio"), api.is_spanish_domain(domain).alias("espanol"),
        F.lit(len(api.get_axes_for_topic("vivienda"))).alias("ejes"))


# ---------------------------------------------------------------- sets of words

@query("U03_word_intersection", f"""
SELECT d.doc_id, len(list_distinct(list_intersect({toks('d.text')}, {toks('b.text')}))) AS comunes FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id
""")
def _(spark, d):
    passage = table(spark, d, "benchmark").withColumnRenamed("text", "otro")
    rows = docs(spark, d).withColumn("item_id", F.col("doc_id") % passages(spark, d)).join(passage, "item_id")
    return rows.select("doc_id", F.size(F.array_intersect(text.tokens(F.col("text")), text.tokens(F.col("otro")))).alias("comunes"))


@query("U04_token_union", f"""
SELECT d.doc_id, len(list_distinct(list_concat({toks('d.text')}, {toks('b.text')}))) AS total FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id
""")
def _(spark, d):
    passage = table(spark, d, "benchmark").withColumnRenamed("text", "otro")
    rows = docs(spark, d).withColumn("item_id", F.col("doc_id") % passages(spark, d)).join(passage, "item_id")
    return rows.select("doc_id", F.size(F.array_union(text.tokens(F.col("text")), text.tokens(F.col("otro")))).alias("total"))


@query("U05_ordered_distinct", f"""
SELECT doc_id, md5(coalesce(string_agg(w, ' ' ORDER BY pos), '')) AS h, count(w) AS n FROM (
  SELECT doc_id, w, min(i) AS pos FROM (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, {toks('text')} AS t FROM documents)) GROUP BY doc_id, w) GROUP BY doc_id
""")
def _(spark, d):
    kept = F.array_distinct(text.tokens(F.col("text")))
    return docs(spark, d).select("doc_id", F.md5(F.array_join(kept, " ")).alias("h"), F.size(kept).alias("n")).filter("n > 0")


# ---------------------------------------------------------------- model plumbing

@query("P27_mask_stance", """
SELECT doc_id, lang, CASE WHEN lang = 'es' THEN '{"pp":0.2,"psoe":0.0,"vox":0.3,"bng":0.0,"sumar":0.0,"podemos":0.0}' ELSE '{"pp":0.2,"psoe":0.4,"vox":0.3,"bng":0.3,"sumar":0.5,"podemos":0.7}' END AS stance FROM documents
""")
def _(spark, d):
    parties = F.array(*[F.lit(p) for p in fv.PARTIES])
    stance = F.map_from_arrays(parties, F.transform(parties, lambda p: F.length(p) / 10))
    present = F.when(F.col("lang") == "es", F.array(F.lit("pp"), F.lit("vox"))).otherwise(F.array().cast("array<string>"))
    masked = text.mask_stance(stance, present)
    return docs(spark, d).select("doc_id", "lang", F.to_json(masked).alias("stance"))


@query("P28_mask_radar", """
SELECT doc_id, '{"pp":' || CASE WHEN lang = 'es' THEN v ELSE nul END || ',"vox":' || CASE WHEN lang = 'es' THEN nul ELSE v END || ',"psoe":' || CASE WHEN lang = 'es' THEN nul ELSE v END || ',"programa":' || v || '}' AS radar
FROM (SELECT doc_id, lang, '[' || array_to_string(list_transform(range(5), lambda i: n_chars || '.0'), ',') || ']' AS v, '[null,null,null,null,null]' AS nul FROM documents)
""")
def _(spark, d):
    names = F.array(*[F.lit(p) for p in fv.RADAR_PARTIES])
    values = F.array(*[F.col("n_chars").cast("double") for _ in range(5)])
    radar = F.map_from_arrays(names, F.transform(names, lambda p: values))
    present = F.when(F.col("lang") == "es", F.array(F.lit("pp"))).otherwise(F.array(F.lit("vox"), F.lit("psoe")))
    return docs(spark, d).select("doc_id", F.to_json(text.mask_radar(radar, present)).alias("radar"))


@query("P02_merge_template", """
SELECT 'doc-' || doc_id AS id, 'news_v2' AS schema_version, lang, source AS domain, source AS media, 'neutral' AS sentiment_label,
 '{"pp":0.0,"psoe":0.0,"vox":0.0,"bng":0.0,"sumar":0.0,"podemos":0.0}' AS stance, 'etl-news-1.0.0' AS pipeline_version FROM documents
""")
def _(spark, d):
    from marisma.schemas import NEWS_DEFAULTS, NEWS_V2

    raw = docs(spark, d).select(
        F.concat(F.lit("doc-"), "doc_id").alias("id"),
        F.struct("lang", F.col("text").alias("body_plain")).alias("text"),
        F.struct(F.col("source").alias("domain"), F.struct(F.col("source").alias("name")).alias("media")).alias("source"),
    )
    full = articles.merge_template(raw, NEWS_V2, NEWS_DEFAULTS)
    return full.select("id", "schema_version", "text.lang", "source.domain", F.col("source.media.name").alias("media"),
                       "classify.sentiment_label", F.to_json("classify.stance_by_party").alias("stance"), "audit.pipeline_version")


@query("F36_present_parties", "SELECT doc_id, CASE lang WHEN 'es' THEN 'pp,vox' WHEN 'fr' THEN 'pp,bng' ELSE '' END AS partidos FROM documents")
def _(spark, d):
    raw = F.when(F.col("lang") == "es", F.lit('["pp","vox"]')).when(F.col("lang") == "fr", F.lit('{"pp": true, "psoe": null, "vox": false, "bng": 1}')).otherwise(F.lit("[]"))
    return docs(spark, d).select("doc_id", F.array_join(text.present_parties(raw), ",").alias("partidos"))


@query("F37_flatten_candidates", """
SELECT event_id, event_type AS title, '' AS source, '' AS url, '' AS published FROM events UNION ALL SELECT event_id, 'noticia ' || event_id, event_type, '', '' FROM events
UNION ALL SELECT event_id, 'hondo', 'p ' || user_id, 'u', CAST(CAST(ts AS DATE) AS VARCHAR) FROM events
""")
def _(spark, d):
    inner = F.array(F.struct(F.concat(F.lit("noticia "), "event_id").alias("headline"), F.col("event_type").alias("fuente")))
    deep = F.struct(
        F.lit(" hondo ").alias("title"), F.concat(F.lit(" p "), "user_id").alias("publisher"), F.lit("u ").alias("link"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("publishedDate"))
    for level in "abcdefgh":
        deep = F.struct(deep.alias(level))
    payload = F.to_json(F.struct(F.struct(inner.alias("items")).alias("result"), F.col("event_type").alias("title"), deep.alias("extra")))
    rows = table(spark, d, "events").select("event_id", payload.alias("payload"))
    return articles.flatten_candidates(rows, "payload", ["event_id"])


@query("F38_reply_fields", """
SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN text[:30] END AS resumen, CASE WHEN turn % 4 < 3 THEN length(text) END AS n FROM conversations
""")
def _(spark, d):
    k = F.col("turn") % 4
    obj = F.to_json(F.struct(F.substring("text", 1, 30).alias("resumen"), F.length("text").alias("n")))
    reply = (
        F.when(k == 0, F.concat(F.lit("<think>{no}</think>"), obj)).when(k == 1, F.concat(F.lit("Aquí:\n```json\n"), obj, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("Respuesta: "), obj, F.lit(" fin"))).otherwise(F.col("text"))
    )
    rows = table(spark, d, "conversations").select("conv_id", "turn", reply.alias("reply"))
    return articles.reply_fields(rows, "reply", "resumen string, n int").select("conv_id", "turn", "parsed.resumen", "parsed.n")


@query("F39_prompt_batch", f"""
WITH d AS (SELECT doc_id, lang, {TITLE} AS t, text AS b FROM documents)
SELECT doc_id, c AS call, k AS topic FROM d, (VALUES ('classify', NULL), ('summarize', NULL), ('entities', NULL), ('radar', 'vivienda'), ('radar', 'economia'), ('radar', 'sanidad'),
 ('radar', 'seguridad'), ('radar', 'educacion'), ('radar', 'transporte')) x(c, k) WHERE c <> 'classify' OR (t, b) NOT IN (SELECT (t, b) FROM d WHERE lang = 'fr')
""")
def _(spark, d):
    rows = docs(spark, d).withColumn("titulo", title_col())
    cache = articles.prompt_batch(rows.filter("lang = 'fr'"), "doc_id", "titulo", "text").filter("call = 'classify'")
    return articles.prompt_batch(rows, "doc_id", "titulo", "text", cache).select("doc_id", "call", "topic")
