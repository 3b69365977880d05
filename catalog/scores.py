"""Windowed scores, iteration logs, claims and evidence, and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import STAR, indicators, money, passages, provinces, query, star_fact, table
from catalog.corpus import TITLE, docs, title_col, toks
from marisma.functions import fixed_values as fv
from marisma.functions import numbers, text
from marisma.operators import articles, bucket_table, evidence, facts, series, upserts
from marisma.operators.dedup import existing_ids, insert_ignore
from marisma.session import work_dir

_AS_OF = "(SELECT max(ts) FROM events)"


def events(spark, d):
    return table(spark, d, "events")


_W = "(SELECT e.*, w.ventana FROM events e JOIN (VALUES (1, '1d'), (7, '7d'), (30, '30d')) w(dias, ventana) ON e.ts > (SELECT max(ts) FROM events) - w.dias * INTERVAL 1 DAY)"


@query("A16_coverage", f"""
SELECT ventana, event_type AS tema, count(*) FILTER (value / 50 - 1 > 0.2) AS positive, count(*) FILTER (value / 50 - 1 BETWEEN -0.2 AND 0.2) AS neutral,
  count(*) FILTER (value / 50 - 1 < -0.2) AS negative, count(*) AS total FROM {_W} GROUP BY ALL
""")
def _(spark, d):
    rows = events(spark, d)
    return series.coverage(rows, "ts", "event_type", numbers.coverage_label(F.col("value") / 50 - 1), articles.as_of_max(rows), [1, 7, 30])


@query("A17_radar_mean", """
WITH v AS (SELECT vec_id, label, embedding, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * vec_id AS ts FROM embeddings),
 w AS (SELECT v.*, x.ventana FROM v JOIN (VALUES (7, '7d'), (30, '30d'), (90, '90d')) x(dias, ventana) ON v.ts > (SELECT max(ts) FROM v) - x.dias * INTERVAL 1 DAY)
SELECT ventana, label AS tema, vec_id % 2 AS partido, i AS eje, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 5) AS media
FROM w, range(64) r(i) WHERE NOT (i = 3 AND label = 1) GROUP BY ALL
UNION ALL SELECT ventana, label, vec_id % 2, 3, NULL FROM w WHERE label = 1 GROUP BY ALL
""")
def _(spark, d):
    axes = F.transform("embedding", lambda x, i: F.when(~((i == 3) & (F.col("label") == 1)), x))
    rows = table(spark, d, "embeddings").select(
        "label", (F.col("vec_id") % 2).alias("grupo"), axes.alias("ejes"),
        F.timestamp_add("HOUR", F.col("vec_id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"))
    out = series.radar_mean(rows, "ts", "label", "grupo", "ejes", 64, articles.as_of_max(rows))
    return out.select("ventana", "tema", "partido", F.posexplode("ejes").alias("eje", "media")).withColumn("media", F.round("media", 5))


@query("A18_outlet_affinity", f"""
SELECT ventana, user_id % 10 AS medio, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS afinidad, count(*) AS articulos,
  round(count(*) * 100 / sum(count(*)) OVER (PARTITION BY ventana), 4) AS cuota_articulos FROM {_W} GROUP BY ventana, user_id % 10
""")
def _(spark, d):
    rows = events(spark, d).select("ts", (F.col("user_id") % 10).alias("medio"), money("value").alias("afinidad"))
    out = series.outlet_affinity(rows, "ts", "medio", "afinidad", articles.as_of_max(events(spark, d)), [1, 7, 30])
    return out.withColumns({c: F.round(c, 4) for c in ("afinidad", "cuota_articulos")})


@query("A21_first_match", "SELECT user_id, event_type, min_by(value, event_id) AS value FROM events GROUP BY ALL")
def _(spark, d):
    return facts.first_match(events(spark, d), ["user_id", "event_type"], "value", "event_id")


@query("A22_last_match", "SELECT user_id, event_type, max_by(value, event_id) AS value FROM events GROUP BY ALL")
def _(spark, d):
    return facts.last_match(events(spark, d), ["user_id", "event_type"], "value", "event_id")


@query("A24_strategy_posterior", """
SELECT event_type, 1 + count(*) FILTER (r > 0.3) AS alpha, 1 + count(*) FILTER (r IS NULL OR r <= 0.3) AS beta,
  round((1 + count(*) FILTER (r > 0.3)) / (2 + count(*)), 9) AS media FROM (SELECT event_type, CASE WHEN user_id % 9 = 0 THEN NULL ELSE value / 100 END AS r FROM events) GROUP BY ALL
""")
def _(spark, d):
    rows = events(spark, d).select("event_type", F.when(F.col("user_id") % 9 != 0, F.col("value") / 100).alias("r"))
    return series.strategy_posterior(rows, "event_type", "r").withColumn("media", F.round("media", 9))


_ACCOUNTS = list(fv.SOCIAL_ACCOUNTS)


@query("J11_account_reach", f"""
WITH e AS (SELECT list_extract({_ACCOUNTS + ["desconocida"]}, CAST(1 + user_id % {len(_ACCOUNTS) + 1} AS INT)) AS cuenta FROM events),
 k(cuenta, alcance, afinidad) AS (VALUES {", ".join(f"('{a}', {r}.0::DOUBLE, {f}.0::DOUBLE)" for a, (r, f) in fv.SOCIAL_ACCOUNTS.items())}),
 p AS (SELECT cuenta, count(*) AS publicaciones FROM e GROUP BY 1)
SELECT cuenta, publicaciones, coalesce(afinidad, 0) AS affinity, coalesce(alcance, 0) AS reach, round(1.0 - 0.165 * coalesce(alcance, 0) / 100, 6) AS r, round(0.65 - 0.65 * coalesce(alcance, 0) / 100, 6) AS g
FROM p LEFT JOIN k USING (cuenta)
""")
def _(spark, d):
    """Posts of accounts, with what is known of the account, as points of the scatter chart."""
    names = F.array(*[F.lit(a) for a in [*_ACCOUNTS, "desconocida"]])
    posts = events(spark, d).select(F.get(names, (F.col("user_id") % (len(_ACCOUNTS) + 1)).cast("int")).alias("cuenta"))
    known = series.account_points(posts, "cuenta")
    points = series.scatter_points(known, "cuenta", "afinidad", "alcance").withColumns({c: F.round(c, 6) for c in "rg"}).drop("b")
    return points.join(known.select("cuenta", "publicaciones"), "cuenta")


@query("A27_scatter_points", """
SELECT user_id, affinity, reach, round(1.0 - 0.165 * reach / 100, 6) AS r, round(0.65 - 0.65 * reach / 100, 6) AS g, 0.0::DOUBLE AS b FROM (
 SELECT user_id, greatest(0, least(100, max(value) - 100)) AS affinity, greatest(0, least(100, max(value))) AS reach FROM events GROUP BY user_id)
""")
def _(spark, d):
    rows = events(spark, d).groupBy("user_id").agg((F.max("value") - 100).alias("a"), F.max("value").alias("c"))
    return series.scatter_points(rows, "user_id", "a", "c").withColumns({c: F.round(c, 6) for c in "rgb"})


# ---------------------------------------------------------------- iteration logs

_LOG = """
WITH e AS (SELECT event_id, CASE WHEN event_id % 97 > 0 THEN user_id END AS user_id, CASE WHEN event_id % 83 > 0 THEN ts END AS ts, value / 500 AS score, event_type = 'purchase' AS improved, CAST(event_type = 'click' AS INT) AS new FROM events),
 s AS (SELECT *, row_number() OVER w AS iteracion, lag(score) OVER w AS p1, lag(score, 2) OVER w AS p2, sum(new) OVER w AS fuentes,
  row_number() OVER w - coalesce(max(CASE WHEN improved THEN iter END) OVER w, 0) AS estancamiento
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iter FROM e) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
 log AS (SELECT *, round(CASE WHEN iteracion >= 3 THEN (score - p2) / 2 WHEN iteracion = 2 THEN score - p1 ELSE 0 END, 9) AS tendencia FROM s)
"""

#: the same over the table as it is
LOG_OF_EVENTS = _LOG.replace("CASE WHEN event_id % 97 > 0 THEN user_id END AS user_id, CASE WHEN event_id % 83 > 0 THEN ts END AS ts,", "user_id, ts,")


def _with_nulls(rows):
    """Events of unknown user or time: a null user is one user, a null time comes last."""
    e = F.col("event_id")
    return rows.withColumns({"user_id": F.when(e % 97 > 0, F.col("user_id")), "ts": F.when(e % 83 > 0, F.col("ts"))})


def _log(spark, d):
    rows = _with_nulls(events(spark, d)).withColumn("score", F.col("value") / 500)
    out = series.iteration_state(rows, "user_id", "ts", "event_id", "score", F.col("event_type") == "purchase",
                                 (F.col("event_type") == "click").cast("int"))
    return out.withColumn("tendencia", F.round("tendencia", 9))


@query("W04_quality_trend", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 97 > 0 THEN user_id END AS user_id, CASE WHEN event_id % 83 > 0 THEN ts END AS ts, value FROM events),
 n AS (SELECT event_id, user_id, value / 500 AS score, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x FROM e)
SELECT event_id, CASE WHEN x = 1 THEN 0 ELSE round(regr_slope(score, x) OVER (PARTITION BY user_id ORDER BY x ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 9) + CAST(0 AS DOUBLE) END AS tendencia FROM n
""")
def _(spark, d):
    return _log(spark, d).select("event_id", "tendencia")


@query("W05_plateau_count", _LOG + "SELECT event_id, iteracion, estancamiento, fuentes FROM log")
def _(spark, d):
    return _log(spark, d).select("event_id", "iteracion", "estancamiento", "fuentes")


@query("W09_stop_reason", _LOG + """
SELECT event_id, CASE WHEN score >= 0.75 THEN 'Quality threshold reached' WHEN iteracion >= 15 THEN 'Maximum iterations reached'
 WHEN estancamiento >= 3 THEN 'Quality plateau detected' WHEN iteracion >= 3 AND tendencia < 0.05 THEN 'Diminishing returns detected'
 WHEN iteracion >= 3 AND fuentes < 2 THEN 'Insufficient sources found' END AS motivo FROM log
""")
def _(spark, d):
    return series.stop_reason(_log(spark, d), "score").select("event_id", "motivo")


@query("W06_fill_down", """
SELECT event_id, last(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY u ORDER BY o ROWS UNBOUNDED PRECEDING) AS seccion
FROM (SELECT *, CASE WHEN event_id % 97 > 0 THEN user_id END AS u, CASE WHEN event_id <> 21 THEN event_id END AS o FROM events)
""")
def _(spark, d):
    rows = _with_nulls(events(spark, d)).withColumn("orden", F.when(F.col("event_id") != 21, F.col("event_id")))
    rows = rows.withColumn("marca", F.when(F.col("event_type") == "signup", F.col("value")))
    return series.fill_down(rows, ["user_id"], "orden", "marca", "seccion").select("event_id", "seccion")


@query("W07_numbering", "SELECT doc_id, s AS source, row_number() OVER (PARTITION BY s ORDER BY nullif(doc_id, 8)) AS numero FROM (SELECT doc_id, nullif(source, 'src1') AS s FROM documents)")
def _(spark, d):
    rows = docs(spark, d).select("doc_id", F.nullif("source", F.lit("src1")).alias("source"), F.nullif("doc_id", F.lit(8)).alias("orden"))
    return series.number_rows(rows, ["source"], "orden").drop("orden")


_DIMS = "SELECT event_id, (value % 100) / 100 AS completeness, (user_id % 11) / 10 AS accuracy, (event_id % 7) / 6 AS consistency, (event_id % 3) / 2 AS depth, 0.6::DOUBLE AS freshness, (user_id % 5) / 4 AS authority FROM events"


def _dims(spark, d):
    return events(spark, d).select(
        "event_id", (F.col("value") % 100 / 100).alias("completeness"), (F.col("user_id") % 11 / 10).alias("accuracy"),
        (F.col("event_id") % 7 / 6).alias("consistency"), (F.col("event_id") % 3 / 2).alias("depth"),
        F.lit(0.6).alias("freshness"), (F.col("user_id") % 5 / 4).alias("authority"))


@query("K08_quality_overall", f"""
SELECT event_id, round(completeness * 0.25 + accuracy * 0.20 + consistency * 0.15 + depth * 0.15 + freshness * 0.15 + authority * 0.10, 9) AS global FROM ({_DIMS})
""")
def _(spark, d):
    return _dims(spark, d).select("event_id", F.round(evidence.quality_overall(), 9).alias("global"))


@query("K09_quality_heuristic", f"""
SELECT doc_id, round(least(w / 100, 1.0), 9) AS completeness, round(least(s / 3, 1.0), 9) AS accuracy, CASE WHEN s >= 2 THEN 0.7 ELSE 0.4 END::DOUBLE AS consistency,
 round(least(w / 150, 1.0), 9) AS depth, 0.6::DOUBLE AS freshness, 0.6::DOUBLE AS authority FROM (SELECT doc_id, len({toks('text')}) AS w, doc_id % 5 AS s FROM documents)
""")
def _(spark, d):
    q = evidence.quality_heuristic(F.size(text.tokens(F.col("text"))), F.col("doc_id") % 5)
    return docs(spark, d).select("doc_id", *[F.round(c, 9).alias(n) for n, c in q.items()])


@query("K10_weak_dimensions", f"""
SELECT event_id, array_to_string(list_filter([CASE WHEN completeness < 0.6 THEN 'completeness' END, CASE WHEN accuracy < 0.6 THEN 'accuracy' END,
 CASE WHEN consistency < 0.6 THEN 'consistency' END, CASE WHEN depth < 0.6 THEN 'depth' END, CASE WHEN freshness < 0.6 THEN 'freshness' END,
 CASE WHEN authority < 0.6 THEN 'authority' END], lambda x: x IS NOT NULL)[:2], ',') AS debiles FROM ({_DIMS})
""")
def _(spark, d):
    return _dims(spark, d).select("event_id", F.array_join(evidence.weak_dimensions(), ",").alias("debiles"))


_TURNS = "(SELECT a.conv_id, a.turn, q.text AS q, a.text AS a FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant')"


@query("K11_answer_heuristic", f"""
SELECT conv_id, turn, round(CASE WHEN length(a) < 50 THEN 0.2 ELSE 0.7 * 0.5 + 0.3 * h END, 9) AS puntos FROM (SELECT conv_id, turn, a,
 (least(len({toks('a')}) / 150, 1.0) + 0.25 + len(list_distinct(list_intersect({toks('q')}, {toks('a')}))) / greatest(len(list_distinct({toks('q')})), 1)
  + least(0.5 + CASE WHEN length(a) > 100 THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(a, ':|-|•|1\\.|2\\.|Day 1|Day 2') THEN 0.2 ELSE 0 END + CASE WHEN turn >= 2 THEN 0.1 ELSE 0 END, 1.0)) / 4 AS h FROM {_TURNS})
""")
def _(spark, d):
    c = table(spark, d, "conversations")
    asked = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("q"))
    rows = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("a")).join(asked, ["conv_id", "turn"])
    h = evidence.answer_heuristic(F.col("q"), F.col("a"), F.lit(0.25), F.col("turn"))
    return rows.select("conv_id", "turn", F.round(evidence.answer_score(F.col("a"), F.lit(0.5), h), 9).alias("puntos"))


# ---------------------------------------------------------------- claims

# claims: first sentence of every benchmark passage; evidence: documents and pages that share its number
_CLAIM_SQL = f"""
WITH claims AS (SELECT item_id AS claim_id, {TITLE} AS texto, item_id % 3 = 0 AS tagged, (item_id % 7) * 1000.0::DOUBLE AS claim_value,
   CASE WHEN item_id % 11 = 0 THEN 'No hay evidencia clara' ELSE '' END AS resumen FROM benchmark),
 n AS (SELECT count(*) AS n FROM benchmark),
 mentions AS (SELECT doc_id % n AS claim_id, CASE WHEN lang = 'de' THEN '' WHEN doc_id % n < n / 2 THEN source ELSE 'una' END AS fuente FROM documents, n WHERE doc_id % n <> 13),
 web AS (SELECT page_id % (n + 5) AS claim_id, CASE WHEN url LIKE 'https%' THEN 'official' ELSE 'independent' END AS type, CASE WHEN contains(url, 'spam') THEN 'contradictory' ELSE 'supportive' END AS stance FROM pages, n),
 official AS (SELECT o_orderkey % n AS claim_id, min(CASE WHEN o_orderkey % n % 10 <> 9 THEN (o_orderkey % n % 5) * 1050.0::DOUBLE END) AS value, true AS present FROM orders, n WHERE o_orderkey % n % 8 <> 6 GROUP BY 1),
 p AS (SELECT claim_id, count(DISTINCT nullif(fuente, '')) AS fuentes, count(*) AS menciones FROM mentions GROUP BY 1),
 w AS (SELECT claim_id, bool_or(stance = 'contradictory') AS c, count(*) FILTER (type = 'official' AND stance <> 'contradictory') AS o, count(*) AS n FROM web GROUP BY 1),
 j AS (SELECT claims.*, coalesce(fuentes, 0) AS fuentes, coalesce(menciones, 0) AS menciones, coalesce(c, false) AS c, coalesce(o, 0) AS o, coalesce(n, 0) AS n, value, present
   FROM claims LEFT JOIN p USING (claim_id) LEFT JOIN w USING (claim_id) LEFT JOIN official USING (claim_id)),
 k AS (SELECT *, CASE WHEN contains(lower(resumen), 'no hay evidencia') THEN -2 WHEN fuentes >= 2 THEN 3 WHEN fuentes = 1 THEN 2 WHEN menciones > 0 THEN 1 ELSE 0 END AS prensa,
   CASE WHEN c THEN -1 WHEN o > 0 THEN 2 WHEN n > 0 THEN 1 ELSE 0 END AS web,
   CASE WHEN NOT tagged OR value IS NULL THEN 0 WHEN claim_value = value THEN 3 WHEN abs(claim_value - value) / greatest(value, 1) <= 0.1 THEN 2 ELSE -3 END AS oficial,
   CASE WHEN NOT tagged THEN 'no_aplica' WHEN present IS NULL THEN 'no_disponible' WHEN value IS NULL THEN 'datos_insuficientes' WHEN claim_value = value THEN 'exacta' WHEN abs(claim_value - value) / greatest(value, 1) <= 0.1 THEN 'aproximada' ELSE 'contradictoria' END AS coincidencia FROM j),
 t AS (SELECT *, prensa + web + oficial AS total, CASE WHEN prensa <= 0 THEN 0 WHEN fuentes >= 2 THEN fuentes ELSE 1 END + CASE WHEN web > 0 THEN 1 ELSE 0 END + CASE WHEN oficial > 0 THEN 1 ELSE 0 END AS apoyos FROM k),
 v AS (SELECT *, CASE WHEN total >= 5 AND apoyos >= 2 THEN 'Verdadera' ELSE 'Falsa' END AS veredicto FROM t),
 scored AS (SELECT *, CASE WHEN escala > 0.2 THEN 'true' WHEN escala < -0.2 THEN 'fake' ELSE 'insufficient' END AS clase FROM (SELECT *, CASE WHEN veredicto = 'Verdadera' THEN least(1.0, greatest(0.5, CASE WHEN total = 0 THEN 1.0 ELSE total / 10 END))
   ELSE greatest(-1.0, least(-0.5, CASE WHEN total = 0 THEN -1.0 ELSE -abs(total) / 10 END)) END::DOUBLE AS escala FROM v))
"""


def _claims(spark, d):
    claims = table(spark, d, "benchmark").select(
        F.col("item_id").alias("claim_id"), title_col().alias("texto"), (F.col("item_id") % 3 == 0).alias("tagged"),
        (F.col("item_id") % 7 * 1000.0).alias("claim_value"),
        F.when(F.col("item_id") % 11 == 0, F.lit("No hay evidencia clara")).otherwise(F.lit("")).alias("resumen"))
    n = passages(spark, d)
    k = F.col("claim_id")
    mentions = docs(spark, d).withColumn("claim_id", F.col("doc_id") % n).filter(k != 13).select(
        k, F.when(F.col("lang") == "de", F.lit("")).when(k < n / 2, F.col("source")).otherwise(F.lit("una")).alias("fuente"))
    web = table(spark, d, "pages").select(
        (F.col("page_id") % (n + 5)).alias("claim_id"),
        F.when(F.col("url").startswith("https"), F.lit("official")).otherwise(F.lit("independent")).alias("type"),
        F.when(F.contains("url", F.lit("spam")), F.lit("contradictory")).otherwise(F.lit("supportive")).alias("stance"))
    # some claims have no row of statistics, some a row without a number
    official = table(spark, d, "orders").select((F.col("o_orderkey") % n).alias("claim_id")).filter(k % 8 != 6).select(
        k, F.when(k % 10 != 9, k % 5 * 1050.0).alias("value"))
    return evidence.score_claims(claims, mentions, web, official)


for _name, _cols in {
    "K01_press_score": ["claim_id", "fuentes", "menciones", "prensa"],
    "K02_web_score": ["claim_id", "web"],
    "K03_official_score": ["claim_id", "oficial", "coincidencia"],
    "K04_verdict": ["claim_id", "total", "apoyos", "veredicto"],
    "K05_signed_score": ["claim_id", "escala", "clase"],
    "J13_claims_with_evidence": ["claim_id", "prensa", "web", "oficial", "total"],
    "A25_supporting_sources": ["claim_id", "apoyos"],
}.items():
    def _run(spark, d, cols=_cols):
        out = _claims(spark, d).withColumn("clase", numbers.score_class(F.col("escala")))
        return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("fuentes", "menciones")}).select(*cols)

    query(_name, _CLAIM_SQL + f"SELECT {', '.join(_cols)} FROM scored")(_run)


@query("K07_headlines", _CLAIM_SQL + """
SELECT claim_id, CASE WHEN veredicto = 'Falsa' OR escala < 0 THEN 'critica' WHEN escala BETWEEN 0 AND 0.2 THEN 'ambigua' END AS tipo,
 CASE WHEN length(texto) > 50 THEN texto[:50] || '...' ELSE texto END AS titulo FROM scored
""")
def _(spark, d):
    h = evidence.headlines(F.col("texto"), F.col("veredicto"), F.col("escala"))
    return _claims(spark, d).select("claim_id", h["tipo"].alias("tipo"), h["titulo"].alias("titulo"))


@query("A26_bibliography", """
WITH r AS (SELECT page_id % 7 AS claim_id, page_id AS orden, regexp_extract(url, '^https?://([^/]*)', 1) AS fuente, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
   CASE WHEN page_id % 3 = 0 THEN '' ELSE regexp_extract(url, '^https?://[^/]*', 0) END AS url FROM pages),
 k AS (SELECT *, CASE WHEN url <> '' THEN url ELSE fuente || '|' || title END AS ref FROM r WHERE title <> '' OR url <> ''),
 f AS (SELECT *, row_number() OVER (PARTITION BY claim_id, ref ORDER BY orden) AS rn FROM k)
SELECT claim_id, orden, coalesce(nullif(fuente, ''), 'Desconocida') AS fuente, CASE WHEN length(title) > 100 THEN title[:100] || '...' ELSE title END AS title, url,
 row_number() OVER (PARTITION BY claim_id ORDER BY orden) AS id FROM f WHERE rn = 1
""")
def _(spark, d):
    refs = table(spark, d, "pages").select(
        (F.col("page_id") % 7).alias("claim_id"), F.col("page_id").alias("orden"), F.regexp_extract("url", "^https?://([^/]*)", 1).alias("fuente"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.regexp_extract("url", "^https?://[^/]*", 0)).alias("url"))
    return evidence.bibliography(refs, "claim_id", "orden")


def _spans_input(spark, d):
    bench = table(spark, d, "benchmark").select("item_id", F.split("text", r"[.\n]\s*").alias("frases"))
    rows = docs(spark, d).withColumn("item_id", F.col("doc_id") % passages(spark, d)).join(bench, "item_id")
    claims = F.concat(F.array(title_col()), F.col("frases"), F.array(F.right("text", F.lit(40))))
    return rows.select("doc_id", "text", claims.alias("claims")).withColumn(
        "scores", F.transform("claims", lambda c, i: F.when(i % 3 == 0, F.lit(0.8)).when(i % 3 == 1, F.lit(-0.6)).otherwise(F.lit(0.1))))


_SPANS = f"""
WITH RECURSIVE b AS (SELECT item_id, regexp_split_to_array(text, '[.\\n]\\s*') AS frases FROM benchmark),
 src AS (SELECT doc_id, text, lower(text) AS low, list_transform(list_concat([{TITLE}], frases, [right(text, 40)]), lambda c: lower(trim(c, ' ' || chr(10) || chr(9)))) AS claims
   FROM documents JOIN b ON doc_id % (SELECT count(*) FROM benchmark) = item_id),
 st(doc_id, n, pos, inicio, fin) AS (SELECT doc_id, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM src
   UNION ALL SELECT doc_id, n + 1, CASE WHEN p > 0 THEN p - 1 + length(c) ELSE pos END, CASE WHEN p > 0 THEN p - 1 ELSE 0 END, CASE WHEN p > 0 THEN p - 1 + length(c) ELSE 0 END
   FROM (SELECT doc_id, n, pos, c, CASE WHEN c = '' THEN 0 WHEN strpos(low[pos + 1:], c) > 0 THEN pos + strpos(low[pos + 1:], c) ELSE strpos(low, c) END AS p
     FROM (SELECT st.doc_id, n, pos, low, claims[n + 1] AS c FROM st JOIN src ON st.doc_id = src.doc_id AND n < len(claims)))),
 spans AS (SELECT doc_id, n - 1 AS n, inicio, fin FROM st WHERE n > 0)
"""


@query("W11_claim_spans", _SPANS + "SELECT doc_id, n, inicio, fin FROM spans")
def _(spark, d):
    rows = _spans_input(spark, d)
    rows = rows.withColumn("low", F.lower("text"))
    return rows.select("doc_id", F.posexplode(evidence.claim_spans(F.col("low"), F.col("claims"))).alias("n", "s")).select(
        "doc_id", "n", F.col("s.start").alias("inicio"), F.col("s.end").alias("fin"))


@query("K06_text_heatmap", _SPANS + """
, edges AS (SELECT DISTINCT doc_id, e FROM (SELECT doc_id, inicio AS e FROM spans UNION ALL SELECT doc_id, fin FROM spans UNION ALL SELECT doc_id, length(text) FROM documents UNION ALL SELECT doc_id, 0 FROM documents)),
 pieces AS (SELECT doc_id, e AS inicio, lead(e) OVER (PARTITION BY doc_id ORDER BY e) AS fin FROM edges),
 won AS (SELECT p.doc_id, p.inicio, p.fin, max(s.n) AS n FROM pieces p LEFT JOIN spans s ON p.doc_id = s.doc_id AND s.inicio <= p.inicio AND s.fin >= p.fin WHERE p.fin IS NOT NULL GROUP BY ALL)
SELECT doc_id, inicio, fin, CASE WHEN n IS NULL THEN 0.0 WHEN n % 3 = 0 THEN 0.8 WHEN n % 3 = 1 THEN 0.6 ELSE 0.1 END::DOUBLE AS intensidad,
 CASE WHEN n IS NULL OR n % 3 = 2 THEN 0 WHEN n % 3 = 0 THEN 1 ELSE -1 END AS marca FROM won
""")
def _(spark, d):
    return evidence.heat_spans(_spans_input(spark, d), "text", "claims", "scores", ["doc_id"])


# ---------------------------------------------------------------- table maintenance

_UP = """
WITH t AS (SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS precio FROM orders WHERE o_orderdate < '2000-01-01'),
 s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'X' END AS o_orderstatus, CAST(o_totalprice AS DOUBLE) + 1 AS precio FROM orders WHERE o_orderdate >= '1999-01-01')
"""


def _halves(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("precio"), "o_orderdate")
    cut_t, cut_s = F.lit("2000-01-01").cast("timestamp_ntz"), F.lit("1999-01-01").cast("timestamp_ntz")
    target = o.filter(F.col("o_orderdate") < cut_t).drop("o_orderdate")
    source = o.filter(F.col("o_orderdate") >= cut_s).select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.lit("X")).alias("o_orderstatus"), (F.col("precio") + 1).alias("precio"), F.lit(2).alias("orden"))
    stale = source.withColumns({"precio": F.lit(-1.0), "orden": F.lit(1)})
    return target, source.unionByName(stale)


@query("M01_upsert", _UP + """
SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus,
 CASE WHEN s.o_orderkey IS NOT NULL THEN s.precio ELSE t.precio END AS precio,
 CASE WHEN s.o_orderkey IS NULL THEN 'igual' WHEN t.o_orderkey IS NULL THEN 'insertada' ELSE 'actualizada' END AS accion FROM t FULL JOIN s USING (o_orderkey)
""")
def _(spark, d):
    target, source = _halves(spark, d)
    return upserts.upsert(target, source, ["o_orderkey"], "orden")


@query("M01_upsert_merge_fields", _UP + """
SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, coalesce(s.o_orderstatus, t.o_orderstatus) AS o_orderstatus, coalesce(s.precio, t.precio) AS precio,
 CASE WHEN s.o_orderkey IS NULL THEN 'igual' WHEN t.o_orderkey IS NULL THEN 'insertada' ELSE 'actualizada' END AS accion FROM t FULL JOIN s USING (o_orderkey)
""")
def _(spark, d):
    target, source = _halves(spark, d)
    return upserts.upsert(target, source, ["o_orderkey"], "orden", merge_fields=True)


@query("M01_action_counts", _UP + """
SELECT accion, count(*) AS n FROM (SELECT CASE WHEN s.o_orderkey IS NULL THEN 'igual' WHEN t.o_orderkey IS NULL THEN 'insertada' ELSE 'actualizada' END AS accion
 FROM t FULL JOIN s USING (o_orderkey)) GROUP BY ALL
""")
def _(spark, d):
    target, source = _halves(spark, d)
    return upserts.action_counts(upserts.upsert(target, source, ["o_orderkey"], "orden"))


def _bucketed(spark, d):
    """The target in buckets, even keys in one batch and odd ones in the next, each of them sent again."""
    target, source = _halves(spark, d)
    root = work_dir(spark, "m01")
    buckets = max(8, target.count() // 2_000_000)
    bucket_table.create_table(spark, root, target.schema, target.withColumn("orden", F.lit(0)), ["o_orderkey"], "orden", buckets)
    for batch in (1, 2, 1, 2):
        bucket_table.merge_batch(spark, root, target.schema, source.filter(F.col("o_orderkey") % 2 == batch - 1), ["o_orderkey"], "orden", batch)
    return root, target.schema


@query("M01_upsert_bucketed", _UP + """
SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus,
 CASE WHEN s.o_orderkey IS NOT NULL THEN s.precio ELSE t.precio END AS precio FROM t FULL JOIN s USING (o_orderkey)
""")
def _(spark, d):
    root, schema = _bucketed(spark, d)
    return bucket_table.read_table(spark, root, schema)


@query("M01_bucketed_actions", _UP + """
SELECT CAST(o_orderkey % 2 + 1 AS INT) AS lote, CASE WHEN t.o_orderkey IS NULL THEN 'insertada' ELSE 'actualizada' END AS accion, count(*) AS n FROM s LEFT JOIN t USING (o_orderkey) GROUP BY ALL
""")
def _(spark, d):
    root, _ = _bucketed(spark, d)
    one, two = (bucket_table.batch_actions(spark, root, n).select(F.lit(n).alias("lote"), "accion", "n") for n in (1, 2))
    return one.unionByName(two)


@query("M02_insert_ignore", """
WITH d AS (SELECT doc_id, source, md5(text) AS h FROM documents), t AS (SELECT d.* FROM d JOIN labels USING (doc_id)),
 s AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS rn FROM d WHERE h NOT IN (SELECT h FROM t))
SELECT doc_id, source, h FROM t UNION ALL SELECT doc_id, source, h FROM s WHERE rn = 1
""")
def _(spark, d):
    rows = docs(spark, d).select("doc_id", "source", F.md5("text").alias("h"))
    target = rows.join(table(spark, d, "labels").select("doc_id"), "doc_id")
    return insert_ignore(target, rows, ["h"], "doc_id")


@query("M02_insert_ignore_null_keys", """
WITH d AS (SELECT doc_id, source, nullif(lang, 'de') AS lang, CASE WHEN doc_id % 5 <> 0 THEN md5(text) END AS h FROM documents),
 t AS (SELECT d.* FROM d JOIN labels USING (doc_id)),
 s AS (SELECT *, row_number() OVER (PARTITION BY h, lang ORDER BY doc_id) AS rn FROM d
       WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.h IS NOT DISTINCT FROM d.h AND t.lang IS NOT DISTINCT FROM d.lang))
SELECT doc_id, source, lang, h FROM t UNION ALL SELECT doc_id, source, lang, h FROM s WHERE rn = 1
""")
def _(spark, d):
    """A second run adds nothing."""
    rows = docs(spark, d).select("doc_id", "source", F.nullif("lang", F.lit("de")).alias("lang"), F.when(F.col("doc_id") % 5 != 0, F.md5("text")).alias("h"))
    target = rows.join(table(spark, d, "labels").select("doc_id"), "doc_id")
    once = insert_ignore(target, rows, ["h", "lang"], "doc_id")
    return insert_ignore(once, rows, ["h", "lang"], "doc_id")


@query("M02_existing_ids", """
SELECT DISTINCT md5(text) AS h, t.doc_id FROM documents JOIN (SELECT doc_id, md5(text) AS h FROM documents JOIN labels USING (doc_id)) t ON t.h = md5(text)
""")
def _(spark, d):
    rows = docs(spark, d).select("doc_id", F.md5("text").alias("h"))
    return existing_ids(rows.join(table(spark, d, "labels").select("doc_id"), "doc_id"), rows, ["h"], "doc_id")


@query("M03_replace_partition", """
SELECT o_orderkey, year(o_orderdate) AS anio, CASE WHEN year(o_orderdate) = 1998 THEN 0 ELSE CAST(o_totalprice AS DOUBLE) END AS precio FROM orders
WHERE year(o_orderdate) <> 1998 OR o_orderstatus = 'F'
""")
def _(spark, d):
    target = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("anio"), F.col("o_totalprice").alias("precio"), "o_orderstatus")
    source = target.filter("anio = 1998 AND o_orderstatus = 'F'").withColumn("precio", F.lit(0.0))
    return upserts.replace_partition(target, source, ["anio"]).drop("o_orderstatus")


@query("M03_replace_null_keys", """
WITH t AS (SELECT o_orderkey, year(o_orderdate) AS anio, nullif(o_orderstatus, 'P') AS estado, CAST(o_totalprice AS DOUBLE) AS precio, o_orderpriority FROM orders)
SELECT o_orderkey, anio, estado, precio FROM t WHERE NOT (anio = 1995 AND (estado IS NULL OR estado = 'O'))
UNION ALL SELECT o_orderkey, anio, estado, -1.0 FROM t WHERE anio = 1995 AND (estado IS NULL OR estado = 'O') AND o_orderpriority LIKE '1%'
""")
def _(spark, d):
    """Null is "all": the totals of a period are replaced like any other part of it."""
    target = table(spark, d, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("anio"), F.nullif("o_orderstatus", F.lit("P")).alias("estado"), F.col("o_totalprice").alias("precio"), "o_orderpriority")
    source = target.filter("anio = 1995 AND (estado IS NULL OR estado = 'O') AND o_orderpriority LIKE '1%'").withColumn("precio", F.lit(-1.0))
    return upserts.replace_partition(target, source, ["anio", "estado"]).drop("o_orderpriority")


@query("M04_insert_facts", STAR + """
, n AS (SELECT anio, mes, id_provincia, max(valor_absoluto) FILTER (id_indicador = 1) AS v1 FROM star WHERE id_provincia IS NOT NULL GROUP BY ALL)
SELECT coalesce(s.anio, n.anio + 10) AS anio, coalesce(s.mes, n.mes) AS mes, coalesce(s.id_provincia, n.id_provincia) AS id_provincia, 1 AS id_indicador, -1.0::DOUBLE AS valor_absoluto, CASE WHEN s.anio IS NULL THEN 'insertada' ELSE 'actualizada' END AS accion
FROM (SELECT anio + CASE WHEN mes = 1 THEN 10 ELSE 0 END AS anio, mes, id_provincia FROM n) q LEFT JOIN star s ON s.anio = q.anio AND s.mes = q.mes AND s.id_provincia = q.id_provincia AND s.id_indicador = 1
LEFT JOIN n ON n.anio + 10 = q.anio AND n.mes = q.mes AND n.id_provincia = q.id_provincia
UNION ALL SELECT anio, mes, id_provincia, id_indicador, valor_absoluto, 'igual' FROM star WHERE id_provincia IS NOT NULL AND (id_indicador = 2 OR mes = 1)
""")
def _(spark, d):
    target = star_fact(spark, d).filter("id_provincia IS NOT NULL").select(
        *upserts.FACT_KEY, "id_provincia", F.col("valor_absoluto").cast("double").alias("valor_absoluto"))
    prov, ind = provinces(spark, d), indicators(spark, d)
    rows = (
        target.filter("id_indicador = 1").join(prov, "id_provincia").join(ind, "id_indicador")
        .select((F.col("anio") + F.when(F.col("mes") == 1, 10).otherwise(0)).alias("anio"), "mes", "codigo_provincia", "codigo_indicador",
                F.lit(None).cast("int").alias("id_mercado"), F.lit(None).cast("int").alias("id_tipo_turismo"), F.lit(-1.0).alias("valor_absoluto"), F.lit(1).alias("orden"))
    )
    out = upserts.insert_facts(target, rows, [(prov, "codigo_provincia", "id_provincia", "codigo_provincia"), (ind, "codigo_indicador", "id_indicador", "codigo_indicador")], "orden")
    return out.select("anio", "mes", "id_provincia", "id_indicador", "valor_absoluto", "accion")


@query("X04_insert_fact_rows", """
SELECT o_orderkey, year(o_orderdate) AS anio, month(o_orderdate) AS mes, n_nationkey + 1 AS id_provincia, CAST(o_totalprice AS DOUBLE) AS valor_absoluto, 'insertada' AS accion
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
""")
def _(spark, d):
    """Rows given by codes into an empty fact, one fact per order."""
    prov, ind = provinces(spark, d), indicators(spark, d)
    customer = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = (
        table(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", F.year("o_orderdate").alias("anio"), F.month("o_orderdate").alias("mes"),
                F.format_string("%02d", "n_nationkey").alias("codigo_provincia"), F.lit("numero_turistas").alias("codigo_indicador"),
                F.lit(None).cast("int").alias("id_mercado"), F.lit(None).cast("int").alias("id_tipo_turismo"),
                F.col("o_totalprice").alias("valor_absoluto"), F.lit(1).alias("orden"))
    )
    keys = [*upserts.FACT_KEY, "o_orderkey"]
    empty = spark.createDataFrame([], "anio int, mes int, prov_key int, mercado_key int, tipo_key int, id_indicador int, ambito_geografico string, "
                                      "o_orderkey bigint, id_provincia int, valor_absoluto double")
    out = upserts.insert_facts(empty, rows, [(prov, "codigo_provincia", "id_provincia", "codigo_provincia"),
                                             (ind, "codigo_indicador", "id_indicador", "codigo_indicador")], "orden", keys)
    return out.select("o_orderkey", "anio", "mes", "id_provincia", "valor_absoluto", "accion")


@query("M05_build_calendar", """
SELECT anio * 100 + mes AS date_id, make_date(anio, mes, 1) AS fecha_periodo, anio, mes,
 (['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre'])[mes] AS mes_nombre_es,
 (['ene','feb','mar','abr','may','jun','jul','ago','sep','oct','nov','dic'])[mes] AS mes_nombre_abrev, (mes + 2) // 3 AS trimestre, CASE WHEN mes <= 6 THEN 1 ELSE 2 END AS semestre
FROM (SELECT unnest(range((SELECT min(year(o_orderdate)) FROM orders), (SELECT max(year(o_orderdate)) FROM orders) + 1)) AS anio) CROSS JOIN (SELECT unnest(range(1, 13)) AS mes)
""")
def _(spark, d):
    from marisma.sources.reference_data import calendar_of

    return calendar_of(table(spark, d, "orders"), "o_orderdate")


@query("J09_period_calendar", """
SELECT anio, mes, count(o_orderkey) AS n FROM (SELECT unnest(range(1995, 2002)) AS anio) CROSS JOIN (SELECT unnest(range(1, 13)) AS mes)
LEFT JOIN orders ON year(o_orderdate) = anio AND month(o_orderdate) = mes GROUP BY ALL
""")
def _(spark, d):
    from marisma.sources.reference_data import calendar_of

    o = table(spark, d, "orders")
    counts = o.groupBy(F.year("o_orderdate").alias("anio"), F.month("o_orderdate").alias("mes")).agg(F.count("*").alias("n"))
    return calendar_of(o, "o_orderdate").select("anio", "mes").join(counts, ["anio", "mes"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("M08_check_constraints", """
WITH o AS (SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 100 = 7 THEN 100000000 ELSE 0 END AS o_custkey, year(o_orderdate) + 26 AS anio, month(o_orderdate) + CASE WHEN o_orderkey % 50 = 3 THEN 12 ELSE 0 END AS mes FROM orders)
SELECT CAST(o_orderkey AS VARCHAR) AS clave, 'ck_mes' AS regla FROM o WHERE mes NOT BETWEEN 1 AND 12
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'ck_anio' FROM o WHERE anio NOT BETWEEN 2021 AND 2026
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'ck_fecha' FROM o WHERE o_orderkey % 50 = 3 OR o_orderkey % 40 = 11
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'fk_o_custkey' FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
""")
def _(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_custkey") + F.when(k % 100 == 7, 100000000).otherwise(0)).alias("o_custkey"),
        (F.year("o_orderdate") + 26).alias("anio"), (F.month("o_orderdate") + F.when(k % 50 == 3, 12).otherwise(0)).alias("mes"),
        F.make_date(F.year("o_orderdate") + 26, F.month("o_orderdate"), F.when(k % 40 == 11, 2).otherwise(1)).alias("fecha_periodo"))
    rules = {**upserts.fact_rules(), "ck_anio": F.col("anio").between(2021, 2026)}
    broken = upserts.check_rules(rows, "o_orderkey", rules)
    return broken.unionByName(upserts.check_foreign_key(rows, "o_orderkey", "o_custkey", table(spark, d, "customer"), "c_custkey"))


@query("M08_check_unique", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS dia, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("dia"))
    return upserts.check_unique(rows, ["o_custkey", "dia"])


@query("M08_table_counts", "SELECT 'orders' AS tabla, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'nation', count(*) FROM nation")
def _(spark, d):
    return upserts.table_counts({t: table(spark, d, t) for t in ("orders", "customer", "nation")})
