"""Chunk, vector and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import passages, query, table
from catalog.corpus import TITLE, docs, title_col, toks
from marisma.functions import fixed_values as fv
from marisma.functions import numbers, text
from marisma.operators import articles, evidence, search, text_index, vector_cells
from marisma.plans import news
from marisma.session import work_dir


def embeddings(spark, d):
    return table(spark, d, "embeddings")


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("V01_chunk_text")
def _(spark, d):
    return search.chunk_table(docs(spark, d), "doc_id", "text")


@query("V01_fixed_chunks", """
SELECT doc_id, i AS chunk_index, text[i * 800 + 1 : i * 800 + 1000] AS chunk_text, doc_id || '_' || i AS vector_id
FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(length(text) - 201, 0) // 800 + 1 AS BIGINT))) AS i FROM documents WHERE length(text) > 0)
WHERE trim(text[i * 800 + 1 : i * 800 + 1000], ' ' || chr(10) || chr(9)) <> ''
""")
def _(spark, d):
    return search.chunk_table(docs(spark, d), "doc_id", "text", fixed=True)


@query("V02_embed", r"""
WITH c AS (SELECT doc_id || '_' || i AS id, text[i * 800 + 1 : i * 800 + 1000] AS t FROM documents, range(10000) r(i)
  WHERE i * 800 < greatest(length(text) - 200, 1) AND trim(text[i * 800 + 1 : i * 800 + 1000], ' ' || chr(10) || chr(9)) <> ''),
 w AS (SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM (SELECT id, unnest(regexp_split_to_array(lower(t), '\s+')) AS w FROM c) WHERE w <> ''),
 b AS (SELECT id, h % 64 AS i, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END) AS n FROM w GROUP BY ALL),
 s AS (SELECT id, sqrt(sum(n * n)) AS size FROM b GROUP BY ALL)
SELECT id, CAST(i AS INT) AS i, round(CAST(CAST(n / size AS FLOAT) AS DOUBLE), 6) AS v FROM b JOIN s USING (id) WHERE n <> 0
""")
def _(spark, d):
    """Every component of every chunk's vector that is not zero."""
    chunked = search.chunk_table(docs(spark, d), "doc_id", "text", fixed=True)
    vectors = search.vector_table(chunked, "doc_id", dim=64)
    parts = vectors.select("id", F.posexplode("vector").alias("i", "v")).filter("v != 0")
    return parts.select("id", "i", F.round(F.col("v").cast("double"), 6).alias("v"))


@query("V03_l2_normalize", """
SELECT vec_id, i, round(CAST(embedding[i + 1] AS DOUBLE) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 9) AS v FROM embeddings, range(64) r(i)
""")
def _(spark, d):
    return embeddings(spark, d).select("vec_id", F.posexplode(numbers.l2_normalize(F.col("embedding"))).alias("i", "v")).withColumn("v", F.round("v", 9))


@query("V03_cosine_to_label_mean", """
WITH m AS (SELECT label, i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS v FROM embeddings, range(64) r(i) GROUP BY ALL),
 c AS (SELECT label, list(v ORDER BY i) AS centro FROM m GROUP BY ALL)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centro), 6) AS coseno FROM embeddings JOIN c USING (label)
""")
def _(spark, d):
    rows = embeddings(spark, d)
    center = rows.groupBy("label").agg(F.array(*[F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(64)]).alias("centro"))
    return rows.join(center, "label").select("vec_id", F.round(numbers.cosine(F.col("embedding"), F.col("centro")), 6).alias("coseno"))


def _vector_queries(spark, d):
    return embeddings(spark, d).filter("label = 3").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


@query("V04_search_vector", f"""
SELECT qid, vec_id, similitud, rango FROM (SELECT b.vec_id AS qid, a.vec_id, round({_COS}, 6) AS similitud,
  row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS} DESC, a.vec_id) AS rango FROM embeddings a, embeddings b WHERE b.label = 3) WHERE rango <= 10
""")
def _(spark, d):
    out = search.search_vector(embeddings(spark, d), "vec_id", "embedding", _vector_queries(spark, d), 10)
    return out.withColumn("similitud", F.round("similitud", 6))


@query("V04_search_cells", f"""
SELECT qid, vec_id, similitud, rango FROM (SELECT b.vec_id AS qid, a.vec_id, round({_COS}, 6) AS similitud,
  row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS} DESC, a.vec_id) AS rango FROM embeddings a, embeddings b WHERE b.vec_id % 5 = 0) WHERE rango <= 10
""")
def _(spark, d):
    """Every fifth vector asks all of them."""
    rows = embeddings(spark, d)
    cells = vector_cells.build_cells(rows, "vec_id", "embedding", work_dir(spark, "cells"))
    asked = rows.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    return vector_cells.search_cells(cells, asked, 10).withColumn("similitud", F.round("similitud", 6))


@query("T04_top_k_scored", f"""
SELECT vec_id, round(p, 6) AS puntuacion FROM (SELECT a.vec_id, CASE WHEN a.vec_id % 2 = 0 THEN 1.0 / (1e-9 + 1.5 - {_COS}) ELSE 1 + {_COS} END AS p
 FROM embeddings a, embeddings b WHERE b.vec_id = 0) ORDER BY p DESC, vec_id LIMIT 20
""")
def _(spark, d):
    one = embeddings(spark, d).filter("vec_id = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    scored = search.vector_scores(embeddings(spark, d), "vec_id", "embedding", one)
    rows = scored.select("vec_id", F.when(F.col("vec_id") % 2 != 0, 1 + F.col("similitud")).alias("score"), (1.5 - F.col("similitud")).alias("distancia"))
    return search.top_k_scored(rows, "score", "distancia", "vec_id", 20).select("vec_id", F.round("puntuacion", 6).alias("puntuacion"))


# queries: first sentence of each benchmark passage
def _text_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), title_col().alias("qtext"))


_LW = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
_BM25 = f"""
 q AS (SELECT DISTINCT item_id AS qid, unnest({_LW.format(TITLE)}) AS t FROM benchmark),
 d AS (SELECT doc_id, len(w) AS dl, w FROM (SELECT doc_id, {_LW.format('text')} AS w FROM documents)),
 s AS (SELECT count(*) AS n, avg(dl) AS media FROM d),
 tf AS (SELECT doc_id, dl, t, count(*) AS tf FROM (SELECT doc_id, dl, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
 df AS (SELECT t, count(*) AS df FROM tf GROUP BY ALL),
 bm AS (SELECT qid, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / media))) AS bm25
   FROM q JOIN tf USING (t) JOIN df USING (t), s GROUP BY ALL)
"""


@query("V05_search_keyword", f"""
WITH {_BM25} SELECT qid, doc_id, round(b, 6) AS bm25, rango FROM (SELECT qid, doc_id, round(bm25, 9) AS b, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, doc_id) AS rango FROM bm) WHERE rango <= 10
""")
def _(spark, d):
    out = search.search_keyword(docs(spark, d), "doc_id", F.col("text"), _text_queries(spark, d), 10)
    return out.withColumn("bm25", F.round("bm25", 6))


@query("V05_postings", f"""
SELECT doc_id, t AS termino, largo, count(*) AS tf FROM (SELECT doc_id, len(w) AS largo, unnest(w) AS t FROM (SELECT doc_id, {_LW.format('text')} AS w FROM documents)) GROUP BY ALL
""")
def _(spark, d):
    return search.postings(docs(spark, d), "doc_id", F.col("text"))


# queries of the stored index: every sentence of every benchmark passage
_SENTENCES = "(SELECT item_id * 1000 + i - 1 AS qid, s[i] AS q FROM (SELECT item_id, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT item_id, regexp_split_to_array(text, '[.]\\s+') AS s FROM benchmark)))"
_BM25_ALL = _BM25.replace(f"SELECT DISTINCT item_id AS qid, unnest({_LW.format(TITLE)}) AS t FROM benchmark", f"SELECT DISTINCT qid, unnest({_LW.format('q')}) AS t FROM {_SENTENCES}")


def _sentences(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", r"[.]\s+")).alias("n", "qtext"))
    return rows.select((F.col("item_id") * 1000 + F.col("n")).alias("qid"), "qtext")


_INDEXES: dict[tuple[str, str], text_index.TextIndex] = {}


def _index(spark, d):
    """One per session and folder of tables: built by the first query that needs it, read by all others."""
    place = (spark.sparkContext.applicationId, d)
    if place not in _INDEXES:
        _INDEXES[place] = text_index.build_index(docs(spark, d), "doc_id", F.col("text"), work_dir(spark, "text-index"))
    return _INDEXES[place]


@query("V05_index_levels", f"""
WITH d AS (SELECT doc_id, len(w) AS dl, w FROM (SELECT doc_id, {_LW.format('text')} AS w FROM documents)), s AS (SELECT avg(dl) AS media FROM d),
 tf AS (SELECT doc_id, dl, t, count(*) AS tf FROM (SELECT doc_id, dl, unnest(w) AS t FROM d) GROUP BY ALL),
 i AS (SELECT t, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / media)) AS impacto FROM tf, s)
SELECT t AS termino, count(*) AS n, round(max(impacto), 6) AS alto, round(min(impacto), 6) AS bajo FROM i GROUP BY t
""")
def _(spark, d):
    return _index(spark, d).words(spark).select("termino", "n", F.round("alto", 6).alias("alto"), F.round("bajo", 6).alias("bajo"))


@query("V05_search_stored", f"""
WITH {_BM25_ALL} SELECT qid, doc_id, round(b, 6) AS bm25, rango FROM (SELECT qid, doc_id, round(bm25, 9) AS b, row_number() OVER (PARTITION BY qid ORDER BY round(bm25, 9) DESC, doc_id) AS rango FROM bm) WHERE rango <= 10
""")
def _(spark, d):
    return text_index.search_index(_index(spark, d), _sentences(spark, d), 10).withColumn("bm25", F.round("bm25", 6))


@query("V06_search_hybrid", f"""
WITH {_BM25}, v AS (SELECT b.vec_id AS qid, a.vec_id AS doc_id, {_COS} AS sim FROM embeddings a, embeddings b WHERE b.vec_id < (SELECT count(*) FROM benchmark)),
 vn AS (SELECT qid, doc_id, (sim - min(sim) OVER w) / (max(sim) OVER w - min(sim) OVER w) AS sv FROM v WINDOW w AS (PARTITION BY qid)),
 bn AS (SELECT qid, doc_id, CASE WHEN max(bm25) OVER w > min(bm25) OVER w THEN (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) ELSE 1 END AS sb FROM bm WINDOW w AS (PARTITION BY qid)),
 m AS (SELECT qid, doc_id, round(coalesce(sv, 0) * 0.5 + coalesce(sb, 0) * 0.5, 9) AS p FROM vn FULL JOIN bn USING (qid, doc_id))
SELECT qid, doc_id, round(p, 6) AS puntuacion, rango FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY p DESC, doc_id) AS rango FROM m) WHERE rango <= 10
""")
def _(spark, d):
    vectors = embeddings(spark, d).select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = _text_queries(spark, d).join(embeddings(spark, d).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), "qid")
    out = search.search_hybrid(docs(spark, d), "doc_id", F.col("text"), vectors, "embedding", asked, 10)
    return out.withColumn("puntuacion", F.round("puntuacion", 6))


_HYBRID_ALL = f"""
WITH {_BM25_ALL}, v AS (SELECT x.qid, a.vec_id AS doc_id, {_COS} AS sim FROM embeddings a, embeddings b, {_SENTENCES} x WHERE b.vec_id = x.qid // 1000),"""


@query("V06_search_hybrid_stored", _HYBRID_ALL + f"""
 vn AS (SELECT qid, doc_id, (sim - min(sim) OVER w) / (max(sim) OVER w - min(sim) OVER w) AS sv FROM v WINDOW w AS (PARTITION BY qid)),
 bn AS (SELECT qid, doc_id, CASE WHEN max(bm25) OVER w > min(bm25) OVER w THEN (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) ELSE 1 END AS sb FROM bm WINDOW w AS (PARTITION BY qid)),
 m AS (SELECT qid, doc_id, round(coalesce(sv, 0) * 0.5 + coalesce(sb, 0) * 0.5, 9) AS p FROM vn FULL JOIN bn USING (qid, doc_id))
SELECT qid, doc_id, round(p, 6) AS puntuacion, rango FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY p DESC, doc_id) AS rango FROM m) WHERE rango <= 10
""")
def _(spark, d):
    """Every sentence with the vector of its passage."""
    vectors = embeddings(spark, d).select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = _sentences(spark, d).withColumn("vec_id", F.floor(F.col("qid") / 1000)).join(embeddings(spark, d).select("vec_id", F.col("embedding").alias("qvec")), "vec_id")
    return text_index.search_hybrid_stored(_index(spark, d), vectors, "embedding", asked, 10).withColumn("puntuacion", F.round("puntuacion", 6))


_NEWS_CTE = f"""
WITH n AS (SELECT doc_id AS id, {TITLE} AS title, text AS body, source AS url, CASE WHEN doc_id % 6 <> 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * doc_id END AS published FROM documents),
 x AS (SELECT id, len(w) AS dl, w FROM (SELECT id, {_LW.format("concat_ws(' ', title, body)")} AS w FROM n)), s AS (SELECT count(*) AS c, avg(dl) AS media FROM x),
 tf AS (SELECT id, dl, t, count(*) AS tf FROM (SELECT id, dl, unnest(w) AS t FROM x) WHERE t IN ('last', 'tion', 'para', 'des', 'mit') GROUP BY ALL),
 df AS (SELECT t, count(*) AS df FROM tf GROUP BY ALL),
 bm AS (SELECT id, round(sum(ln(1 + (c - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / media))), 9) AS bm25 FROM tf JOIN df USING (t), s GROUP BY ALL),
 f AS (SELECT n.*, bm25, CASE WHEN published >= date_trunc('day', m - INTERVAL 7 DAY) AND published < date_trunc('day', m) + INTERVAL 1 DAY THEN 0
   WHEN published >= date_trunc('day', m - INTERVAL 21 DAY) AND published < date_trunc('day', m) + INTERVAL 1 DAY THEN 1 ELSE 2 END AS tag
   FROM n JOIN bm USING (id), (SELECT max(published) AS m FROM n) WHERE title <> ''),
 b AS (SELECT * FROM f WHERE tag = (SELECT min(tag) FROM f) ORDER BY bm25 DESC, id LIMIT 30),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, url ORDER BY id) AS rn FROM b) WHERE rn = 1),
 r AS (SELECT k.*, coalesce(published >= (SELECT max(published) FROM n) - INTERVAL 7 DAY, false) AS recent FROM k),
 hits AS (SELECT * FROM r WHERE recent OR NOT (SELECT bool_or(recent) FROM r))
"""


def _news(spark, d):
    k = F.col("doc_id")
    return docs(spark, d).select(
        k.alias("id"), title_col().alias("title"), F.col("text").alias("body"), F.col("source").alias("url"),
        F.when(k % 6 != 0, F.timestamp_add("HOUR", k.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))).alias("published"))


@query("V07_news_search", _NEWS_CTE + "SELECT id, title, url, published, round(bm25, 6) AS bm25 FROM hits ORDER BY published DESC NULLS LAST, id")
def _(spark, d):
    rows = _news(spark, d)
    out = news.news_search(rows, "last tion para des mit", articles.as_of_max(rows, "published"))
    return out.select("id", "title", "url", "published", F.round("bm25", 6).alias("bm25"))


_LATEST_CTE = _NEWS_CTE.replace("('last', 'tion', 'para', 'des', 'mit')", "('últimas', 'erkeit')").replace(
    " b AS (SELECT * FROM f", " b1 AS (SELECT * FROM f").replace(" k AS (SELECT * FROM (SELECT", """ e AS (SELECT count(DISTINCT (title, url)) >= 12 AS enough FROM b1),
 b AS (SELECT * FROM b1 WHERE (SELECT enough FROM e) UNION ALL SELECT * FROM (SELECT * FROM f ORDER BY bm25 DESC, id LIMIT 16) WHERE NOT (SELECT enough FROM e)),
 k AS (SELECT * FROM (SELECT""")


@query("V07_news_search_latest", _LATEST_CTE + "SELECT id, title, url, published, round(bm25, 6) AS bm25 FROM hits ORDER BY published DESC NULLS LAST, id LIMIT 16")
def _(spark, d):
    """The newest week has few hits, so the best of any date answer."""
    rows = _news(spark, d)
    out = news.news_search(rows, "últimas erkeit", articles.as_of_max(rows, "published"))
    return out.select("id", "title", "url", "published", F.round("bm25", 6).alias("bm25"))


@query("N15_news_topic_and_tone", _NEWS_CTE + """
SELECT id, title FROM hits WHERE contains(lower(body), 'para') AND id % 3 = 0
""")
def _(spark, d):
    rows = _news(spark, d)
    hits = news.news_search(rows, "last tion para des mit", articles.as_of_max(rows, "published"))
    label = numbers.coverage_label(F.when(F.col("id") % 3 == 0, F.lit(0.9)).otherwise(F.lit(0.0)))
    return news.news_filter(hits, ["Para"], label, "positive").select("id", "title")


# ---------------------------------------------------------------- evidence ranking

def lw(x: str) -> str:
    return f"list_distinct(list_filter({toks(x)}, lambda t: length(t) > 2))"


_PAIRS = f"(SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS qid, b.q, d.text AS t FROM documents d JOIN (SELECT item_id, {TITLE} AS q FROM benchmark) b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)"
_REL = f"""CASE WHEN len({lw('q')}) = 0 THEN 0.5 ELSE least(1.0, len(list_intersect({lw('q')}, {lw('t')})) / len({lw('q')}) + CASE WHEN contains(lower(t), lower(q)) THEN 0.2 ELSE 0 END) END"""


def _pairs(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), title_col().alias("q"))
    return docs(spark, d).withColumn("qid", F.col("doc_id") % passages(spark, d)).join(q, "qid").withColumn("rel", search.relevance(F.col("q"), F.col("text")))


@query("V08_relevance", f"SELECT doc_id, round({_REL}, 9) AS rel FROM {_PAIRS}")
def _(spark, d):
    return _pairs(spark, d).select("doc_id", F.round("rel", 9).alias("rel"))


@query("J15_evidence_query_overlap", f"SELECT doc_id, qid, len(list_intersect({lw('q')}, {lw('t')})) AS comunes FROM {_PAIRS}")
def _(spark, d):
    """Overlap by exploded tokens and an equi join."""
    rows = _pairs(spark, d)

    def exploded(name):
        long = F.filter(text.tokens(F.col(name)), lambda t: F.length(t) > 2)
        return rows.select("doc_id", "qid", F.explode(F.array_distinct(long)).alias("t"))

    common = exploded("q").join(exploded("text"), ["doc_id", "qid", "t"]).groupBy("doc_id", "qid").agg(F.count("*").alias("comunes"))
    return rows.select("doc_id", "qid").join(common, ["doc_id", "qid"], "left").withColumn("comunes", F.coalesce("comunes", F.lit(0)))


@query("A23_evidence_relevance", f"SELECT qid, count(*) AS fuentes, round(avg(r), 6) AS media, round(max(r), 6) AS maxima FROM (SELECT qid, {_REL} AS r FROM {_PAIRS}) GROUP BY ALL")
def _(spark, d):
    out = evidence.relevance_summary(_pairs(spark, d), "qid", "rel")
    return out.select("qid", "fuentes", F.round("media", 6).alias("media"), F.round("maxima", 6).alias("maxima"))


@query("K12_enough_evidence", f"""
SELECT qid, n >= 2 AND (m >= 0.6 OR x >= 0.8 OR (n >= 3 AND m >= 0.4)) AS suficiente FROM (SELECT qid, count(*) AS n, avg(r) AS m, max(r) AS x FROM (SELECT qid, {_REL} AS r FROM {_PAIRS}) GROUP BY ALL)
""")
def _(spark, d):
    return evidence.relevance_summary(_pairs(spark, d), "qid", "rel").select("qid", "suficiente")


@query("T05_top_evidence", f"""
SELECT qid, doc_id, rango FROM (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(r, 9) DESC, doc_id) AS rango FROM (SELECT qid, doc_id, {_REL} AS r FROM {_PAIRS})) WHERE rango <= 3
""")
def _(spark, d):
    rows = _pairs(spark, d).select("qid", "doc_id", F.round("rel", 9).alias("rel"))
    return search.top_k(rows, "qid", "rel", "doc_id", 3).select("qid", "doc_id", "rango")


_AUTH = "CASE " + " ".join(f"WHEN contains(lower(url), '{n}') THEN {w}" for n, w in fv.DOMAIN_AUTHORITY) + " ELSE 0 END"
_TQ = "'en le des Über the der'"


@query("V09_prioritize_sources", f"""
SELECT page_id, round(0.5 + {_AUTH} * 0.3 + len(list_intersect(list_distinct({toks(_TQ)}), {toks('ti')})) / 6 * 0.4 + len(list_intersect(list_distinct({toks(_TQ)}), {toks('sn')})) / 6 * 0.3
 + CASE WHEN contains(lower(ti), 'über') THEN 0.2 ELSE 0 END, 9) AS prioridad FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS ti, regexp_extract(html, '<footer>(.*?)</footer>', 1, 's') AS sn FROM pages)
""")
def _(spark, d):
    p = search.source_priority(
        F.col("url"), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.regexp_extract("html", r"(?s)<footer>(.*?)</footer>", 1), F.lit("en le des Über the der"))
    return table(spark, d, "pages").select("page_id", F.round(p, 9).alias("prioridad")).orderBy(F.desc("prioridad"), "page_id")


@query("V10_select_evidence", f"""
SELECT qid, url, rango FROM (SELECT qid, url, row_number() OVER (PARTITION BY qid ORDER BY round(r, 9) DESC, url) AS rango FROM (
 SELECT qid, 'd' || doc_id AS url, {_REL} AS r, t FROM {_PAIRS} WHERE doc_id NOT IN (SELECT doc_id FROM labels)) WHERE len({toks('t')}) > 50) WHERE rango <= 2
""")
def _(spark, d):
    rows = _pairs(spark, d).select("qid", F.concat(F.lit("d"), "doc_id").alias("url"), F.round("rel", 9).alias("rel"), "text")
    visited = table(spark, d, "labels").select(F.concat(F.lit("d"), "doc_id").alias("url"))
    return search.select_evidence(rows, visited, "qid", "url", "rel", "text", 2).select("qid", "url", "rango")


_SUFFIX = ", ".join(f"('{n}', '{s}')" for n, s in fv.STRATEGY_SUFFIXES + fv.IMPROVEMENT_SUFFIXES)


@query("V11_query_variants", f"SELECT item_id, e AS estrategia, text || s AS variante FROM benchmark, (VALUES {_SUFFIX}) v(e, s)")
def _(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", "text")
    return search.query_variants(rows, "text", fv.STRATEGY_SUFFIXES + fv.IMPROVEMENT_SUFFIXES).drop("text")
