"""Registered queries of the operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marisma.llm import (
    bpe, decontaminate, exact_dedup, main_text, merkle, mixing, near_dedup, prefix_trie, quality, token_totals, toxicity, url_rules, warc,
)
from marisma.session import cut_lineage, work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    return decontaminate.find_windows(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@query("op1_decontamination", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
spans AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS span
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS p FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM spans),
runs AS (
  SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS span
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, sizes WHERE len(w) >= n)
), spots AS (SELECT doc_id, p, s.n, item_id FROM runs r JOIN spans s ON r.span = s.span AND r.n = s.n),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM spots) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM spots) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op1(spark, d):
    return contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


_PAIRS = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w
), u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
sets AS (SELECT min(doc_id) AS doc_id, any_value(len(s)) AS n, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
r AS (SELECT doc_id, n, unnest(s) AS g FROM sets),
df AS (SELECT g, count(*) AS c FROM r GROUP BY g HAVING count(*) > 1),
-- sets that reach 80 % share one of the rarest n - ceil(0.8 n) + 1 shingles
ranked AS (SELECT r.doc_id, r.n, r.g, row_number() OVER (PARTITION BY r.doc_id ORDER BY coalesce(c, 1), r.g) AS k FROM r LEFT JOIN df USING (g)),
prefix AS (SELECT doc_id, n, g FROM ranked WHERE k <= n - ceil(0.8 * n) + 1),
cand AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), link AS (
  SELECT a, b FROM cand JOIN r x ON x.doc_id = a JOIN r y ON y.doc_id = b AND x.g = y.g
  GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))
), edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
comp AS (SELECT doc_id, least(doc_id, min(b)) AS component FROM sets LEFT JOIN reach ON doc_id = a GROUP BY doc_id)
"""


@query("op2_near_duplicates", _PAIRS + """
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component, s.doc_id) AS component_id, s.doc_id = coalesce(component, s.doc_id) AS kept
FROM s LEFT JOIN sets ON list_sort(s.s) = sets.s LEFT JOIN comp ON comp.doc_id = sets.doc_id
""")
def op2(spark, d):
    return near_dedup.near_duplicates(table(spark, d, "documents"), near_dedup.NearConfig(shingle=2))


URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


@query("op3_url_filter", r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fit AS (
  SELECT page_id, host, path, h || rules.p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || rules.p) DESC NULLS LAST) AS k
  FROM p LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM fit WHERE k = 1
""")
def op3(spark, d):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, d, "pages"), rules)


@query("op6_exact_dedup", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS plain FROM documents),
r AS (SELECT doc_id, plain, row_number() OVER (PARTITION BY plain ORDER BY length(text) DESC, doc_id) AS k, count(*) OVER (PARTITION BY plain) AS n FROM t)
SELECT r.doc_id, s.doc_id AS keep_id, r.n AS group_size, r.k = 1 AS kept, sha256(r.plain) AS text_sha256 FROM r JOIN r s ON r.plain = s.plain AND s.k = 1
""")
def op6(spark, d):
    return exact_dedup.exact_duplicates(table(spark, d, "documents"))


@query("op7_bpe_round_trip")
def op7(spark, d):
    return bpe.round_trip(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op4_toxicity")
def op4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return toxicity.toxic_documents(docs, table(spark, d, "labels")).select(
        "doc_id", "toxic", *[F.col("toxicity")[c].alias(f"p_{c}") for c in toxicity.language_categories()]
    )


@query("op9_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages),
d AS (SELECT page_id, top, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h FROM p)
SELECT page_id, payload_bytes,
       array_to_string([list_extract(['A','B','C','D','E','F','G','H','I','J','K','L','M','N','O','P','Q','R','S','T','U','V','W','X','Y','Z','2','3','4','5','6','7'],
         1 + ((CAST('0x' || substr(h, 1 + 5 * CAST(k // 4 AS INT), 5) AS INT) >> (15 - 5 * (k % 4))) & 31)) FOR k IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
""")
def op9(spark, d):
    return warc.archive_pages(table(spark, d, "pages"))


@query("op10_main_text")
def op10(spark, d):
    return main_text.main_texts(table(spark, d, "pages"))


@query("op5_quality")
def op5(spark, d):
    return quality.rate_documents(table(spark, d, "documents"), table(spark, d, "labels"))


_CLEANED = r"[!#$%&*|]+"


@query("op8_token_totals", r"""
WITH t AS (
  SELECT d.doc_id, source, lang, toxic, CASE WHEN quality = 0 THEN regexp_replace(coalesce(text, ''), '[!#$%&*|]+', ' ', 'g') ELSE coalesce(text, '') END AS text
  FROM documents d LEFT JOIN labels USING (doc_id)
), n AS (
  SELECT doc_id, source, lang, 'space-1' AS tokenizer, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens FROM t WHERE coalesce(toxic, 0) <> 1
  UNION ALL
  SELECT doc_id, source, lang, 'alnum-1', len(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) FROM t WHERE coalesce(toxic, 0) <> 1
)
SELECT source, lang, tokenizer, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens FROM n GROUP BY ALL
""")
def op8(spark, d):
    """All documents come in; those labelled poor are cleaned and counted anew; those labelled toxic go; two batches come twice."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    home = work_dir(spark, "totals")
    # counts are taken where the texts are read; only counts meet the labels
    poor = token_totals.counted(docs, "revise", F.regexp_replace("text", _CLEANED, " ")).join(labels.filter("quality = 0").select("doc_id"), "doc_id")
    toxic = token_totals.counted(docs.withColumn("text", F.lit("")), "delete").join(labels.filter("toxic = 1").select("doc_id"), "doc_id")
    poor, toxic = cut_lineage(poor, "poor"), cut_lineage(toxic, "toxic")
    token_totals.commit_batch(spark, home, 1, token_totals.counted(docs, "insert"))
    token_totals.commit_batch(spark, home, 2, poor)
    token_totals.commit_batch(spark, home, 3, toxic)
    token_totals.commit_batch(spark, home, 3, toxic)
    token_totals.commit_batch(spark, home, 2, poor)
    return token_totals.totals(spark, home)


# CRC-32 of a decimal number, bit by bit
_CRC32 = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({c} AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


def lent_beginnings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation's first h turns are those of the conversation at the start of its twenty; h from a checksum of its number."""
    members = turns.select("conv_id").distinct()
    firsts = turns.filter("pos <= 3").withColumnRenamed("conv_id", "base")
    plan = (
        members.select("conv_id", F.expr("conv_id - conv_id % 20").alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).alias("h"))
        .join(firsts.groupBy("base").agg(F.max("pos").alias("there")), "base", "left")
        .withColumn("lent", F.least("h", F.coalesce("there", F.lit(0))))
    )
    own = turns.join(plan.select("conv_id", "h", "lent"), "conv_id").filter("pos > h")
    lent = plan.filter("lent > 0").join(firsts, "base").filter("pos <= lent")
    return members, own.select("conv_id", F.expr("pos - h + lent").alias("pos"), "digest", "words").unionByName(lent.select("conv_id", "pos", "digest", "words"))


@query("op11_prefix_trie", rf"""
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), m AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC32.format(c='conv_id')} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT m.conv_id, pos, role, text FROM m JOIN t ON t.conv_id = base AND pos <= h
  UNION ALL
  SELECT m.conv_id, pos - h + least(h, (SELECT count(*) FROM t b WHERE b.conv_id = base)), role, text FROM m JOIN t ON t.conv_id = m.conv_id AND pos > h
), walk(conv_id, depth, node, up, words) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '', '', CAST(0 AS BIGINT) FROM m
  UNION ALL
  SELECT w.conv_id, depth + 1, sha256(node || length(role) || ':' || role || text), node, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT)
  FROM walk w JOIN r ON r.conv_id = w.conv_id AND r.pos = depth + 1
), n AS (SELECT depth, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own FROM walk GROUP BY depth, node),
k AS (SELECT n.*, coalesce(c, 0) AS n_children FROM n LEFT JOIN (SELECT up AS node, count(*) AS c FROM n WHERE depth > 0 GROUP BY up) USING (node)),
over_all AS (
  SELECT a.node, sum(CASE WHEN k.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(k.own) AS saved
  FROM k JOIN walk p ON p.conv_id = k.conv_id AND p.depth <= k.depth JOIN n a ON a.node = p.node GROUP BY a.node
), ends AS (
  SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, max_by(node, depth) AS node FROM walk GROUP BY conv_id) GROUP BY node
)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM k JOIN over_all o USING (node) LEFT JOIN n p ON k.depth > 0 AND p.node = k.up LEFT JOIN ends e ON e.node = k.node
""")
def op11(spark, d):
    members, turns = lent_beginnings(cut_lineage(prefix_trie.ordered_turns(table(spark, d, "conversations")), "turns"))
    return prefix_trie.prefix_trie(members, turns)


@query("op12_source_mix")
def op12(spark, d):
    return mixing.mix(table(spark, d, "documents"), [1, 2, 3]).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def without_capitals(text):
    """A-Z lower-cased, other letters as they are; lower does that to a text of ASCII only, and faster than translate."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, capitals, capitals.lower()))


_LEAF = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))


@query("op13_merkle_manifest", f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('s' || lang, 'n') AS lang, sha256({_LEAF.replace('{text}', 'text')}) AS leaf,
         sha256({_LEAF.replace('{text}', "CASE WHEN " + _CRC32.format(c='doc_id') + " % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) AS claim
  FROM documents
), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot FROM d),
t(lang, lvl, spot, h, n) AS (
  SELECT lang, 0, spot, leaf, count(*) OVER (PARTITION BY lang) FROM p
  UNION ALL
  SELECT lang, lvl + 1, spot // 8, sha256(string_agg(h, '' ORDER BY spot)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY lang, lvl, spot // 8, n
), sub AS (SELECT lang, h, lvl AS top, row_number() OVER (ORDER BY lang) - 1 AS spot FROM t WHERE n = 1),
g(lvl, spot, h, n) AS (
  SELECT 0, spot, h, count(*) OVER () FROM sub
  UNION ALL
  SELECT lvl + 1, spot // 8, sha256(string_agg(h, '' ORDER BY spot)), (n + 7) // 8 FROM g WHERE n > 1 GROUP BY lvl, spot // 8, n
), nodes AS (SELECT lang, lvl, spot, h FROM t WHERE n > 1 UNION ALL SELECT sub.lang, top + lvl, g.spot, g.h FROM sub, g WHERE n > 1),
row_ids AS (SELECT p.*, row_number() OVER () AS id, sub.spot AS lang_at, top, sub.h AS subroot FROM p JOIN sub USING (lang)),
spots AS (
  SELECT id, lang, lvl, CASE WHEN lvl < top THEN CAST(spot // CAST(8 ** lvl AS BIGINT) AS BIGINT) ELSE CAST(lang_at // CAST(8 ** (lvl - top) AS BIGINT) AS BIGINT) END AS spot
  FROM row_ids JOIN (SELECT DISTINCT lang, lvl FROM nodes) USING (lang)
), steps AS (
  SELECT s.id, s.lvl, coalesce(string_agg(h, '' ORDER BY n.spot) FILTER (n.spot < s.spot), '') AS l, coalesce(string_agg(h, '' ORDER BY n.spot) FILTER (n.spot > s.spot), '') AS r
  FROM spots s JOIN nodes n ON n.lang = s.lang AND n.lvl = s.lvl AND n.spot // 8 = s.spot // 8 GROUP BY s.id, s.lvl, s.spot
), proofs AS (SELECT id, string_agg(l || r, '' ORDER BY lvl) AS proof, list(l || ',' || r ORDER BY lvl) AS path FROM steps GROUP BY id),
f AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM g WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(list_prepend(claim, coalesce(path, [])), lambda x, y: sha256(split_part(y, ',', 1) || x || split_part(y, ',', 2))) AS folded_root
  FROM row_ids LEFT JOIN proofs USING (id)
)
SELECT *, folded_root = root AS verified FROM f
""")
def op13(spark, d):
    """The manifest is of the table as it is; a third of the rows comes back with its capitals gone."""
    text = F.col("text")
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, without_capitals(text)).otherwise(text)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    # a column of its own: a leaf names a field three times, and each would be translated
    rows = table(spark, d, "documents").withColumn("changed", changed).select(
        F.col("doc_id").alias("id"), F.col("lang").alias("group"), merkle.leaf(*fields, text).alias("leaf"), merkle.leaf(*fields, F.col("changed")).alias("claim")
    )
    return merkle.manifest(rows).withColumnRenamed("id", "doc_id")
