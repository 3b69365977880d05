"""Chunks, vectors, and keyword, vector and hybrid search.

Queries are a table (qid, ...), so one job answers many.  The query side of a
vector scan is shipped to the tasks and its size is checked; more queries than
fit one block are answered block by block over the same table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marisma.functions import chunking
from marisma.functions import fixed_values as fv
from marisma.functions import numbers, text

BLOCK_BYTES = 16 * 1024 * 1024  # queries shipped to a task at once
HITS_IN_TASK = 2_000_000  # pairs of a query and a posting that a task adds up, about
SCORES_IN_MEMORY = 1_000_000  # row-by-query scores a task holds at once


# ---------------------------------------------------------------- chunks and vectors

def chunk_table(docs: DataFrame, key: str, body: str, size: int = 1000, overlap: int = 200, fixed: bool = False) -> DataFrame:
    """One row per chunk with its index and id; blank chunks are skipped, their index is not reused."""
    cut = chunking.fixed_chunks if fixed else chunking.chunks
    rows = docs.select(key, F.posexplode(cut(F.col(body), size, overlap)).alias("chunk_index", "chunk_text"))
    rows = rows.filter(~text.is_blank(F.col("chunk_text")))
    return rows.withColumn("vector_id", F.concat_ws("_", F.col(key), F.col("chunk_index")))


def vector_table(chunked: DataFrame, key: str, dim: int = 384, model=None, max_text: int | None = None) -> DataFrame:
    """Rows of the vector collection; max_text cuts the stored text to what a store allows."""
    return chunked.select(
        F.col("vector_id").alias("id"),
        chunking.embed(F.col("chunk_text"), dim, model).alias("vector"),
        F.col(key).alias("document_id"),
        "chunk_index",
        (F.substring("chunk_text", 1, max_text) if max_text else F.col("chunk_text")).alias("text"),
    )


# ---------------------------------------------------------------- top k

def top_k(df: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows per group; each map task keeps at most k per group before the shuffle."""
    best = W.partitionBy(group).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("rango", F.row_number().over(best)).filter(F.col("rango") <= k)


def top_k_scored(df: DataFrame, score: str, distance: str, tie: str, k: int) -> DataFrame:
    """Best rows by score; a row without one is scored by its distance."""
    by_distance = 1.0 / (F.lit(1e-9) + F.col(distance))
    rows = df.withColumn("puntuacion", F.coalesce(F.col(score), by_distance))
    return rows.orderBy(F.desc("puntuacion"), tie).limit(k)


# ---------------------------------------------------------------- vector search

def _query_blocks(queries: DataFrame, vector: str) -> list[tuple[int, int]]:
    """(first, last) number ranges of the queries so that a block stays under the byte limit."""
    stats = queries.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("dim")).first()
    if not stats["n"]:
        return []
    per_block = max(1, BLOCK_BYTES // (8 * max(1, stats["dim"])))
    return [(a, min(a + per_block, stats["n"]) - 1) for a in range(0, stats["n"], per_block)]


def first_k(sims: np.ndarray, k: int) -> np.ndarray:
    """Which of the scores (rows in order of key, by queries) are among the k best of their query; equal ones go by key."""
    if len(sims) <= k:
        return np.ones(sims.shape, dtype=bool)
    last = np.partition(sims, len(sims) - k, axis=0)[len(sims) - k]
    above, ties = sims > last, sims == last
    room = k - above.sum(axis=0)
    if (ties.sum(axis=0) > room).any():
        ties &= ties.cumsum(axis=0, dtype=np.int32) <= room
    return above | ties


def vector_scores(table: DataFrame, key: str, vector: str, queries: DataFrame, qid: str = "qid",
                  qvec: str = "qvec", k: int | None = None, bounds: bool = False) -> DataFrame:
    """(qid, key, similitud): cosine of every query with every row, or the k best per task.

    bounds adds the smallest and largest cosine of each task as rows with a null key.

    The rows stay where they are; one block of queries (at most BLOCK_BYTES) goes
    to the tasks.  With k set a task keeps a running best of k rows per query, equal
    scores by key, and emits it at its end: what it holds and what is shuffled later is small.
    """
    from marisma.session import cut_lineage

    key_type = table.schema[key].dataType.simpleString()
    qid_type = queries.schema[qid].dataType.simpleString()
    schema = f"{qid} {qid_type}, {key} {key_type}, similitud double"
    blocks = _query_blocks(queries, qvec)
    if not blocks:
        return table.sparkSession.createDataFrame([], schema)
    numbered = queries.select(qid, qvec)
    if len(blocks) > 1:
        # a stable dense number splits the queries; the counts come from the same frozen rows
        from marisma.operators.series import number_rows

        hashed = numbered.withColumn("_h", F.pmod(F.xxhash64(qid), F.lit(2**40)) * 1.0)
        numbered = cut_lineage(number_rows(hashed.withColumn("_all", F.lit(0)), ["_all"], "_h", "_n"), "queries")

    def scan(ids: list, matrix: np.ndarray):
        unit = matrix / np.where((n := np.linalg.norm(matrix, axis=1, keepdims=True)) == 0, np.nan, n)
        names = np.array(ids)
        step = max(1, SCORES_IN_MEMORY // len(ids))

        def best(held: list[pd.DataFrame], floor: np.ndarray) -> pd.DataFrame:
            """The k best of each query; floor becomes the k-th score."""
            rows = pd.concat(held)
            of, sims = rows["of"].to_numpy(), rows["similitud"].to_numpy()
            order = np.lexsort((pd.factorize(rows[key], sort=True)[0], -sims, of))
            first = np.flatnonzero(np.diff(of[order], prepend=-1))
            size = np.diff(np.append(first, len(order)))
            full = size >= k
            floor[of[order[first[full]]]] = sims[order[first[full] + k - 1]]
            return rows.iloc[order[np.arange(len(order)) - np.repeat(first, size) < k]]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, waiting = [], 0
            low, high, floor = np.full(len(ids), np.inf), np.full(len(ids), -np.inf), np.full(len(ids), -np.inf)
            for batch in batches:
                for start in range(0, len(batch), step):
                    pdf = batch.iloc[start:start + step].sort_values(key, kind="stable", na_position="first")
                    rows = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                    length = np.linalg.norm(rows, axis=1, keepdims=True)
                    sims = (rows / np.where(length == 0, np.nan, length)) @ unit.T
                    known = ~np.isnan(sims)
                    ranked = np.where(known, sims, -np.inf)
                    low, high = np.minimum(low, np.where(known, sims, np.inf).min(axis=0)), np.maximum(high, ranked.max(axis=0))
                    if k is not None:
                        known &= (ranked >= floor) & first_k(ranked, k)
                    at, of = np.nonzero(known)
                    found = pd.DataFrame({"of": of.astype(np.int32), key: pdf[key].to_numpy()[at], "similitud": sims[at, of]})
                    if k is None:
                        yield found.assign(**{qid: names[of]})[[qid, key, "similitud"]]
                        continue
                    held.append(found)
                    waiting += len(found)
                    if waiting > k * len(ids) + SCORES_IN_MEMORY:
                        held = [best(held, floor)]
                        waiting = len(held[0])
            if held:
                rows = best(held, floor)
                yield pd.DataFrame({qid: names[rows["of"].to_numpy()], key: rows[key].to_numpy(), "similitud": rows["similitud"].to_numpy()})
            if bounds:
                seen = np.isfinite(high)
                ends = np.concatenate([low[seen], high[seen]])
                yield pd.DataFrame({qid: np.tile(names[seen], 2), key: [None] * len(ends), "similitud": ends})

        return run

    out = None
    for first, last in blocks:
        part = numbered if len(blocks) == 1 else numbered.filter(F.col("_n").between(first + 1, last + 1))
        rows = part.select(qid, qvec).collect()  # one block, bounded by BLOCK_BYTES
        fn = scan([r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64))
        scored = table.select(key, vector).mapInPandas(fn, schema)
        out = scored if out is None else out.unionByName(scored)
    return out


def search_vector(table: DataFrame, key: str, vector: str, queries: DataFrame, k: int, **names) -> DataFrame:
    """The k nearest rows per query by cosine, exact."""
    qid = names.get("qid", "qid")
    return top_k(vector_scores(table, key, vector, queries, k=k, **names), qid, "similitud", key, k)


# ---------------------------------------------------------------- keyword search

def postings(docs: DataFrame, key: str, body: Column) -> DataFrame:
    """(termino, key, tf, largo): the posting table.  Write it bucketed by termino to reuse it."""
    # the length is a column of its own below the explode, or it would be counted again for every token
    sized = docs.select(key, text.words(F.lower(body)).alias("_t")).withColumn("largo", F.size("_t"))
    rows = sized.select(key, "largo", F.explode("_t").alias("termino"))
    return rows.groupBy(key, "largo", "termino").agg(F.count("*").alias("tf"))


def posting_slice(docs: DataFrame, key: str, body: Column, wanted: DataFrame) -> DataFrame:
    """Posting rows of the wanted words, and one row with the null word per document for its length.

    The corpus is read and split into words once.  The word list is joined right
    after the explode, so other tokens never reach a shuffle; the result is
    written out because three later steps need it.
    """
    from marisma.session import cut_lineage

    sized = docs.select(key, text.words(F.lower(body)).alias("_t")).withColumn("largo", F.size("_t"))
    # the document itself is a token no word can equal, different for each so that they spread
    own = F.concat(F.lit("\u0000"), F.col(key).cast("string"))
    marked = sized.withColumn("_t", F.concat(F.array(own), F.col("_t")))
    found = marked.select(key, "largo", F.explode("_t").alias("termino")).join(
        wanted.withColumn("_hit", F.lit(True)), "termino", "left"
    )
    word = F.when(F.col("_hit"), F.col("termino"))
    kept = found.filter(F.col("_hit") | F.col("termino").startswith("\u0000")).withColumn("termino", word)
    return cut_lineage(kept.groupBy(key, "largo", "termino").agg(F.count("*").alias("tf")), "postings")


def keyword_scores(docs: DataFrame, key: str, body: Column, queries: DataFrame, qid: str = "qid",
                   qtext: str = "qtext", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, key, bm25) for every document that holds a query word."""
    asked = queries.select(qid, F.explode(F.array_distinct(text.words(F.lower(F.col(qtext))))).alias("termino"))
    rows = posting_slice(docs, key, body, asked.select("termino").distinct())
    whole, tf = rows.filter(F.col("termino").isNull()), rows.filter(F.col("termino").isNotNull())
    n_docs, mean = whole.agg(F.count("*")).scalar(), whole.agg(F.avg("largo")).scalar()
    df = tf.groupBy("termino").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df, "termino").select(qid, "termino", idf.alias("idf"))
    gain = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("largo") / mean))
    # a document's postings lie together, so a task adds up all its scores; there are as many tasks as the hits need
    hits = asked.join(df, "termino").agg(F.sum("df")).first()[0] or 0
    tf = tf.repartition(max(1, -(-hits // HITS_IN_TASK)), key)
    return tf.join(weights, "termino").groupBy(qid, key).agg(F.sum(gain).alias("bm25"))


def search_keyword(docs: DataFrame, key: str, body: Column, queries: DataFrame, k: int, **names) -> DataFrame:
    scored = keyword_scores(docs, key, body, queries, **names)
    # sums in different orders differ in the last digits: rank on a rounded score, then on the key
    scored = scored.withColumn("bm25", F.round("bm25", 9))
    return top_k(scored, names.get("qid", "qid"), "bm25", key, k)


# ---------------------------------------------------------------- hybrid search

def scaled(score: str, low: str, high: str) -> Column:
    span = F.col(high) - F.col(low)
    unit = F.when(span > 0, (F.col(score) - F.col(low)) / span).otherwise(F.lit(1.0))
    return F.when(F.col(score).isNotNull(), unit).otherwise(F.lit(0.0))


def search_hybrid(docs: DataFrame, key: str, body: Column, vectors: DataFrame, vector: str, queries: DataFrame,
                  k: int, alpha: float = 0.5, qid: str = "qid", qtext: str = "qtext", qvec: str = "qvec") -> DataFrame:
    """alpha * vector + (1 - alpha) * keyword, each scaled to 0..1 per query over all its candidates.

    A document found by one side only scores zero on the other.  The result is
    exact without scoring every pair in the open: a document without a query word
    has only its vector part, so it must be among the k nearest; keyword hits get
    their cosine by a join, but only those whose keyword part leaves them a chance.
    """
    from marisma.session import cut_lineage

    near = cut_lineage(vector_scores(vectors, key, vector, queries, qid, qvec, k, bounds=True), "nearest")
    v_ends = near.filter(F.col(key).isNull()).groupBy(qid).agg(F.min("similitud").alias("_v0"), F.max("similitud").alias("_v1"))
    words = cut_lineage(keyword_scores(docs, key, body, queries, qid, qtext), "hits")
    w_ends = words.groupBy(qid).agg(F.min("bm25").alias("_w0"), F.max("bm25").alias("_w1"))
    # lengths are taken once per vector, before the join multiplies the rows
    sized = vectors.select(key, vector, numbers.norm(F.col(vector)).alias("_l"))
    asked = queries.select(qid, qvec, numbers.norm(F.col(qvec)).alias("_q"))
    cosine = F.try_divide(numbers.dot(F.col(vector), F.col(qvec)), F.col("_l") * F.col("_q"))
    ends = v_ends.join(w_ends, qid, "full_outer")

    def mixed(hits: DataFrame, nearest: DataFrame | None = None) -> DataFrame:
        """Scores of keyword hits, and of rows that only their vector brings in."""
        found = hits.select(qid, key).join(sized, key).join(asked, qid).select(qid, key, cosine.alias("similitud"))
        if nearest is not None:
            found = found.unionByName(nearest).groupBy(qid, key).agg(F.max("similitud").alias("similitud"))
        both = found.join(hits, [qid, key], "full_outer").join(ends, qid, "left")
        score = scaled("similitud", "_v0", "_v1") * alpha + scaled("bm25", "_w0", "_w1") * (1 - alpha)
        return both.select(qid, key, F.round(score, 9).alias("puntuacion"))

    # the k best by either side are scored first; their k-th score is what the others have to reach
    nearest = near.filter(F.col(key).isNotNull())
    lead = nearest.select(qid, key).union(top_k(words, qid, "bm25", key, k).select(qid, key)).distinct()
    first = cut_lineage(mixed(words.join(lead, [qid, key], "left_semi"), nearest), "first")
    reach = top_k(first, qid, "puntuacion", key, k).filter(F.col("rango") == k).select(qid, F.col("puntuacion").alias("_t"))
    # each task keeps its own k nearest; a row it cut has k rows at least as near, so it is at most as near as the k-th of all
    last = top_k(nearest, qid, "similitud", key, k).filter(F.col("rango") == k).select(qid, F.col("similitud").alias("_n"))
    limits = ends.join(reach, qid, "left").join(last, qid, "left")
    bound = F.when(F.col("_n").isNotNull(), scaled("_n", "_v0", "_v1")).otherwise(1.0) * alpha + scaled("bm25", "_w0", "_w1") * (1 - alpha)
    rest = words.join(lead, [qid, key], "left_anti").join(limits, qid).filter(F.col("_t").isNull() | (bound >= F.col("_t") - 1e-8)).select(words.columns)
    return top_k(first.unionByName(mixed(rest)), qid, "puntuacion", key, k)


# ---------------------------------------------------------------- evidence ranking

def relevance(query: Column, body: Column) -> Column:
    """Share of the longer query words found in the text, plus a bonus for the whole phrase, within 0..1."""

    def long_words(col: Column) -> Column:
        return F.array_distinct(F.filter(text.tokens(col), lambda t: F.length(t) > 2))

    asked, have = long_words(query), long_words(body)
    share = F.size(F.array_intersect(asked, have)) / F.size(asked)
    phrase = F.when(F.contains(F.lower(body), F.lower(query)), 0.2).otherwise(0.0)
    return F.when(F.size(asked) == 0, F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share + phrase)))


def source_priority(url: Column, title: Column, snippet: Column, query: Column) -> Column:
    """Order in which to open search results."""
    authority = F.lit(0.0)
    for needle, weight in reversed(fv.DOMAIN_AUTHORITY):
        authority = F.when(F.contains(F.lower(url), F.lit(needle)), F.lit(weight)).otherwise(authority)
    asked = F.array_distinct(text.tokens(query))
    n = F.greatest(F.size(asked), F.lit(1))
    in_title = F.size(F.array_intersect(asked, text.tokens(title))) / n
    in_snippet = F.size(F.array_intersect(asked, text.tokens(snippet))) / n
    low_title = F.lower(title)
    named = F.exists(text.tokens(query), lambda t: (F.length(t) > 3) & F.contains(low_title, t))
    return 0.5 + authority * 0.3 + in_title * 0.4 + in_snippet * 0.3 + F.when(named, 0.2).otherwise(0.0)


def select_evidence(results: DataFrame, visited: DataFrame, qid: str, url: str, score: str, body: str,
                    per_query: int = 3, min_words: int = 50) -> DataFrame:
    """Unvisited results with enough text, best first, a few per query."""
    fresh = results.join(visited.select(url).distinct(), url, "left_anti")
    fresh = fresh.filter(F.size(text.tokens(F.col(body))) > min_words)
    return top_k(fresh, qid, score, url, per_query)


def query_variants(queries: DataFrame, qtext: str, suffixes: list[tuple[str, str]]) -> DataFrame:
    """One row per query and strategy."""
    options = F.array(*[F.struct(F.lit(n).alias("estrategia"), F.lit(s).alias("sufijo")) for n, s in suffixes])
    rows = queries.withColumn("_o", F.explode(options))
    return rows.withColumns(
        {"estrategia": F.col("_o.estrategia"), "variante": F.concat(F.col(qtext), F.col("_o.sufijo"))}
    ).drop("_o")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
