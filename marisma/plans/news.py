"""News search: keyword hits, narrowed to a date window, without repeats, newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.functions import fixed_values as fv
from marisma.operators import articles, search
from marisma.operators.dedup import first_articles
from marisma.session import cut_lineage


def news_search(news: DataFrame, query: str, as_of: Column, limit: int = 30, latest_limit: int = 16,
                latest_min: int = 12, recent_days: int = fv.SEARCH_RECENT_DAYS) -> DataFrame:
    """Articles (id, title, body, url, published) for one query.

    The smallest date window with a hit wins.  A query for the latest news that so finds fewer than
    latest_min articles is answered by the latest_limit best hits of any date instead, and is cut to
    latest_limit.  Repeats of (title, url) are dropped, undated rows come last.
    """
    wants_latest = any(word in query.lower() for word in fv.RECENCY_WORDS)
    asked = news.sparkSession.range(1).select(F.lit(0).alias("qid"), F.lit(query).alias("qtext"))
    body = F.concat_ws(" ", "title", "body")
    hits = search.keyword_scores(news, "id", body, asked).select("id", F.round("bm25", 9).alias("bm25"))
    # the window and the ranking need no texts: whole articles join the few rows that are left
    dated = news.filter(F.col("title") != "").select("id", "published")
    windowed = articles.smallest_window(dated.join(hits, "id"), "published", as_of, fv.SEARCH_WINDOWS_DAYS)
    best = windowed.orderBy(F.desc("bm25"), "id").limit(limit).select("id", "bm25")
    best = cut_lineage(news.join(best, "id"), "hits")  # at most limit rows, looked at twice below
    kept = first_articles(best, ["title", "url"], "id")
    if wants_latest and kept.count() < latest_min:
        direct = dated.join(hits, "id").orderBy(F.desc("bm25"), "id").limit(latest_limit).select("id", "bm25")
        kept = first_articles(cut_lineage(news.join(direct, "id"), "hits"), ["title", "url"], "id")
    recent = articles.search_recent(kept, "published", as_of, recent_days)
    ordered = articles.newest_first(recent, "published", "id")
    return ordered.limit(latest_limit) if wants_latest else ordered


def news_filter(hits: DataFrame, all_words: list[str] | None = None, label: Column | None = None,
                tone: str | None = None, person: str | None = None, persons: str = "persons") -> DataFrame:
    """Narrow hits to articles with every word, a tone, or a named person."""
    for word in all_words or []:
        hits = hits.filter(F.contains(F.lower("body"), F.lit(word.lower())))
    if tone:
        hits = hits.filter(label == tone)
    if person:
        hits = hits.filter(F.array_contains(persons, person))
    return hits
