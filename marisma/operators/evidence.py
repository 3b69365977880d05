"""Claims against evidence: scores per source family, verdicts, text spans, quality of answers."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush
from itertools import pairwise

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marisma.functions import fixed_values as fv
from marisma.functions import text
from marisma.operators.series import number_rows


# ---------------------------------------------------------------- scores per family

def press_evidence(mentions: DataFrame, claim: str = "claim_id") -> DataFrame:
    """Distinct named sources and number of mentions per claim."""
    source = text.truthy(F.col("fuente"))
    return mentions.groupBy(claim).agg(F.count_distinct(source).alias("fuentes"), F.count("*").alias("menciones"))


def press_score(contradicted: Column, sources: Column, mentions: Column) -> Column:
    """(score, supporting) from newspaper mentions; counts may be null for no evidence."""
    sources, mentions = F.coalesce(sources, F.lit(0)), F.coalesce(mentions, F.lit(0))
    score = (
        F.when(F.coalesce(contradicted, F.lit(False)), -2)
        .when(sources >= 2, 3).when(sources == 1, 2).when(mentions > 0, 1).otherwise(0)
    )
    support = F.when(score <= 0, 0).when(sources >= 2, sources).otherwise(1)
    return F.struct(score.alias("puntuacion"), support.cast("bigint").alias("apoyos"))


def web_evidence(web: DataFrame, claim: str = "claim_id") -> DataFrame:
    contradicts = F.coalesce(F.col("stance") == "contradictory", F.lit(False))
    return web.groupBy(claim).agg(
        F.bool_or(contradicts).alias("web_contradice"),
        F.count_if((F.col("type") == "official") & ~contradicts).alias("web_oficiales"),
        F.count("*").alias("web_resultados"),
    )


def web_score(contradicted: Column, official: Column, results: Column) -> Column:
    score = (
        F.when(F.coalesce(contradicted, F.lit(False)), -1)
        .when(F.coalesce(official, F.lit(0)) > 0, 2).when(F.coalesce(results, F.lit(0)) > 0, 1).otherwise(0)
    )
    return F.struct(score.alias("puntuacion"), F.when(score > 0, 1).otherwise(0).cast("bigint").alias("apoyos"))


def official_score(tagged: Column, claim_value: Column, official_value: Column, present: Column) -> Column:
    """(score, match) against official statistics; only claims with the domain tag are compared.

    present: there is a statistics row for the claim, be its number null.
    """
    diff = F.abs(claim_value - official_value)
    relative = diff / F.greatest(official_value, F.lit(1.0))
    known = claim_value.isNotNull() & official_value.isNotNull()
    score = F.when(~F.coalesce(tagged, F.lit(False)) | ~known, 0).when(diff == 0, 3).when(relative <= 0.1, 2).otherwise(-3)
    match = (
        F.when(~F.coalesce(tagged, F.lit(False)), F.lit("no_aplica"))
        .when(~F.coalesce(present, F.lit(False)), F.lit("no_disponible"))
        .when(~known, F.lit("datos_insuficientes"))
        .when(diff == 0, F.lit("exacta")).when(relative <= 0.1, F.lit("aproximada")).otherwise(F.lit("contradictoria"))
    )
    return F.struct(
        score.alias("puntuacion"), match.alias("coincidencia"), F.when(score > 0, 1).otherwise(0).cast("bigint").alias("apoyos")
    )


def verdict(total: Column, supporting: Column) -> Column:
    return F.when((total >= 5) & (supporting >= 2), F.lit(fv.VERDICT_TRUE)).otherwise(F.lit(fv.VERDICT_FALSE))


def signed_score(state: Column, total: Column) -> Column:
    """Verdict and total on a scale of -1..1."""
    low, t = F.lower(F.coalesce(state, F.lit(""))), total.cast("double")
    yes = F.least(F.lit(1.0), F.greatest(F.lit(0.5), F.when(t == 0, F.lit(1.0)).otherwise(t / 10)))
    no = F.greatest(F.lit(-1.0), F.least(F.lit(-0.5), F.when(t == 0, F.lit(-1.0)).otherwise(-F.abs(t) / 10)))
    return F.when(low == "verdadera", yes).when(low == "falsa", no).otherwise(F.lit(0.0))


def score_claims(claims: DataFrame, mentions: DataFrame, web: DataFrame, official: DataFrame,
                 claim: str = "claim_id") -> DataFrame:
    """Claims with the scores of the three families, total, support, verdict and signed score.

    claims needs tagged, claim_value and resumen (summary of the press answer).
    Evidence is reduced to one row per claim before it is joined; of several official values the
    smallest counts.
    """
    joined = (
        claims.join(press_evidence(mentions, claim), claim, "left")
        .join(web_evidence(web, claim), claim, "left")
        .join(official.groupBy(claim).agg(F.min("value").alias("official_value"), F.lit(True).alias("_present")), claim, "left")
    )
    scored = joined.withColumns(
        {
            "_press": press_score(text.is_contradiction(F.col("resumen")), F.col("fuentes"), F.col("menciones")),
            "_web": web_score(F.col("web_contradice"), F.col("web_oficiales"), F.col("web_resultados")),
            "_stat": official_score(F.col("tagged"), F.col("claim_value"), F.col("official_value"), F.col("_present")),
        }
    )
    total = F.col("_press.puntuacion") + F.col("_web.puntuacion") + F.col("_stat.puntuacion")
    support = F.col("_press.apoyos") + F.col("_web.apoyos") + F.col("_stat.apoyos")
    return scored.withColumns(
        {
            "prensa": F.col("_press.puntuacion"), "web": F.col("_web.puntuacion"), "oficial": F.col("_stat.puntuacion"),
            "coincidencia": F.col("_stat.coincidencia"), "total": total, "apoyos": support,
            "veredicto": verdict(total, support), "escala": signed_score(verdict(total, support), total),
        }
    ).drop("_press", "_web", "_stat", "_present")


def headlines(title: Column, state: Column, score: Column) -> Column:
    """(kind, short title): false or negative is critical, near zero is ambiguous, else null kind."""
    low = F.lower(F.coalesce(state, F.lit("")))
    kind = (
        F.when((low == "falsa") | (score < 0), F.lit("critica"))
        .when(score.between(0, 0.2) | ~low.isin("verdadera", "falsa"), F.lit("ambigua"))
    )
    return F.struct(kind.alias("tipo"), text.truncate(title, 50, "...").alias("titulo"))


def bibliography(refs: DataFrame, claim: str, order: str) -> DataFrame:
    """References of a claim without repeats, numbered in order of first use.

    A reference is known by its URL, or by source and title if it has none.
    """
    source, title, url = (F.coalesce(F.col(c), F.lit("")) for c in ("fuente", "title", "url"))
    rows = refs.select(claim, order, source.alias("fuente"), title.alias("title"), url.alias("url")).filter(
        (F.col("title") != "") | (F.col("url") != "")
    )
    key = F.when(F.col("url") != "", F.col("url")).otherwise(F.concat("fuente", F.lit("|"), "title"))
    first = rows.groupBy(claim, key.alias("_ref")).agg(F.min(F.struct(order, "fuente", "title", "url")).alias("r"))
    flat = first.select(
        claim, F.col(f"r.{order}").alias(order),
        F.coalesce(text.truthy(F.col("r.fuente")), F.lit(fv.UNKNOWN_SOURCE_LABEL)).alias("fuente"),
        text.truncate(F.col("r.title"), 100, "...").alias("title"), F.col("r.url").alias("url"),
    )
    return number_rows(flat, [claim], order, "id")


# ---------------------------------------------------------------- text spans

def _let(value: Column, use) -> Column:
    """Evaluate a value once inside a lambda and use it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def claim_spans(low: Column, claims: Column) -> Column:
    """Array of (start, end) per claim: searched after the claim before, else from the start; (0, 0) if absent.

    low is the lower-case text; give it as a column of its own, so that it is made once per row.
    """
    state = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, claim: Column) -> Column:
        def placed(needle: Column, at: Column) -> Column:
            found = at > 0
            start = F.when(found, at - 1).otherwise(F.lit(0))
            end = F.when(found, at - 1 + F.length(needle)).otherwise(F.lit(0))
            span = F.array(F.struct(start.alias("start"), end.alias("end")))
            return F.struct(F.when(found, end).otherwise(state["pos"]).alias("pos"), F.concat(state["spans"], span).alias("spans"))

        def search(needle: Column) -> Column:
            later = F.nullif(F.position(needle, low, state["pos"] + 1), F.lit(0))
            first = F.when(needle != "", F.coalesce(later, F.position(needle, low, F.lit(1)))).otherwise(F.lit(0))
            return _let(first, lambda at: placed(needle, at))

        return _let(F.lower(text.strip(claim)), search)

    return F.aggregate(claims, state, step, lambda s: s["spans"])


def sweep(starts: list[int], ends: list[int], length: int) -> Iterator[tuple[int, int, int | None]]:
    """(start, end, last claim that covers it) of the stretches between the claims' ends, in n log n.

    Claims are opened in order of their start; the open one with the highest number wins and leaves the
    heap once it has ended.
    """
    opens = sorted((a, n) for n, (a, b) in enumerate(zip(starts, ends, strict=True)) if a < b)
    edges = sorted({0, length, *starts, *ends})
    live: list[int] = []
    at = 0
    for here, after in pairwise(edges):
        while at < len(opens) and opens[at][0] <= here:
            heappush(live, -opens[at][1])
            at += 1
        while live and ends[-live[0]] <= here:
            heappop(live)
        yield here, after, -live[0] if live else None


def heat_spans(df: DataFrame, body: str, claims: str, scores: str, keys: list[str]) -> DataFrame:
    """Stretches of a text with intensity and mask (1, -1, 0); a later claim overwrites an earlier one.

    claims and scores are parallel arrays; a claim without a score overwrites with 0.  Text outside every
    claim has intensity 0.  Null or empty texts and null claims have no stretches.  Only places and scores
    go to Python, not the texts.
    """
    found = df.withColumn("_low", F.lower(body)).withColumn("_spans", claim_spans(F.col("_low"), F.col(claims)))
    placed = found.filter((F.length(body) > 0) & F.col("_spans").isNotNull()).select(
        *keys, F.col("_spans.start").alias("_a"), F.col("_spans.end").alias("_b"),
        F.col(scores).cast("array<double>").alias("_v"), F.length(body).alias("_n"),
    )
    schema = ", ".join([*(f"`{k}` {placed.schema[k].dataType.simpleString()}" for k in keys), "inicio int, fin int, _score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                rows, out = [], []
                for i, r in enumerate(part.select(["_a", "_b", "_v", "_n"]).to_pylist()):
                    v = r["_v"] or []
                    for a, b, n in sweep(r["_a"], r["_b"], r["_n"]):
                        rows.append(i)
                        out.append((a, b, v[n] if n is not None and n < len(v) else None))
                a, b, score = zip(*out, strict=True)
                where = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k).take(where) for k in keys), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(score, pa.float64())],
                    names=[*keys, "inicio", "fin", "_score"],
                )

    score = F.col("_score")
    mask = F.when(score > 0.2, 1).when(score < -0.2, -1).otherwise(0)
    return placed.mapInArrow(run, schema).select(
        *keys, "inicio", "fin", F.least(F.lit(1.0), F.abs(F.coalesce(score, F.lit(0.0)))).alias("intensidad"), mask.alias("marca")
    )


def per_character(spans: DataFrame, keys: list[str]) -> DataFrame:
    """One row per character of the stretches."""
    rows = spans.filter("fin > inicio").withColumn("pos", F.explode(F.sequence("inicio", F.col("fin") - 1)))
    return rows.select(*keys, "pos", "intensidad", "marca")


# ---------------------------------------------------------------- quality

def quality_overall(prefix: str = "") -> Column:
    return reduce(lambda a, b: a + b, [F.col(prefix + name) * w for name, w in fv.QUALITY_WEIGHTS])


def quality_heuristic(n_words: Column, n_sources: Column) -> dict[str, Column]:
    """Quality dimensions when no model rates the answer."""
    one = F.lit(1.0)
    return {
        "completeness": F.least(n_words / 100, one),
        "accuracy": F.least(n_sources / 3, one),
        "consistency": F.when(n_sources >= 2, F.lit(0.7)).otherwise(F.lit(0.4)),
        "depth": F.least(n_words / 150, one),
        "freshness": F.lit(0.6),
        "authority": F.lit(0.6),
    }


def weak_dimensions(threshold: float = 0.6, acted_on: int = 2) -> Column:
    """Names of the dimensions below the threshold that the next round acts on."""
    weak = F.array_compact(F.array(*[F.when(F.col(n) < threshold, F.lit(n)) for n, _ in fv.QUALITY_WEIGHTS]))
    return F.slice(weak, 1, acted_on)


def answer_heuristic(query: Column, answer: Column, mean_relevance: Column, n_evidence: Column) -> Column:
    q, a = F.array_distinct(text.tokens(query)), F.array_distinct(text.tokens(answer))
    length = F.least(F.size(text.tokens(answer)) / 150, F.lit(1.0))
    coverage = F.size(F.array_intersect(q, a)) / F.greatest(F.size(q), F.lit(1))
    marked = reduce(lambda x, y: x | y, [F.contains(answer, F.lit(m)) for m in fv.STRUCTURE_MARKERS])
    structure = (
        F.lit(0.5) + F.when(F.length(answer) > 100, 0.2).otherwise(0.0)
        + F.when(marked, 0.2).otherwise(0.0) + F.when(n_evidence >= 2, 0.1).otherwise(0.0)
    )
    relevance = F.coalesce(mean_relevance, F.lit(0.0))
    return (length + relevance + coverage + F.least(structure, F.lit(1.0))) / 4


def answer_score(answer: Column, model_score: Column, heuristic: Column) -> Column:
    """Seven parts model, three parts heuristic; a very short answer is poor."""
    model = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), model_score)), F.lit(0.5))
    return F.when(F.length(answer) < 50, F.lit(0.2)).otherwise(model * 0.7 + heuristic * 0.3)


def relevance_summary(df: DataFrame, query: str, relevance: str) -> DataFrame:
    """Sources, mean and best relevance per query, and whether that is enough evidence."""
    out = df.groupBy(query).agg(
        F.count("*").alias("fuentes"), F.avg(relevance).alias("media"), F.max(relevance).alias("maxima")
    )
    enough = (F.col("fuentes") >= 2) & (
        (F.col("media") >= 0.6) | (F.col("maxima") >= 0.8) | ((F.col("fuentes") >= 3) & (F.col("media") >= 0.4))
    )
    return out.withColumn("suficiente", enough)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
