"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Of all rates the ones nearest to 1 in relative entropy that meet the token constraints are
exponentially tilted: a document of size s in source j is taken min(cap, exp(lambda_j * s)) times, where
lambda minimises the convex dual  sum of f(lambda_j * s) - lambda_j * target_j,  f' = min(cap, exp).

1. `token_sizes`: size of each document; texts are left behind where they are read.
2. `targets`: weights of the sources against all tokens; a source stops at `cap` times its own size
   and the excess is shared again.
3. `tilted`: Newton steps for all sources at once over the histogram of (source, size), kept in a bracket.
   Gradient and curvature are exact decimal sums, so every run gives the same numbers.
4. `rounded`: documents of one source and size share a rate, so their copies are a number per
   histogram row: the running sum of rates, largest size first, is rounded, and what then is missing
   from the target or too much is put right by documents not larger than the gap, again and again.
5. `mix`: of the documents of one row, the first by hash get one copy more.

Source and size are few next to documents: a histogram row stands for any number of them, and no source
has more rows than its longest document has words.  Documents of a row are numbered in slices.

Defined cases: null text has size 0; a null source is a source, the last; no order among documents that
tie in source, size and hash of doc_id matters, for they differ in nothing that is returned but a
repeated doc_id; size 0 is taken 0 words; a source without words has target 0; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from math import inf

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marisma.llm.runs import above
from marisma.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
EXACT = "decimal(38,6)"


def token_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (never null), size."""
    source = F.col("source").cast("string")
    return docs.select(
        "doc_id", source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("key"),
        F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )


def weighted(sources: DataFrame, weights: list[int]) -> DataFrame:
    """sources (key, source, words) with weight: the given ones in turn, by source in code points, null last."""
    placed = above(sources.withColumn("one", F.lit(1)), ["one"], [F.asc_nulls_last("source")], {"place": (F.lit(1).cast("long"), F.sum)})
    return placed.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("place") % len(weights))).drop("one", "place")


def targets(sources: DataFrame, cap: int = 3) -> DataFrame:
    """sources (words, weight) with target: shares of all words, none above cap times the source's own."""
    total, weight = sources.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, full = (total / weight if weight else 0.0), F.col("words") * cap
    while True:
        over = full < F.lit(level) * F.col("weight")
        held, used = sources.agg(F.coalesce(F.sum(F.when(over, full)), F.lit(0)), F.coalesce(F.sum(F.when(over, F.col("weight"))), F.lit(0))).first()
        new = (total - held) / (weight - used) if weight > used else inf
        if new <= level:
            return sources.withColumn("target", F.least(full.cast("double"), F.lit(level) * F.col("weight")))
        level = new


def rate(cap: int) -> Column:
    """From lambda and size; the exponent is cut where the rate is."""
    return F.least(F.lit(float(cap)), F.exp(F.least(F.col("lambda") * F.col("size"), F.log(F.lit(float(cap))))))


def tilted(histogram: DataFrame, sources: DataFrame, cap: int = 3, gap: float = 1e-9, steps: int = 100) -> DataFrame:
    """sources with lambda; histogram: key, size, n.

    gap: relative miss of a target at which the steps end.  The root is inside the bracket from the start:
    with the smallest size s, words * exp(lambda * s) bounds the tilted words on either side of 0.
    """
    histogram = histogram.filter("size > 0")
    spread = histogram.groupBy("key").agg(F.min("size").alias("least"))
    end = F.log(F.col("target") / F.col("words")) / F.col("least")
    state = sources.join(spread, "key").withColumns({
        "lambda": F.when(F.col("target") >= cap * F.col("words"), F.log(F.lit(float(cap))) / F.col("least")).otherwise(F.lit(0.0)),
        "low": F.when(F.col("target") < F.col("words"), end).otherwise(F.lit(0.0)),
        "high": F.when(F.col("target") < F.col("words"), F.lit(0.0)).otherwise(F.log(F.lit(float(cap))) / F.col("least")),
        "done": F.col("target") >= cap * F.col("words"),
    })
    for _ in range(steps):
        state = cut_lineage(state, "lambda")
        if state.filter("NOT done").isEmpty():
            break
        tokens = F.col("n") * F.col("size") * rate(cap)
        bend = F.when(F.col("lambda") * F.col("size") < F.log(F.lit(float(cap))), tokens * F.col("size")).otherwise(F.lit(0.0))
        sums = (
            histogram.join(state.filter("NOT done").select("key", "lambda"), "key")
            .groupBy("key").agg(F.sum(tokens.cast(EXACT)).cast("double").alias("now"), F.sum(bend.cast(EXACT)).cast("double").alias("bend"))
        )
        off, here = F.col("now") - F.col("target"), F.col("lambda")
        low, high = F.when(off < 0, here).otherwise(F.col("low")), F.when(off > 0, here).otherwise(F.col("high"))
        newton = here - off / F.nullif(F.col("bend"), F.lit(0.0))
        inside = (newton > low) & (newton < high)
        met = F.abs(off) <= F.lit(gap) * F.col("target")
        state = state.join(sums, "key", "left").select(
            *sources.columns, "least",
            F.when(F.col("done") | met, here).when(inside, newton).otherwise((low + high) / 2).alias("lambda"),
            F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"), F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
            (F.col("done") | F.coalesce(met, F.lit(False))).alias("done"),
        )
    return sources.join(state.select("key", "lambda"), "key", "left").fillna(0.0, ["lambda"])


def rounded(histogram: DataFrame, sources: DataFrame, cap: int = 3, repairs: int = 8) -> DataFrame:
    """key, size, n, rate, copies: whole copies of all n documents together."""
    order = Window.partitionBy("key").orderBy(F.desc("size"))
    upto, before, every = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("key")
    rows = histogram.join(sources.select("key", "target", "lambda"), "key").withColumn("rate", rate(cap))
    rows = rows.withColumn("_sum", F.floor(F.sum(F.col("n") * F.col("rate")).over(upto) + 0.5).cast("long"))
    rows = rows.withColumn("copies", F.col("_sum") - F.lag("_sum", 1, 0).over(order)).withColumn("copies", F.least("copies", F.col("n") * cap))
    for _ in range(repairs):
        rows = rows.withColumn("_gap", F.col("target") - F.sum(F.col("size") * F.col("copies")).over(every))
        width = F.abs("_gap")
        room = F.when(F.col("_gap") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies"))
        rows = rows.withColumn("_room", F.when((F.col("size") > 0) & (F.col("size") <= width), room).otherwise(F.lit(0)))
        rows = rows.withColumn("_used", F.coalesce(F.sum(F.col("size") * F.col("_room")).over(before), F.lit(0)))
        fits = F.when(F.col("_used") < width, F.floor((width - F.col("_used")) / F.col("size"))).otherwise(F.lit(0))
        rows = rows.withColumn("copies", F.col("copies") + F.signum("_gap").cast("long") * F.least("_room", F.when(F.col("_room") > 0, fits).otherwise(F.lit(0))).cast("long"))
    return rows.select("key", "size", "n", "rate", "copies")


def mix(docs: DataFrame, weights: list[int], cap: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, taken; docs: doc_id, source, text.  One row per input row."""
    sizes = cut_lineage(token_sizes(docs), "sizes")
    histogram = cut_lineage(sizes.groupBy("key", "size").agg(F.count("*").alias("n"), F.first("source").alias("source")), "histogram")
    sources = histogram.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("n") * F.col("size")).alias("words"))
    sources = cut_lineage(targets(cut_lineage(weighted(sources, weights), "weights"), cap), "targets")
    histogram = histogram.drop("source")
    sources = cut_lineage(tilted(histogram, sources, cap), "lambda")
    plan = cut_lineage(rounded(histogram, sources, cap), "copies").join(sources.select("key", "words", "target"), "key")
    placed = above(sizes.withColumn("hash", F.xxhash64("doc_id")), ["key", "size"], [F.asc("hash"), F.asc("doc_id")], {"place": (F.lit(1).cast("long"), F.sum)})
    copies = F.floor(F.col("copies") / F.col("n")).cast("long") + (F.col("place") < F.col("copies") % F.col("n")).cast("long")
    return (
        placed.join(plan, ["key", "size"])
        .select("doc_id", "source", "size", F.col("words").alias("source_size"), "target", "rate", copies.alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
