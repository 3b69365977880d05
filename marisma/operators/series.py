"""Ordered state per key, without putting a whole key into one task.

A key may own a large part of all rows.  Rows are dealt by ranges of key and order into slices of
about equal size, so a burst of one key is cut where the rows are; a slice is summarized in one
row per key, the summaries are carried forward, and each row combines its slice-local window with
what came before.  There are as many summaries as slices and keys, whatever the number of rows.

A null key is a key of its own; rows with a null order come last.  No row is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marisma.functions import fixed_values as fv
from marisma.session import cut_lineage


def _ordered(columns: list[str]) -> list[Column]:
    return [F.asc_nulls_last(c) for c in columns]


def sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with _slice, frozen: where a row falls must not change between two readings."""
    return cut_lineage(
        df.repartitionByRange(*[F.asc(k) for k in keys], *_ordered(order)).withColumn("_slice", F.spark_partition_id()), "slices"
    )


def _within(keys: list[str], order: list[str]):
    return W.partitionBy(*keys, "_slice").orderBy(*_ordered(order))


def _before(keys: list[str]):
    return W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)


def _with_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the summary carried to their key and slice; null keys match."""
    names = {k: f"_key{i}" for i, k in enumerate(keys)}
    side = carry.withColumnsRenamed({**names, "_slice": "_at"})
    same = F.col("_slice") == F.col("_at")
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return rows.join(side, same).drop("_at", *names.values())


def number_rows(df: DataFrame, keys: list[str], order: str, name: str = "numero") -> DataFrame:
    """row_number per key."""
    rows = sliced(df, keys, [order])
    carry = (
        rows.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
        .withColumn("_above", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0))).drop("_n")
    )
    numbered = _with_carry(rows.withColumn("_rn", F.row_number().over(_within(keys, [order]))), carry, keys)
    return numbered.withColumn(name, F.col("_above") + F.col("_rn")).drop("_slice", "_rn", "_above")


def fill_down(df: DataFrame, keys: list[str], order: str, column: str, name: str) -> DataFrame:
    """The last non-null value at or above each row of a key."""
    rows = sliced(df, keys, [order])
    here = _within(keys, [order]).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({"_here": F.last(column, ignorenulls=True).over(here), "_rn": F.row_number().over(_within(keys, [order]))})
    carry = (
        rows.groupBy(*keys, "_slice").agg(F.max_by("_here", "_rn").alias("_end"))
        .withColumn("_above", F.last("_end", ignorenulls=True).over(_before(keys))).drop("_end")
    )
    return _with_carry(rows, carry, keys).withColumn(name, F.coalesce("_here", "_above")).drop("_slice", "_here", "_rn", "_above")


def iteration_state(df: DataFrame, key: str, ts: str, tie: str, score: str, improved: Column, new_sources: Column) -> DataFrame:
    """Adds iteracion, tendencia, estancamiento and fuentes to an iteration log.

    tendencia      least-squares slope over the last three scores, 0 with fewer than two
    estancamiento  iterations since the last improvement
    fuentes        sources found so far
    """
    rows = sliced(
        df.withColumns({"_improved": F.coalesce(improved, F.lit(False)), "_new": F.coalesce(new_sources, F.lit(0))}), [key], [ts, tie]
    )
    local = _within([key], [ts, tie])
    upto = local.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns(
        {
            "_rn": F.row_number().over(local),
            "_lag1": F.lag(score, 1).over(local),
            "_lag2": F.lag(score, 2).over(local),
            "_sources": F.sum("_new").over(upto),
        }
    )
    rows = rows.withColumn("_hit", F.max(F.when(F.col("_improved"), F.col("_rn"))).over(upto))

    by_slice = W.partitionBy(key).orderBy("_slice")
    before = _before([key])
    carry = rows.groupBy(key, "_slice").agg(
        F.max("_rn").alias("_n"), F.max("_sources").alias("_s"), F.max("_hit").alias("_h"),
        F.max_by(score, "_rn").alias("_last"), F.max_by("_lag1", "_rn").alias("_next_last"),
    )
    carry = carry.withColumns(
        {
            "_n0": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_s0": F.coalesce(F.sum("_s").over(before), F.lit(0)),
            "_p1": F.lag("_last", 1).over(by_slice),
            "_p2": F.when(F.lag("_n", 1).over(by_slice) >= 2, F.lag("_next_last", 1).over(by_slice)).otherwise(
                F.lag("_last", 2).over(by_slice)
            ),
        }
    )
    carry = carry.withColumn("_h0", F.max(F.col("_n0") + F.col("_h")).over(before))
    carry = carry.select(key, "_slice", "_n0", "_s0", "_p1", "_p2", "_h0")

    c = F.col
    iteration = c("_n0") + c("_rn")
    prev1 = F.when(c("_rn") > 1, c("_lag1")).otherwise(c("_p1"))
    prev2 = F.when(c("_rn") > 2, c("_lag2")).when(c("_rn") == 2, c("_p1")).otherwise(c("_p2"))
    # equally spaced points: the slope through three of them depends on the outer two only
    trend = F.when(iteration >= 3, (c(score) - prev2) / 2).when(iteration == 2, c(score) - prev1).otherwise(F.lit(0.0))
    last_hit = F.coalesce(c("_n0") + c("_hit"), c("_h0"), F.lit(0))
    out = _with_carry(rows, carry, [key]).withColumns(
        {
            "iteracion": iteration,
            "tendencia": trend,
            "estancamiento": iteration - last_hit,
            "fuentes": c("_s0") + c("_sources"),
        }
    )
    return out.drop("_slice", "_improved", "_new", "_rn", "_lag1", "_lag2", "_sources", "_hit", "_n0", "_s0", "_p1", "_p2", "_h0")


def stop_reason(state: DataFrame, score: str, threshold: float = 0.75, max_iterations: int = 15,
                tolerance: int = 3, min_gain: float = 0.05, min_sources: int = 2) -> DataFrame:
    """Why a search would stop after each iteration; null if it goes on.  Quality is asked first."""
    reason = (
        F.when(F.col(score) >= threshold, F.lit("Quality threshold reached"))
        .when(F.col("iteracion") >= max_iterations, F.lit("Maximum iterations reached"))
        .when(F.col("estancamiento") >= tolerance, F.lit("Quality plateau detected"))
        .when((F.col("iteracion") >= 3) & (F.col("tendencia") < min_gain), F.lit("Diminishing returns detected"))
        .when((F.col("iteracion") >= 3) & (F.col("fuentes") < min_sources), F.lit("Insufficient sources found"))
    )
    return state.withColumn("motivo", reason)


# ---------------------------------------------------------------- windowed scores

def in_windows(df: DataFrame, ts: str, as_of: Column, windows: list[int] | None = None) -> DataFrame:
    """One copy of a row per look-back window it falls into."""
    labels = F.array_compact(
        F.array(
            *[
                F.when(F.col(ts) > as_of - F.make_interval(days=F.lit(days)), F.lit(f"{days}d"))
                for days in (windows or fv.SCORE_WINDOWS_DAYS)
            ]
        )
    )
    return df.withColumn("ventana", F.explode(labels))


def coverage(df: DataFrame, ts: str, topic: str, label: Column, as_of: Column, windows: list[int] | None = None) -> DataFrame:
    """Articles per topic and tone in each window."""
    tone = df.select(ts, F.col(topic).alias("tema"), label.alias("_tone"))
    return in_windows(tone, ts, as_of, windows).groupBy("ventana", "tema").agg(
        F.count_if(F.col("_tone") == "positive").alias("positive"),
        F.count_if(F.col("_tone") == "neutral").alias("neutral"),
        F.count_if(F.col("_tone") == "negative").alias("negative"),
        F.count("*").alias("total"),
    )


def radar_mean(df: DataFrame, ts: str, topic: str, party: str, axes: str, n_axes: int, as_of: Column,
               windows: list[int] | None = None) -> DataFrame:
    """Mean of every axis per topic, party and window; nulls are no votes."""
    rows = df.select(ts, F.col(topic).alias("tema"), F.col(party).alias("partido"), F.col(axes).alias("_axes"))
    means = [F.avg(F.get("_axes", F.lit(i)).cast("double")) for i in range(n_axes)]
    return in_windows(rows, ts, as_of, windows).groupBy("ventana", "tema", "partido").agg(F.array(*means).alias("ejes"))


def outlet_affinity(df: DataFrame, ts: str, outlet: str, affinity: str, as_of: Column, windows: list[int] | None = None) -> DataFrame:
    """Mean affinity per outlet and window, with the number of articles and their share of the window."""
    rows = df.select(ts, F.col(outlet).alias("medio"), F.col(affinity).alias("_a"))
    per = in_windows(rows, ts, as_of, windows).groupBy("ventana", "medio").agg(
        (F.sum("_a").cast("double") / F.count("_a")).alias("afinidad"), F.count("*").alias("articulos")
    )
    totals = per.groupBy("ventana").agg(F.sum("articulos").alias("_total"))
    share = F.col("articulos") * 100 / F.col("_total")
    return per.join(totals, "ventana").select("ventana", "medio", "afinidad", "articulos", share.alias("cuota_articulos"))


def account_points(df: DataFrame, account: str) -> DataFrame:
    """Posts per known account with its reach and affinity; unknown accounts stay without."""
    known = df.sparkSession.createDataFrame([(a, float(r), float(f)) for a, (r, f) in fv.SOCIAL_ACCOUNTS.items()], "_a string, alcance double, afinidad double")
    posts = df.groupBy(account).agg(F.count("*").alias("publicaciones"))
    return posts.join(known, F.col(account) == F.col("_a"), "left").drop("_a")


def scatter_points(df: DataFrame, name: str, affinity: str, reach: str) -> DataFrame:
    """Affinity and reach kept in 0..100 with the color of the reach, small reach first."""
    from marisma.functions.numbers import clamp, reach_color

    rows = df.select(
        name, clamp(F.coalesce(affinity, F.lit(0.0)), 0.0, 100.0).alias("affinity"), clamp(F.coalesce(reach, F.lit(0.0)), 0.0, 100.0).alias("reach")
    )
    rgb = reach_color(F.col("reach"))
    return rows.withColumns({c: rgb[c] for c in "rgb"}).orderBy("reach", name)


def strategy_posterior(df: DataFrame, strategy: str, reward: str, success: float = 0.3) -> DataFrame:
    """Beta posterior per strategy; a missing reward counts as a failure."""
    won = F.coalesce(F.col(reward) > success, F.lit(False))
    out = df.groupBy(strategy).agg((1 + F.count_if(won)).alias("alpha"), (1 + F.count_if(~won)).alias("beta"))
    return out.withColumn("media", F.col("alpha") / (F.col("alpha") + F.col("beta")))
