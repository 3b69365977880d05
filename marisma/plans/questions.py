"""Question families over the long fact: parameters in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marisma.functions import fixed_values as fv
from marisma.functions import times
from marisma.operators import facts
from marisma.operators.facts import VALUE


def point_lookup(fact: DataFrame, **params) -> DataFrame:
    """The rows that answer a direct question."""
    return facts.filter_metrics(fact, **params).select(
        "categoria", "provincia", "anio", "mes", "periodo_tipo", "metrica_nombre", VALUE
    )


def in_group(fact: DataFrame, members: DataFrame, key: str, excluded: list[str] | None = None) -> DataFrame:
    """Rows of the members of a group, minus exclusions."""
    if excluded:
        members = members.filter(~F.col(key).isin(excluded))
    return fact.join(members.select(key).distinct(), key, "left_semi")


def group_total(fact: DataFrame, members: DataFrame, key: str, keys: list[str],
                excluded: list[str] | None = None) -> DataFrame:
    return in_group(fact, members, key, excluded).groupBy(*keys).agg(F.sum(VALUE).alias("total"))


def period_total(fact: DataFrame, keys: list[str], **params) -> DataFrame:
    return facts.filter_metrics(fact, **params).groupBy(*keys).agg(F.sum(VALUE).alias("total"))


def period_mean(fact: DataFrame, keys: list[str], **params) -> DataFrame:
    return facts.filter_metrics(fact, **params).groupBy(*keys).agg(facts.average(VALUE).alias("promedio"))


def arg_max(fact: DataFrame, entity: str, keys: list[str], **params) -> DataFrame:
    """The entity with the largest total per key; the smaller name wins a tie."""
    totals = facts.filter_metrics(fact, **params).groupBy(*keys, entity).agg(F.sum(VALUE).alias("total"))
    # the smallest (-total, name) is the largest total, smallest name
    best = F.min(F.struct((-F.col("total")).alias("menos"), F.col(entity).alias("entidad")))
    return (
        totals.groupBy(*keys).agg(best.alias("mejor"))
        .select(*keys, F.col("mejor.entidad").alias(entity), (-F.col("mejor.menos")).alias("total"))
    )


def part_of_year(fact: DataFrame, part: str, keys: list[str]) -> DataFrame:
    """Sums of a quarter, semester or season per year."""
    return fact.filter(times.in_month_group(F.col("mes"), part)).groupBy(*keys, "anio").agg(F.sum(VALUE).alias("total"))


def compare_part_of_year(fact: DataFrame, part: str, year: int, previous: int, keys: list[str]) -> DataFrame:
    rows = fact.filter(times.in_month_group(F.col("mes"), part))
    return facts.compare_periods(rows, keys, F.col("anio") == year, F.col("anio") == previous)


def mean_change(fact: DataFrame, keys: list[str], year: int, previous: int) -> DataFrame:
    """Percent change of the mean between two years."""
    y, v = F.col("anio"), F.col(VALUE)

    def mean_of(a_year: int) -> Column:
        hit = F.when(y == a_year, v)
        return F.sum(hit).cast("double") / F.count(hit)

    out = fact.filter(y.isin(year, previous)).groupBy(*keys).agg(
        mean_of(year).alias("promedio"), mean_of(previous).alias("promedio_previo")
    )
    change = F.col("promedio") - F.col("promedio_previo")
    return out.withColumn("variacion_pct", facts.percent(change, F.col("promedio_previo")))


def share_outside(fact: DataFrame, members: DataFrame, key: str, keys: list[str]) -> DataFrame:
    """Share of the total that comes from outside a group."""
    flags = members.select(key).distinct().withColumn("_in", F.lit(True))
    rows = fact.join(flags, key, "left")
    return facts.share_of_total(rows, keys, F.col("_in").isNull())


def share_by_entity(fact: DataFrame, entity: str, keys: list[str]) -> DataFrame:
    """Each entity's share of the total of its keys; a null key is a group like any other.

    The total is a window over the parts, one row per key and entity, so the fact is read once.
    """
    parts = fact.groupBy(*keys, entity).agg(F.sum(VALUE).alias("parte"))
    whole = parts.withColumn("total", F.sum("parte").over(W.partitionBy(*keys)))
    return whole.withColumn("cuota_pct", facts.percent(F.col("parte"), F.col("total")))


def monthly_trend(fact: DataFrame, keys: list[str], series: str, left: str, right: str) -> DataFrame:
    """Two monthly series side by side and the slope of each over the months of the year."""
    months = (
        fact.filter(F.col(series).isin(left, right)).groupBy(*keys, "anio", "mes")
        .agg(
            F.sum(F.when(F.col(series) == left, F.col(VALUE))).cast("double").alias("serie_a"),
            F.sum(F.when(F.col(series) == right, F.col(VALUE))).cast("double").alias("serie_b"),
        )
    )
    # at most twelve rows per key and year; null keys stay
    year = W.partitionBy(*keys, "anio")
    return months.withColumns({
        "pendiente_a": F.regr_slope("serie_a", F.col("mes").cast("double")).over(year),
        "pendiente_b": F.regr_slope("serie_b", F.col("mes").cast("double")).over(year),
    })


def ranking(fact: DataFrame, entity: str, n: int, **params) -> DataFrame:
    totals = facts.filter_metrics(fact, **params).groupBy(entity).agg(F.sum(VALUE).alias("total"))
    return totals.orderBy(F.desc("total"), entity).limit(n)


def several_dimensions(fact: DataFrame, rows: list[str], column: str, values: list[str], part: str | None = None) -> DataFrame:
    """Cross-tabulation of up to several dimensions, limited to a season if asked."""
    if part:
        fact = fact.filter(times.in_month_group(F.col("mes"), part))
    return facts.pivot_values(fact, rows, column, VALUE, values, F.sum)


def largest_changes(fact: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Months with the largest change against the same month of the year before."""
    series = facts.same_month_last_year(fact, keys).filter(F.col("variacion_pct").isNotNull())
    return series.orderBy(F.desc(F.abs("variacion_pct")), *keys, "anio", "mes").limit(n)


def season_of_months(df: DataFrame, month: str = "mes") -> DataFrame:
    """One row per group a month belongs to."""
    groups = F.array_compact(
        F.array(*[F.when(F.col(month).isin(months), F.lit(name)) for name, months in fv.MONTH_GROUPS.items()])
    )
    return df.withColumn("grupo", F.explode(groups))
