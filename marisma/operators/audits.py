"""Reports about the corpus and about runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marisma.functions import fixed_values as fv
from marisma.functions import text


def distinct_sources(df: DataFrame, source: str) -> DataFrame:
    """Distinct sources in order, as rows: the list itself may be long."""
    return df.select(source).distinct().orderBy(source)


def crawl_report(df: DataFrame, dims: list[str]) -> DataFrame:
    """Row counts along each dimension by itself, in one pass."""
    sets = [[d] for d in dims]
    names = F.lit(None).cast("string")
    values = F.lit(None).cast("string")
    for d in dims:
        here = F.grouping(d) == 0
        names = F.when(here, F.lit(d)).otherwise(names)
        values = F.when(here, F.col(d).cast("string")).otherwise(values)
    counted = df.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(
        F.count("*").alias("n"), names.alias("dimension"), values.alias("valor")
    )
    return counted.select("dimension", "valor", "n")


def source_audit(df: DataFrame, source: str, url: str, ts: str, title: str) -> DataFrame:
    """Totals, rows with a URL, and the newest and oldest article; ties go to the smaller title."""
    dated = F.col(ts).isNotNull()
    newest = F.struct(F.col(ts), F.col(title))
    label = F.coalesce(text.truthy(F.col(source)), F.lit(fv.BLANK_SOURCE_LABEL))
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce(F.col(url), F.lit("")) != "").alias("con_url"),
        F.count_distinct(label).alias("fuentes"),
        F.max(F.when(dated, F.col(ts))).alias("ultimo"),
        F.max_by(F.col(title), F.when(dated, newest)).alias("titulo_ultimo"),
        F.min(F.when(dated, F.col(ts))).alias("primero"),
        F.min_by(F.col(title), F.when(dated, newest)).alias("titulo_primero"),
    )


def source_counts(df: DataFrame, source: str) -> DataFrame:
    label = F.coalesce(text.truthy(F.col(source)), F.lit(fv.BLANK_SOURCE_LABEL))
    return df.groupBy(label.alias("fuente")).agg(F.count("*").alias("n"))


def run_statistics(outcomes: DataFrame) -> DataFrame:
    """Totals of a run over its per-row outcomes (ok, warnings, tokens_used, latency_ms)."""
    return outcomes.agg(
        F.count("*").alias("total"),
        F.count_if("ok").alias("correctos"),
        F.count_if(F.col("ok") & (F.col("avisos") > 0)).alias("con_avisos"),
        F.count_if(~F.col("ok")).alias("errores"),
        F.sum("tokens_used").alias("tokens"),
        F.sum("latency_ms").alias("latencia_ms"),
    )


def top_counts(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)
