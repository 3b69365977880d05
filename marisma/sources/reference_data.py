"""Calendar and dimension tables with their aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marisma.functions import fixed_values as fv
from marisma.functions import times


def build_calendar(spark: SparkSession, first_year: int = 2021, last_year: int = 2025) -> DataFrame:
    """One row per month."""
    months = F.sequence(
        F.make_date(F.lit(first_year), F.lit(1), F.lit(1)),
        F.make_date(F.lit(last_year), F.lit(12), F.lit(1)),
        F.expr("interval 1 month"),
    )
    days = spark.range(1).select(F.explode(months).alias("fecha_periodo"))
    year, month = F.year("fecha_periodo"), F.month("fecha_periodo")
    return days.select(
        times.date_id(year, month).alias("date_id"),
        "fecha_periodo",
        year.cast("smallint").alias("anio"),
        month.cast("smallint").alias("mes"),
        times.month_name(month).alias("mes_nombre_es"),
        times.month_abbr(month).alias("mes_nombre_abrev"),
        times.quarter_of(month).cast("smallint").alias("trimestre"),
        times.semester_of(month).cast("smallint").alias("semestre"),
    )


def calendar_of(dates: DataFrame, column: str) -> DataFrame:
    """The calendar that spans the dates of a table: bounds are aggregated, months generated."""
    spark = dates.sparkSession
    low, high = dates.agg(F.min(F.year(column)), F.max(F.year(column))).first()
    return build_calendar(spark, low, high)


def build_dims(spark: SparkSession) -> dict[str, DataFrame]:
    """Dimension and alias tables; ids follow the order of the fixed values."""

    def dim(rows, ddl):
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], ddl)

    def alias(table: dict, codes: list[str], id_col: str):
        pairs = [(codes.index(code) + 1, a) for code, names in table.items() for a in names]
        return dim(pairs, f"id bigint, {id_col} int, alias string")

    province_codes = [code for code, _ in fv.PROVINCE_CODES.values()]
    market_codes = [code for code, _, _ in fv.MARKETS]
    type_codes = [code for code, _ in fv.TOURISM_TYPES]
    indicator_codes = [row[0] for row in fv.INDICATORS]
    return {
        "provincias": dim(fv.PROVINCE_CODES.values(), "id_provincia int, codigo_provincia string, nombre_provincia string"),
        "mercados": dim(fv.MARKETS, "id_mercado int, codigo_mercado string, nombre_mercado string, tipo_mercado string"),
        "tipos_turismo": dim(fv.TOURISM_TYPES, "id_tipo_turismo int, codigo_tipo string, nombre_tipo string"),
        "indicadores": dim(
            fv.INDICATORS,
            "id_indicador int, codigo_indicador string, nombre_indicador string, unidad_medida string, categoria_indicador string",
        ),
        "provincias_alias": alias(fv.PROVINCE_ALIASES, province_codes, "id_provincia"),
        "mercados_alias": alias(fv.MARKET_ALIASES, market_codes, "id_mercado"),
        "tipos_turismo_alias": alias(fv.TYPE_ALIASES, type_codes, "id_tipo_turismo"),
        "indicadores_alias": alias(fv.INDICATOR_ALIASES, indicator_codes, "id_indicador"),
    }


def duplicate_aliases(aliases: DataFrame, id_col: str) -> DataFrame:
    """Alias rows that break the rule of one (id, lower-case alias)."""
    return aliases.groupBy(id_col, F.lower("alias").alias("alias")).count().filter("count > 1")
