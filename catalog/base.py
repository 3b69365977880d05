"""Registry of queries and their SQL twins, and the tables they share.

The reference tables stand in for the real inputs: orders, customers and nations
for the metric facts, documents and pages for the corpus, events for the
article stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marisma.operators.facts import with_fact_keys

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals to doubles: exact sums inside, plain numbers in the result."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None):
    """Register a query; sql is its twin on the same tables."""

    def add(fn):
        def run(spark: SparkSession, d: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return plain(fn(spark, d))

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def passages(spark: SparkSession, d: str):
    """How many passages there are, as a column: documents are dealt to all of them in turn."""
    return table(spark, d, "benchmark").agg(F.count("*")).scalar()


def money(col: str):
    return F.col(col).cast("decimal(18,2)")


# ---------------------------------------------------------------- long fact

def orders_named(spark: SparkSession, d: str, years: list[int] | None = None) -> DataFrame:
    """Orders with customer and nation; years becomes a range of dates, which reaches the scan."""
    orders = table(spark, d, "orders")
    if years:
        day = F.col("o_orderdate")
        orders = orders.filter((day >= F.lit(f"{min(years)}-01-01").cast("timestamp_ntz")) & (day < F.lit(f"{max(years) + 1}-01-01").cast("timestamp_ntz")))
    return (
        orders
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )


def long_fact(spark: SparkSession, d: str, years: list[int] | None = None) -> DataFrame:
    """Monthly metrics: number and amount of orders per segment and nation."""
    name = F.col("n_name")
    grouped = (
        orders_named(spark, d, years)
        .groupBy(
            F.col("c_mktsegment").alias("categoria"),
            F.concat(F.upper(F.substring(name, 1, 1)), F.lower(F.substring(name, 2, 100))).alias("provincia"),
            F.year("o_orderdate").alias("anio"),
            F.month("o_orderdate").alias("mes"),
        )
        .agg(
            F.count("*").cast("decimal(18,2)").alias("pedidos"),
            F.sum(money("o_totalprice")).cast("decimal(18,2)").alias("importe"),
        )
    )
    return grouped.unpivot(
        ["categoria", "provincia", "anio", "mes"], ["pedidos", "importe"], "metrica_nombre", "metrica_valor"
    ).withColumn("periodo_tipo", F.lit("mensual"))


def full_fact(spark: SparkSession, d: str, years: list[int] | None = None) -> DataFrame:
    """The monthly fact plus one accumulated row per year."""
    monthly = long_fact(spark, d, years)
    yearly = (
        monthly.groupBy("categoria", "provincia", "anio", "metrica_nombre")
        .agg(F.sum("metrica_valor").cast("decimal(18,2)").alias("metrica_valor"))
        .withColumns({"mes": F.lit(12), "periodo_tipo": F.lit("acumulado")})
    )
    return monthly.unionByName(yearly)


FACT = """
WITH base AS (
  SELECT c_mktsegment AS categoria,
         upper(n_name[1]) || lower(n_name[2:]) AS provincia,
         year(o_orderdate) AS anio, month(o_orderdate) AS mes,
         CAST(count(*) AS DECIMAL(18,2)) AS pedidos,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS importe
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY ALL
), monthly AS (
  SELECT categoria, provincia, anio, mes, 'mensual' AS periodo_tipo, 'pedidos' AS metrica_nombre, pedidos AS metrica_valor FROM base
  UNION ALL
  SELECT categoria, provincia, anio, mes, 'mensual', 'importe', importe FROM base
), fact AS (
  SELECT * FROM monthly
  UNION ALL
  SELECT categoria, provincia, anio, 12, 'acumulado', metrica_nombre, CAST(sum(metrica_valor) AS DECIMAL(18,2))
  FROM monthly GROUP BY ALL
)
"""

# ---------------------------------------------------------------- star schema

INDICATORS = {1: ("numero_turistas", "Número de turistas", "turistas"), 2: ("gasto_medio_diario", "Gasto medio diario (euros)", "euros")}


def star_fact(spark: SparkSession, d: str) -> DataFrame:
    """Fact rows at four scopes: nation, region, order priority, and everything."""
    src = orders_named(spark, d).select(
        F.year("o_orderdate").alias("anio"),
        F.month("o_orderdate").alias("mes"),
        (F.col("n_nationkey") + 1).alias("id_provincia"),
        (F.col("n_regionkey") + 1).alias("id_mercado"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("id_tipo_turismo"),
        money("o_totalprice").alias("precio"),
    )
    period = ["anio", "mes"]
    sets = [[*period, "id_provincia"], [*period, "id_mercado"], [*period, "id_tipo_turismo"], period]
    # reduced once to the finest scope; the scopes expand what is left
    fine = src.groupBy("anio", "mes", "id_provincia", "id_mercado", "id_tipo_turismo").agg(F.count("*").alias("n"), F.max("precio").alias("m"))
    grouped = fine.groupingSets(sets, "anio", "mes", "id_provincia", "id_mercado", "id_tipo_turismo").agg(
        F.sum("n").cast("decimal(15,3)").alias("1"), F.max("m").cast("decimal(15,3)").alias("2")
    )
    facts = grouped.unpivot(
        ["anio", "mes", "id_provincia", "id_mercado", "id_tipo_turismo"], ["1", "2"], "id_indicador", "valor_absoluto"
    )
    return with_fact_keys(
        facts.withColumns(
            {
                "id_indicador": F.col("id_indicador").cast("int"),
                "ambito_geografico": F.when(F.col("id_provincia").isNotNull(), F.lit("provincia")).otherwise(F.lit("andalucia")),
                "variacion_interanual": F.lit(None).cast("decimal(8,6)"),
            }
        )
    )


def provinces(spark, d):
    return table(spark, d, "nation").select(
        (F.col("n_nationkey") + 1).alias("id_provincia"),
        F.format_string("%02d", "n_nationkey").alias("codigo_provincia"),
        F.col("n_name").alias("nombre_provincia"),
    )


def markets(spark, d):
    return table(spark, d, "region").select(
        (F.col("r_regionkey") + 1).alias("id_mercado"),
        F.lower("r_name").alias("codigo_mercado"),
        F.col("r_name").alias("nombre_mercado"),
        F.lit("internacional").alias("tipo_mercado"),
    )


def tourism_types(spark, d):
    return (
        table(spark, d, "orders").select("o_orderpriority").distinct()
        .select(
            F.substring("o_orderpriority", 1, 1).cast("int").alias("id_tipo_turismo"),
            F.lower(F.substring("o_orderpriority", 3, 20)).alias("codigo_tipo"),
            F.substring("o_orderpriority", 3, 20).alias("nombre_tipo"),
        )
    )


def indicators(spark, d):
    return spark.createDataFrame(
        [(i, *v) for i, v in INDICATORS.items()],
        "id_indicador int, codigo_indicador string, nombre_indicador string, unidad_medida string",
    )


STAR = """
WITH src AS (
  SELECT year(o_orderdate) AS anio, month(o_orderdate) AS mes, n_nationkey + 1 AS id_provincia,
         n_regionkey + 1 AS id_mercado, CAST(o_orderpriority[1] AS INT) AS id_tipo_turismo,
         CAST(o_totalprice AS DECIMAL(18,2)) AS precio
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), grouped AS (
  SELECT anio, mes, id_provincia, id_mercado, id_tipo_turismo, CAST(count(*) AS DOUBLE) AS n, CAST(max(precio) AS DOUBLE) AS m
  FROM src
  GROUP BY GROUPING SETS ((anio, mes, id_provincia), (anio, mes, id_mercado), (anio, mes, id_tipo_turismo), (anio, mes))
), star AS (
  SELECT *, CASE WHEN id_provincia IS NOT NULL THEN 'provincia' ELSE 'andalucia' END AS ambito_geografico,
         anio * 100 + mes AS date_id, make_date(anio, mes, 1) AS fecha_periodo, CAST(NULL AS DOUBLE) AS variacion_interanual
  FROM (SELECT anio, mes, id_provincia, id_mercado, id_tipo_turismo, 1 AS id_indicador, n AS valor_absoluto FROM grouped
        UNION ALL
        SELECT anio, mes, id_provincia, id_mercado, id_tipo_turismo, 2, m FROM grouped)
), provincias AS (
  SELECT n_nationkey + 1 AS id_provincia, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS codigo_provincia, n_name AS nombre_provincia FROM nation
), mercados AS (
  SELECT r_regionkey + 1 AS id_mercado, lower(r_name) AS codigo_mercado, r_name AS nombre_mercado, 'internacional' AS tipo_mercado FROM region
), tipos AS (
  SELECT DISTINCT CAST(o_orderpriority[1] AS INT) AS id_tipo_turismo, lower(o_orderpriority[3:]) AS codigo_tipo, o_orderpriority[3:] AS nombre_tipo FROM orders
), indicadores(id_indicador, codigo_indicador, nombre_indicador, unidad_medida) AS (
  VALUES (1, 'numero_turistas', 'Número de turistas', 'turistas'), (2, 'gasto_medio_diario', 'Gasto medio diario (euros)', 'euros')
)
"""
