"""Metric-fact queries: filters, aggregates, star schema, lookups and question families."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    FACT, STAR, full_fact, indicators, long_fact, markets, money, orders_named, provinces, query, star_fact,
    table, tourism_types,
)
from marisma.functions import fixed_values as fv
from marisma.functions import times
from marisma.operators import facts
from marisma.plans import questions

D = "CAST({} AS DOUBLE)"


# ---------------------------------------------------------------- filters

@query("P04_filter_metrics", FACT + """
SELECT categoria, provincia, anio, mes, metrica_nombre, CAST(metrica_valor AS DOUBLE) AS metrica_valor FROM fact
WHERE categoria IN ('BUILDING', 'MACHINERY') AND provincia IN ('Nation_3', 'Nation_7') AND mes IN (1, 2, 3)
  AND anio IN (1996, 1997) AND periodo_tipo = 'mensual'
""")
def _(spark, d):
    return facts.filter_metrics(
        full_fact(spark, d, [1996, 1997]), categorias=["BUILDING", "MACHINERY"], provincias=["nation_3", "NATION_7"],
        meses=[1, 2, 3], anios=[1996, 1997], periodo_tipo="mensual",
    ).select("categoria", "provincia", "anio", "mes", "metrica_nombre", "metrica_valor")


@query("P05_expand_categories", """
SELECT n_nationkey,
  CASE WHEN n_regionkey = 0 THEN 'alfa'
       WHEN n_regionkey = 1 THEN 'alfa,resto,uno,dos'
       WHEN n_regionkey = 2 THEN 'resto,uno,dos'
       WHEN n_regionkey = 3 THEN 'uno,resto,dos'
       ELSE 'uno,alfa,resto,dos' END AS expandidas
FROM nation
""")
def _(spark, d):
    r = F.col("n_regionkey")
    asked = (
        F.when(r == 0, F.array(F.lit("alfa")))
        .when(r == 1, F.array(F.lit("alfa"), F.lit("NATION")))
        .when(r == 2, F.array(F.col("n_name")))
        .when(r == 3, F.array(F.lit("uno"), F.lit("resto")))
        .otherwise(F.array(F.lit("uno"), F.lit("zzz"), F.lit("alfa")))
    )
    full = facts.expand_categories(asked, ["alfa", "resto", "uno", "dos"], "resto", ["uno", "dos"])
    return table(spark, d, "nation").select("n_nationkey", F.array_join(full, ",").alias("expandidas"))


@query("P06_match_metric_name", """
SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'red ')
""")
def _(spark, d):
    return table(spark, d, "part").filter(facts.match_metric_name(F.col("p_name"), ["BOLT", "red "])).select(
        "p_partkey", "p_name"
    )


@query("P07_period_fallback", FACT + """
SELECT categoria, anio, mes, metrica_nombre, CAST(sum(metrica_valor) AS DOUBLE) AS total FROM fact
WHERE periodo_tipo = 'acumulado' GROUP BY ALL
""")
def _(spark, d):
    rows = facts.filter_metrics(full_fact(spark, d), periodo_tipo="anual")
    return rows.groupBy("categoria", "anio", "mes", "metrica_nombre").agg(F.sum("metrica_valor").alias("total"))


@query("P20_etl_scope", """
SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders
WHERE year(o_orderdate) = 1997 AND month(o_orderdate) = 5 AND o_orderpriority = '2-HIGH'
""")
def _(spark, d):
    day = F.col("o_orderdate")
    return (
        table(spark, d, "orders")
        # a range on the stored column reaches the scan; a year() call would not
        .filter((day >= F.lit("1997-05-01").cast("timestamp_ntz")) & (day < F.lit("1997-06-01").cast("timestamp_ntz")))
        .filter(F.col("o_orderpriority") == "2-HIGH")
        .select("o_orderkey", "o_totalprice")
    )


@query("P21_any_not_null", """
SELECT * FROM (
  SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.0) AS descuento, nullif(l_tax, 0.0) AS impuesto FROM lineitem)
WHERE descuento IS NOT NULL OR impuesto IS NOT NULL
""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.nullif("l_discount", F.lit(0.0)).alias("descuento"), F.nullif("l_tax", F.lit(0.0)).alias("impuesto"),
    )
    return facts.any_not_null(rows, ["descuento", "impuesto"])


@query("P26_output_projection", FACT + """
SELECT categoria AS category, anio AS year, mes AS month, metrica_nombre AS metric, CAST(metrica_valor AS DOUBLE) AS value
FROM fact WHERE periodo_tipo = 'mensual'
""")
def _(spark, d):
    return long_fact(spark, d).select(
        F.col("categoria").alias("category"), F.col("anio").alias("year"), F.col("mes").alias("month"),
        F.col("metrica_nombre").alias("metric"), F.col("metrica_valor").alias("value"),
    )


# ---------------------------------------------------------------- star schema

_SCOPE_COLS = "anio, mes, fecha_periodo, {} codigo_indicador, nombre_indicador, unidad_medida, valor_absoluto, variacion_interanual"


@query("P08_view_region", STAR + f"""
SELECT {_SCOPE_COLS.format('')} FROM star JOIN indicadores USING (id_indicador)
WHERE ambito_geografico = 'andalucia' AND id_provincia IS NULL AND id_mercado IS NULL AND id_tipo_turismo IS NULL
""")
def _(spark, d):
    return facts.scoped_facts(star_fact(spark, d), indicators(spark, d), "region")


@query("P08_view_province", STAR + f"""
SELECT {_SCOPE_COLS.format('codigo_provincia, nombre_provincia,')} FROM star JOIN indicadores USING (id_indicador)
JOIN provincias USING (id_provincia) WHERE ambito_geografico = 'provincia'
""")
def _(spark, d):
    return facts.scoped_facts(star_fact(spark, d), indicators(spark, d), "provincia", provinces(spark, d))


@query("P08_view_market", STAR + f"""
SELECT {_SCOPE_COLS.format('codigo_mercado, nombre_mercado, tipo_mercado,')} FROM star JOIN indicadores USING (id_indicador)
JOIN mercados USING (id_mercado)
""")
def _(spark, d):
    return facts.scoped_facts(star_fact(spark, d), indicators(spark, d), "mercado", markets(spark, d))


@query("P08_view_type", STAR + f"""
SELECT {_SCOPE_COLS.format('codigo_tipo, nombre_tipo,')} FROM star JOIN indicadores USING (id_indicador)
JOIN tipos USING (id_tipo_turismo)
""")
def _(spark, d):
    return facts.scoped_facts(star_fact(spark, d), indicators(spark, d), "tipo", tourism_types(spark, d))


@query("J01_fact_dimension_join", """
SELECT p_brand, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS importe
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand
""")
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand")
    return (
        table(spark, d, "lineitem").select("l_partkey", money("l_extendedprice").alias("precio"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("precio").alias("importe"))
    )


_KPIS = {"numero_turistas": ("numero_turistas", "valor_absoluto"), "gasto_medio_diario": ("gasto_medio_diario", "valor_absoluto"),
         "var_numero_turistas": ("numero_turistas", "variacion_interanual")}


def _calendar(spark):
    from marisma.sources.reference_data import build_calendar

    return build_calendar(spark, 1995, 2001)


@query("J02_wide_view_joins", STAR + """
, cal AS (SELECT DISTINCT date_id, mes FROM star)
SELECT s.anio, s.mes, s.date_id, codigo_provincia, nombre_provincia, codigo_mercado, nombre_mercado, codigo_tipo, nombre_tipo,
  (s.mes + 2) // 3 AS trimestre, CASE WHEN s.mes <= 6 THEN 1 ELSE 2 END AS semestre,
  max(CASE WHEN codigo_indicador = 'numero_turistas' THEN valor_absoluto END) AS numero_turistas,
  max(CASE WHEN codigo_indicador = 'gasto_medio_diario' THEN valor_absoluto END) AS gasto_medio_diario
FROM star s LEFT JOIN provincias USING (id_provincia) LEFT JOIN mercados USING (id_mercado)
LEFT JOIN tipos USING (id_tipo_turismo) LEFT JOIN indicadores USING (id_indicador)
GROUP BY ALL
""")
def _(spark, d):
    wide = facts.wide_kpis(
        star_fact(spark, d), _calendar(spark), provinces(spark, d), markets(spark, d), tourism_types(spark, d),
        indicators(spark, d), _KPIS,
    )
    return wide.select(
        "anio", "mes", "date_id", "codigo_provincia", "nombre_provincia", "codigo_mercado", "nombre_mercado",
        "codigo_tipo", "nombre_tipo", "trimestre", "semestre", "numero_turistas", "gasto_medio_diario",
    )


_PERIOD_REPORT = """
SELECT coalesce(nombre_provincia, 'Total Andalucía') AS provincia, coalesce(nombre_mercado, 'Todos los mercados') AS mercado,
  coalesce(nombre_tipo, 'Todos los tipos') AS tipo_turismo, nombre_indicador AS indicador, valor_absoluto AS valor,
  variacion_interanual AS variacion, fecha_periodo AS fecha
FROM star JOIN indicadores USING (id_indicador) LEFT JOIN provincias USING (id_provincia)
LEFT JOIN mercados USING (id_mercado) LEFT JOIN tipos USING (id_tipo_turismo)
WHERE date_id = 199705
"""


@query("J03_period_report", STAR + _PERIOD_REPORT)
def _(spark, d):
    return facts.period_report(
        star_fact(spark, d), provinces(spark, d), markets(spark, d), tourism_types(spark, d), indicators(spark, d), 199705
    )


@query("A04_pivot_kpis", """
SELECT l_suppkey, year(l_shipdate) AS anio, month(l_shipdate) AS mes,
  max(l_quantity) AS cantidad, max(l_extendedprice) AS precio, max(l_discount) AS descuento, max(l_tax) AS impuesto
FROM lineitem GROUP BY ALL
""")
def _(spark, d):
    long = (
        table(spark, d, "lineitem")
        .select("l_suppkey", F.year("l_shipdate").alias("anio"), F.month("l_shipdate").alias("mes"),
                F.col("l_quantity").alias("cantidad"), F.col("l_extendedprice").alias("precio"),
                F.col("l_discount").alias("descuento"), F.col("l_tax").alias("impuesto"))
        .unpivot(["l_suppkey", "anio", "mes"], ["cantidad", "precio", "descuento", "impuesto"], "codigo", "valor")
    )
    return facts.pivot_values(long, ["l_suppkey", "anio", "mes"], "codigo", "valor", ["cantidad", "precio", "descuento", "impuesto"])


_CODES = list(dict.fromkeys(code for code, _ in fv.KPI_COLUMNS.values()))


@query("A04_pivot_all_kpis", f"""
WITH l AS (SELECT l_suppkey, list_extract({_CODES}, CAST(1 + l_partkey % {len(_CODES)} AS INT)) AS codigo, l_quantity AS valor_absoluto, l_discount AS variacion_interanual FROM lineitem)
SELECT l_suppkey, {", ".join(f"max({m}) FILTER (codigo = '{c}') AS {k}" for k, (c, m) in fv.KPI_COLUMNS.items())} FROM l GROUP BY ALL
""")
def _(spark, d):
    """The published indicators, one column each."""
    codes = F.array(*[F.lit(c) for c in _CODES])
    long = table(spark, d, "lineitem").select(
        "l_suppkey", F.get(codes, (F.col("l_partkey") % len(_CODES)).cast("int")).alias("codigo"),
        F.col("l_quantity").alias("valor_absoluto"), F.col("l_discount").alias("variacion_interanual"))
    return facts.pivot_measures(long, ["l_suppkey"], "codigo", fv.KPI_COLUMNS)


# ---------------------------------------------------------------- lookups

_ALIASES = """
WITH aliases AS (
  SELECT n_nationkey, 'n' || n_nationkey AS alias FROM nation
  UNION ALL SELECT n_nationkey, 'Pais ' || n_nationkey FROM nation
), dim AS (SELECT n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS codigo, n_name FROM nation),
questions AS (
  SELECT lower(n_name) AS termino FROM nation UNION SELECT 'N' || r_regionkey FROM region
  UNION SELECT '0' || r_regionkey FROM region UNION SELECT 'PAIS ' || (r_regionkey + 10) FROM region UNION SELECT r_name FROM region)
"""


def _alias_inputs(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    dim = nation.select("n_nationkey", F.format_string("%02d", "n_nationkey").alias("codigo"), "n_name")
    aliases = nation.select("n_nationkey", F.concat(F.lit("n"), "n_nationkey").alias("alias")).unionByName(
        nation.select("n_nationkey", F.concat(F.lit("Pais "), "n_nationkey").alias("alias"))
    )
    asked = [
        nation.select(F.lower("n_name").alias("termino")),
        region.select(F.concat(F.lit("N"), "r_regionkey").alias("termino")),
        region.select(F.concat(F.lit("0"), "r_regionkey").alias("termino")),
        region.select(F.concat(F.lit("PAIS "), (F.col("r_regionkey") + 10).cast("string")).alias("termino")),
        region.select(F.col("r_name").alias("termino")),
    ]
    questions_df = asked[0]
    for extra in asked[1:]:
        questions_df = questions_df.unionByName(extra)
    return questions_df.distinct(), dim, aliases


@query("J04_alias_lookup", _ALIASES + """
SELECT DISTINCT q.termino, d.n_nationkey, d.codigo, d.n_name FROM questions q, dim d LEFT JOIN aliases a USING (n_nationkey)
WHERE lower(d.n_name) = lower(q.termino) OR lower(d.codigo) = lower(q.termino) OR lower(a.alias) = lower(q.termino)
""")
def _(spark, d):
    asked, dim, aliases = _alias_inputs(spark, d)
    return facts.lookup_alias(asked, dim, aliases, "n_nationkey", "codigo", "n_name")


@query("J05_contains_lookup", """
WITH q AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS termino FROM part UNION SELECT DISTINCT lower(p_brand) FROM part
           UNION SELECT 'EW' UNION SELECT 'a')
SELECT DISTINCT q.termino, p_partkey, p_brand, p_name FROM q, part
WHERE contains(lower(p_name), lower(q.termino)) OR lower(p_brand) = lower(q.termino) OR lower('ref ' || p_partkey) = lower(q.termino)
""")
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_name")
    asked = (
        part.select(F.get(F.split("p_name", " "), F.lit(1)).alias("termino"))
        .unionByName(part.select(F.lower("p_brand").alias("termino")))
        .unionByName(part.select(F.explode(F.array(F.lit("EW"), F.lit("a"))).alias("termino")))
        .distinct()
    )
    aliases = part.select("p_partkey", F.concat(F.lit("ref "), "p_partkey").alias("alias"))
    return facts.lookup_contains(asked, part, aliases, "p_partkey", "p_brand", "p_name")


@query("J06_resolve_codes", """
SELECT c_custkey, n_nationkey AS id_pais, r_regionkey AS id_region FROM (
  SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal > 9000 THEN 'NADA' ELSE 'NATION_' || c_nationkey END AS pais,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'ASIA' WHEN c_mktsegment = 'MACHINERY' THEN 'NINGUNA' END AS region FROM customer)
LEFT JOIN nation ON n_name = pais LEFT JOIN region ON r_name = region
""")
def _(spark, d):
    rows = table(spark, d, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, None).when(F.col("c_acctbal") > 9000, F.lit("NADA"))
        .otherwise(F.concat(F.lit("NATION_"), "c_nationkey")).alias("pais"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("ASIA"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.lit("NINGUNA")).alias("region"),
    )
    return facts.resolve_codes(
        rows, [(table(spark, d, "nation"), "n_name", "n_nationkey", "pais"), (table(spark, d, "region"), "r_name", "r_regionkey", "region")]
    ).select("c_custkey", F.col("n_nationkey").alias("id_pais"), F.col("r_regionkey").alias("id_region"))


@query("J11_mapping_join", f"""
SELECT c_custkey, m.iso, m.pais FROM customer LEFT JOIN (VALUES {", ".join(f"({i}, '{n}', '{c}')" for i, (n, c) in enumerate(fv.COUNTRY_ISO.items()))}) m(k, pais, iso)
  ON c_custkey % {len(fv.COUNTRY_ISO) + 2} = k
""")
def _(spark, d):
    names = F.array(*[F.lit(n) for n in fv.COUNTRY_ISO])
    country = F.get(names, (F.col("c_custkey") % (len(fv.COUNTRY_ISO) + 2)).cast("int"))
    mapping = spark.createDataFrame(list(fv.COUNTRY_ISO.items()), "pais string, iso string")
    rows = table(spark, d, "customer").select("c_custkey", country.alias("pais"))
    return rows.join(mapping, "pais", "left").select("c_custkey", "iso", "pais")


@query("J12_scope_classification", """
SELECT token, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE lower(n_name) = lower(token)) THEN 'provincia'
  WHEN EXISTS (SELECT 1 FROM region WHERE lower(r_name) = lower(token)) THEN 'mercado'
  WHEN EXISTS (SELECT 1 FROM customer WHERE lower(c_mktsegment) = lower(token)) THEN 'segmento' ELSE 'desconocido' END AS ambito
FROM (SELECT lower(n_name) AS token FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT DISTINCT lower(c_mktsegment) FROM customer
      UNION ALL SELECT DISTINCT p_brand FROM part)
""")
def _(spark, d):
    nation, region, customer, part = (table(spark, d, t) for t in ("nation", "region", "customer", "part"))
    tokens = (
        nation.select(F.lower("n_name").alias("token"))
        .unionByName(region.select(F.col("r_name").alias("token")))
        .unionByName(customer.select(F.lower("c_mktsegment").alias("token")).distinct())
        .unionByName(part.select(F.col("p_brand").alias("token")).distinct())
    )
    return facts.classify_by_dictionaries(
        tokens, "token", [("provincia", nation, "n_name"), ("mercado", region, "r_name"), ("segmento", customer, "c_mktsegment")]
    )


@query("J14_period_comparison", FACT + """
SELECT provincia, metrica_nombre, total, total_previo, total - total_previo AS diferencia,
  CASE WHEN total_previo <> 0 THEN (total - total_previo) * 100 / total_previo END AS variacion_pct FROM (
  SELECT provincia, metrica_nombre, CAST(sum(metrica_valor) FILTER (anio = 1999) AS DOUBLE) AS total,
    CAST(sum(metrica_valor) FILTER (anio = 1998) AS DOUBLE) AS total_previo
  FROM fact WHERE periodo_tipo = 'mensual' AND mes <= 3 AND anio IN (1998, 1999) GROUP BY ALL)
""".replace("total - total_previo AS diferencia", "round(total - total_previo, 2) AS diferencia")
   .replace("END AS variacion_pct", "END AS variacion_pct").replace("THEN (total - total_previo) * 100 / total_previo", "THEN round((total - total_previo) * 100 / total_previo, 4)"))
def _(spark, d):
    out = questions.compare_part_of_year(long_fact(spark, d, [1998, 1999]), "q1", 1999, 1998, ["provincia", "metrica_nombre"])
    return out.withColumn("variacion_pct", F.round("variacion_pct", 4))


# ---------------------------------------------------------------- aggregations

@query("A01_aggregate_metrics", FACT + """
SELECT categoria, anio, metrica_nombre AS metrica, CAST(sum(metrica_valor) AS DOUBLE) AS total,
  round(CAST(sum(metrica_valor) AS DOUBLE) / count(metrica_valor), 4) AS promedio, count(*) AS registros
FROM fact WHERE periodo_tipo = 'mensual' GROUP BY ALL ORDER BY anio DESC, categoria, metrica LIMIT 100
""")
def _(spark, d):
    return facts.aggregate_metrics(long_fact(spark, d), limit=100).withColumn("promedio", F.round("promedio", 4))


@query("A02_count_per_category", "SELECT c_mktsegment AS categoria, count(*) AS n FROM customer GROUP BY ALL")
def _(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("categoria")).agg(F.count("*").alias("n"))


@query("A03_distinct_years", "SELECT DISTINCT year(o_orderdate) AS anio FROM orders ORDER BY 1")
def _(spark, d):
    return table(spark, d, "orders").select(F.year("o_orderdate").alias("anio")).distinct().orderBy("anio")


@query("A05_year_category_totals", FACT + """
SELECT anio, categoria, CAST(sum(metrica_valor) AS DOUBLE) AS total, CASE WHEN grouping(categoria) = 1 THEN 1 ELSE 0 END AS nivel
FROM fact WHERE periodo_tipo = 'mensual' GROUP BY GROUPING SETS ((anio, categoria), (anio))
""")
def _(spark, d):
    return facts.year_category_totals(long_fact(spark, d))


@query("A06_year_over_year", FACT + """
SELECT categoria, metrica_nombre, anio, total, total_previo, round(total - total_previo, 2) AS diferencia,
  CASE WHEN total_previo <> 0 THEN round((total - total_previo) * 100 / total_previo, 4) END AS variacion_pct
FROM (SELECT categoria, metrica_nombre, anio, total, lag(total) OVER (PARTITION BY categoria, metrica_nombre ORDER BY anio) AS total_previo
  FROM (SELECT categoria, metrica_nombre, anio, CAST(sum(metrica_valor) AS DOUBLE) AS total FROM fact WHERE periodo_tipo = 'mensual' GROUP BY ALL))
""")
def _(spark, d):
    out = facts.year_over_year(long_fact(spark, d), ["categoria", "metrica_nombre"])
    return out.withColumn("variacion_pct", F.round("variacion_pct", 4))


@query("A07_coverage_gaps", FACT + """
SELECT y.provincia, y.anio, r.categoria FROM (SELECT DISTINCT provincia, anio FROM fact) y,
  (VALUES ('BUILDING'), ('FURNITURE'), ('cruceros'), ('litoral')) r(categoria)
WHERE NOT EXISTS (SELECT 1 FROM fact f WHERE f.provincia IS NOT DISTINCT FROM y.provincia AND f.anio = y.anio AND f.categoria = r.categoria)
""")
def _(spark, d):
    return facts.coverage_gaps(long_fact(spark, d), ["BUILDING", "FURNITURE", "cruceros", "litoral"], by=["provincia"])


@query("A20_section_merge", """
SELECT l_partkey, year(l_shipdate) AS anio, max_by(l_quantity, l_orderkey * 1000 + l_linenumber * 100 + l_quantity) FILTER (l_linestatus = 'O') AS "O",
  max_by(l_quantity, l_orderkey * 1000 + l_linenumber * 100 + l_quantity) FILTER (l_linestatus = 'F') AS "F"
FROM lineitem GROUP BY ALL
""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_partkey", F.year("l_shipdate").alias("anio"), "l_linestatus", "l_quantity",
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_quantity")).alias("fila"),
    )
    return facts.merge_sections(rows, ["l_partkey", "anio"], "l_linestatus", "l_quantity", "fila", ["O", "F"])


@query("W10_same_month_last_year", FACT + """
, m AS (SELECT categoria, metrica_nombre, anio, mes, CAST(sum(metrica_valor) AS DOUBLE) AS total FROM fact WHERE periodo_tipo = 'mensual' GROUP BY ALL)
SELECT a.*, b.total AS total_previo, round(a.total - b.total, 2) AS diferencia,
  CASE WHEN b.total <> 0 THEN round((a.total - b.total) * 100 / b.total, 4) END AS variacion_pct
FROM m a LEFT JOIN m b ON a.categoria = b.categoria AND a.metrica_nombre = b.metrica_nombre AND a.anio = b.anio + 1 AND a.mes = b.mes
""")
def _(spark, d):
    out = facts.same_month_last_year(long_fact(spark, d), ["categoria", "metrica_nombre"])
    return out.withColumn("variacion_pct", F.round("variacion_pct", 4))


@query("W10_same_month_null_keys", FACT + """
, m AS (SELECT nullif(categoria, (SELECT min(categoria) FROM fact)) AS categoria, metrica_nombre, anio, mes, CAST(sum(metrica_valor) AS DOUBLE) AS total FROM fact WHERE periodo_tipo = 'mensual' GROUP BY ALL)
SELECT a.*, b.total AS total_previo, round(a.total - b.total, 2) AS diferencia,
  CASE WHEN b.total <> 0 THEN round((a.total - b.total) * 100 / b.total, 4) END AS variacion_pct
FROM m a LEFT JOIN m b ON a.categoria IS NOT DISTINCT FROM b.categoria AND a.metrica_nombre = b.metrica_nombre AND a.anio = b.anio + 1 AND a.mes = b.mes
""")
def _(spark, d):
    """A null category is "all" and meets its own previous year."""
    rows = long_fact(spark, d)
    least = rows.agg(F.min("categoria")).scalar()
    out = facts.same_month_last_year(rows.withColumn("categoria", F.nullif("categoria", least)), ["categoria", "metrica_nombre"])
    return out.withColumn("variacion_pct", F.round("variacion_pct", 4))


# ---------------------------------------------------------------- sorts

@query("T01_list_metrics", """
SELECT o_orderkey, year(o_orderdate) AS anio, month(o_orderdate) AS mes, o_totalprice FROM orders
ORDER BY anio DESC, mes DESC, o_orderkey LIMIT 100
""")
def _(spark, d):
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("anio"), F.month("o_orderdate").alias("mes"), "o_totalprice"
    )
    return facts.list_metrics(rows, 100, ("o_orderkey",))


@query("T02_top_values", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice IS NOT NULL
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10
""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return facts.top_values(rows, "l_extendedprice", 10, ("l_orderkey", "l_linenumber"))


@query("T09_best_month", FACT + """
SELECT anio, mes, total FROM (SELECT anio, mes, CAST(sum(metrica_valor) AS DOUBLE) AS total,
  row_number() OVER (PARTITION BY anio ORDER BY sum(metrica_valor) DESC, mes) AS rn
  FROM fact WHERE periodo_tipo = 'mensual' AND metrica_nombre = 'importe' GROUP BY anio, mes) WHERE rn = 1
""")
def _(spark, d):
    return questions.arg_max(long_fact(spark, d).filter("metrica_nombre = 'importe'"), "mes", ["anio"])


# ---------------------------------------------------------------- set operations

@query("U01_union_of_sources", """
SELECT 'orders' AS fuente_tipo, o_orderkey AS clave, CAST(o_totalprice AS DOUBLE) AS metrica_valor, NULL AS descuento, o_orderpriority AS nota FROM orders
UNION ALL SELECT 'lineitem', l_orderkey, l_extendedprice, l_discount, NULL FROM lineitem
""")
def _(spark, d):
    a = table(spark, d, "orders").select(
        F.lit("orders").alias("fuente_tipo"), F.col("o_orderkey").alias("clave"),
        F.col("o_totalprice").alias("metrica_valor"), F.col("o_orderpriority").alias("nota"))
    b = table(spark, d, "lineitem").select(
        F.lit("lineitem").alias("fuente_tipo"), F.col("l_orderkey").alias("clave"),
        F.col("l_extendedprice").alias("metrica_valor"), F.col("l_discount").alias("descuento"))
    return a.unionByName(b, allowMissingColumns=True)


@query("U02_group_without_exclusions", """
SELECT n_name FROM nation WHERE n_regionkey = 3 EXCEPT SELECT n_name FROM nation WHERE n_nationkey IN (3, 8)
""")
def _(spark, d):
    nation = table(spark, d, "nation")
    group = nation.filter("n_regionkey = 3").select("n_name")
    return group.subtract(nation.filter(F.col("n_nationkey").isin(3, 8)).select("n_name"))


# ---------------------------------------------------------------- question families

_M = " periodo_tipo = 'mensual' "


@query("N01_point_lookup", FACT + f"""
SELECT categoria, provincia, anio, mes, periodo_tipo, metrica_nombre, CAST(metrica_valor AS DOUBLE) AS metrica_valor FROM fact
WHERE categoria = 'BUILDING' AND anio = 2000 AND mes = 4 AND metrica_nombre = 'pedidos' AND {_M}
""")
def _(spark, d):
    return questions.point_lookup(full_fact(spark, d, [2000]), categorias=["BUILDING"], anios=[2000], meses=[4],
                                  periodo_tipo="mensual", metricas=["Pedidos"])


def _asia(spark, d):
    return table(spark, d, "nation").filter("n_regionkey = 2").select(
        F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.substring("n_name", 2, 100))).alias("provincia"))


_ASIA = "(SELECT upper(n_name[1]) || lower(n_name[2:]) FROM nation WHERE n_regionkey = 2)"


@query("N02_group_year_to_date", FACT + f"""
SELECT metrica_nombre, anio, CAST(sum(metrica_valor) AS DOUBLE) AS total FROM fact
WHERE provincia IN {_ASIA} AND anio = 2001 AND {_M} GROUP BY ALL
""")
def _(spark, d):
    rows = facts.filter_metrics(long_fact(spark, d, [2001]), anios=[2001])
    return questions.group_total(rows, _asia(spark, d), "provincia", ["metrica_nombre", "anio"])


@query("N03_period_total", FACT + f"""
SELECT metrica_nombre, CAST(sum(metrica_valor) AS DOUBLE) AS total FROM fact WHERE anio = 1998 AND mes = 1 AND {_M} GROUP BY ALL
""")
def _(spark, d):
    return questions.period_total(long_fact(spark, d, [1998]), ["metrica_nombre"], anios=[1998], meses=[1])


@query("N04_arg_max_entity", FACT + f"""
SELECT anio, mes, provincia, total FROM (SELECT anio, mes, provincia, CAST(sum(metrica_valor) AS DOUBLE) AS total,
  row_number() OVER (PARTITION BY anio, mes ORDER BY sum(metrica_valor) DESC, provincia) AS rn FROM fact
  WHERE metrica_nombre = 'importe' AND {_M} GROUP BY anio, mes, provincia) WHERE rn = 1
""")
def _(spark, d):
    return questions.arg_max(long_fact(spark, d), "provincia", ["anio", "mes"], metricas=["importe"])


@query("N05_period_mean", FACT + f"""
SELECT categoria, metrica_nombre, round(CAST(sum(metrica_valor) AS DOUBLE) / count(*), 4) AS promedio FROM fact
WHERE anio = 1999 AND mes = 4 AND {_M} GROUP BY ALL
""")
def _(spark, d):
    out = questions.period_mean(long_fact(spark, d, [1999]), ["categoria", "metrica_nombre"], anios=[1999], meses=[4])
    return out.withColumn("promedio", F.round("promedio", 4))


@query("N06_part_of_year", FACT + f"""
SELECT metrica_nombre, anio, CAST(sum(metrica_valor) AS DOUBLE) AS total FROM fact WHERE mes IN (6, 7, 8) AND {_M} GROUP BY ALL
""")
def _(spark, d):
    return questions.part_of_year(long_fact(spark, d), "verano", ["metrica_nombre"])


@query("N06_compare_part_of_year", FACT + f"""
SELECT metrica_nombre, total, total_previo, round(total - total_previo, 2) AS diferencia,
  round((total - total_previo) * 100 / total_previo, 4) AS variacion_pct FROM (
  SELECT metrica_nombre, CAST(sum(metrica_valor) FILTER (anio = 2000) AS DOUBLE) AS total, CAST(sum(metrica_valor) FILTER (anio = 1999) AS DOUBLE) AS total_previo
  FROM fact WHERE mes IN (4, 5, 6) AND anio IN (1999, 2000) AND {_M} GROUP BY ALL)
""")
def _(spark, d):
    out = questions.compare_part_of_year(long_fact(spark, d, [1999, 2000]), "q2", 2000, 1999, ["metrica_nombre"])
    return out.withColumn("variacion_pct", F.round("variacion_pct", 4))


@query("N07_group_minus_exclusions", FACT + f"""
SELECT anio, metrica_nombre, CAST(sum(metrica_valor) AS DOUBLE) AS total FROM fact
WHERE provincia IN {_ASIA} AND provincia NOT IN ('Nation_2', 'Nation_7') AND {_M} GROUP BY ALL
""")
def _(spark, d):
    return questions.group_total(long_fact(spark, d), _asia(spark, d), "provincia", ["anio", "metrica_nombre"],
                                 excluded=["Nation_2", "Nation_7"])


@query("N08_percent_change", FACT + f"""
SELECT categoria, round(a, 4) AS promedio, round(b, 4) AS promedio_previo, round((a - b) * 100 / b, 4) AS variacion_pct FROM (
  SELECT categoria, CAST(sum(metrica_valor) FILTER (anio = 2000) AS DOUBLE) / count(*) FILTER (anio = 2000) AS a,
    CAST(sum(metrica_valor) FILTER (anio = 1999) AS DOUBLE) / count(*) FILTER (anio = 1999) AS b
  FROM fact WHERE metrica_nombre = 'importe' AND anio IN (1999, 2000) AND {_M} GROUP BY ALL)
""")
def _(spark, d):
    out = questions.mean_change(long_fact(spark, d, [1999, 2000]).filter("metrica_nombre = 'importe'"), ["categoria"], 2000, 1999)
    return out.select("categoria", *[F.round(c, 4).alias(c) for c in ("promedio", "promedio_previo", "variacion_pct")])


@query("N09_share_outside_group", FACT + f"""
SELECT anio, metrica_nombre, CAST(sum(metrica_valor) FILTER (provincia NOT IN {_ASIA}) AS DOUBLE) AS parte, CAST(sum(metrica_valor) AS DOUBLE) AS total,
  round(CAST(sum(metrica_valor) FILTER (provincia NOT IN {_ASIA}) AS DOUBLE) * 100 / CAST(sum(metrica_valor) AS DOUBLE), 4) AS cuota_pct
FROM fact WHERE mes <= 6 AND {_M} GROUP BY ALL
""")
def _(spark, d):
    rows = long_fact(spark, d).filter(times.in_month_group(F.col("mes"), "s1"))
    out = questions.share_outside(rows, _asia(spark, d), "provincia", ["anio", "metrica_nombre"])
    return out.withColumn("cuota_pct", F.round("cuota_pct", 4))


@query("N09_share_by_entity", FACT + f"""
SELECT anio, metrica_nombre, provincia, parte, total, round(parte * 100 / total, 4) AS cuota_pct FROM (
  SELECT anio, metrica_nombre, provincia, CAST(sum(metrica_valor) AS DOUBLE) AS parte,
    CAST(sum(sum(metrica_valor)) OVER (PARTITION BY anio, metrica_nombre) AS DOUBLE) AS total FROM fact WHERE {_M} GROUP BY anio, metrica_nombre, provincia)
""")
def _(spark, d):
    out = questions.share_by_entity(long_fact(spark, d), "provincia", ["anio", "metrica_nombre"])
    return out.withColumn("cuota_pct", F.round("cuota_pct", 4))


@query("N10_monthly_trend", FACT + f"""
, m AS (SELECT metrica_nombre, anio, mes, CAST(sum(metrica_valor) FILTER (categoria = 'BUILDING') AS DOUBLE) AS serie_a,
  CAST(sum(metrica_valor) FILTER (categoria = 'FURNITURE') AS DOUBLE) AS serie_b FROM fact WHERE categoria IN ('BUILDING', 'FURNITURE') AND {_M} GROUP BY ALL)
SELECT m.*, round(p.a, 3) AS pendiente_a, round(p.b, 3) AS pendiente_b FROM m JOIN
  (SELECT metrica_nombre, anio, regr_slope(serie_a, mes) AS a, regr_slope(serie_b, mes) AS b FROM m GROUP BY ALL) p USING (metrica_nombre, anio)
""")
def _(spark, d):
    out = questions.monthly_trend(long_fact(spark, d), ["metrica_nombre"], "categoria", "BUILDING", "FURNITURE")
    return out.withColumns({c: F.round(c, 3) for c in ("pendiente_a", "pendiente_b")})


@query("N11_ranking", """
SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem
GROUP BY ALL ORDER BY total DESC, l_suppkey LIMIT 10
""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", money("l_extendedprice").alias("metrica_valor"))
    return questions.ranking(rows, "l_suppkey", 10)


@query("N12_entity_comparison", FACT + f"""
SELECT anio, metrica_nombre, a AS total_a, b AS total_b, round(b - a, 2) AS diferencia, round((b - a) * 100 / a, 4) AS variacion_pct FROM (
  SELECT anio, metrica_nombre, CAST(sum(metrica_valor) FILTER (categoria = 'BUILDING') AS DOUBLE) AS a,
   CAST(sum(metrica_valor) FILTER (categoria = 'MACHINERY') AS DOUBLE) AS b FROM fact WHERE categoria IN ('BUILDING', 'MACHINERY') AND {_M} GROUP BY ALL)
""")
def _(spark, d):
    out = facts.compare_entities(long_fact(spark, d), "categoria", "BUILDING", "MACHINERY", ["anio", "metrica_nombre"])
    return out.withColumn("variacion_pct", F.round("variacion_pct", 4))


@query("N13_several_dimensions", """
SELECT s_nationkey, l_returnflag, year(l_shipdate) AS anio,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_linestatus = 'O') AS DOUBLE) AS "O",
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_linestatus = 'F') AS DOUBLE) AS "F"
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE month(l_shipdate) IN (6, 7, 8) GROUP BY ALL
""")
def _(spark, d):
    rows = (
        table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .select("s_nationkey", "l_returnflag", "l_linestatus", F.year("l_shipdate").alias("anio"),
                F.month("l_shipdate").alias("mes"), money("l_extendedprice").alias("metrica_valor"))
    )
    return questions.several_dimensions(rows, ["s_nationkey", "l_returnflag", "anio"], "l_linestatus", ["O", "F"], "verano")


@query("N14_largest_changes", FACT + f"""
, m AS (SELECT metrica_nombre, anio, mes, CAST(sum(metrica_valor) AS DOUBLE) AS total FROM fact WHERE {_M} GROUP BY ALL)
SELECT a.*, b.total AS total_previo, round(a.total - b.total, 2) AS diferencia, round((a.total - b.total) * 100 / b.total, 4) AS variacion_pct
FROM m a JOIN m b ON a.metrica_nombre = b.metrica_nombre AND a.anio = b.anio + 1 AND a.mes = b.mes
ORDER BY abs((a.total - b.total) * 100 / b.total) DESC, metrica_nombre, anio, mes LIMIT 5
""")
def _(spark, d):
    out = questions.largest_changes(long_fact(spark, d), ["metrica_nombre"], 5)
    return out.withColumn("variacion_pct", F.round("variacion_pct", 4))


# ---------------------------------------------------------------- calendar columns

@query("F19_month_numbers", """
SELECT o_orderkey, month(o_orderdate) AS mes, 2000 + year(o_orderdate) % 100 AS anio FROM orders
""")
def _(spark, d):
    m = F.month("o_orderdate")
    spelled = F.when(F.col("o_orderkey") % 2 == 0, times.month_name(m)).otherwise(F.upper(times.month_abbr(m)))
    return table(spark, d, "orders").select(
        "o_orderkey", times.month_number(spelled).alias("mes"),
        times.full_year(F.date_format("o_orderdate", "yy")).alias("anio"),
    )


@query("F21_period_from_report_date", """
SELECT o_orderkey, CAST(date_trunc('month', CASE WHEN day(o_orderdate) <= 10 THEN o_orderdate - INTERVAL 1 MONTH ELSE o_orderdate END) AS DATE) AS periodo FROM orders
""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", times.period_from_report_date(F.col("o_orderdate")).alias("periodo"))


_NAMES = "['enero','febrero','marzo','abril','mayo','junio','julio','agosto','septiembre','octubre','noviembre','diciembre']"


@query("F22_calendar_columns", f"""
SELECT o_orderkey, year(o_orderdate) * 100 + month(o_orderdate) AS date_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS fecha_periodo,
  quarter(o_orderdate) AS trimestre, CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END AS semestre,
  ({_NAMES})[month(o_orderdate)] AS mes_nombre, ({_NAMES})[month(o_orderdate)][:3] AS mes_abrev FROM orders
""")
def _(spark, d):
    y, m = F.year("o_orderdate"), F.month("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", times.date_id(y, m).alias("date_id"), times.first_of_month(y, m).alias("fecha_periodo"),
        times.quarter_of(m).alias("trimestre"), times.semester_of(m).alias("semestre"),
        times.month_name(m).alias("mes_nombre"), times.month_abbr(m).alias("mes_abrev"),
    )


@query("F24_seasons", """
SELECT grupo, count(*) AS n FROM orders JOIN (VALUES ('q1',[1,2,3]),('q2',[4,5,6]),('q3',[7,8,9]),('q4',[10,11,12]),('s1',[1,2,3,4,5,6]),
 ('s2',[7,8,9,10,11,12]),('verano',[6,7,8]),('invierno',[12,1,2])) g(grupo, meses) ON list_contains(meses, month(o_orderdate)) GROUP BY ALL
""")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.month("o_orderdate").alias("mes"))
    return questions.season_of_months(rows).groupBy("grupo").agg(F.count("*").alias("n"))
