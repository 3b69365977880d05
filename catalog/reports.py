"""Sources, sinks and report grids.  Files and grids are derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import FACT, STAR, indicators, long_fact, markets, provinces, query, star_fact, table, tourism_types
from catalog.corpus import docs
from marisma.functions import fixed_values as fv
from marisma.functions import numbers, times
from marisma.operators import facts, grids, upserts
from marisma.session import work_dir
from marisma.sources import corpus, reference_data, reports, tables

# ---------------------------------------------------------------- report grids

_CATS = {"AUTOMOBILE": ("01", "total_turistas"), "BUILDING": ("11", "cruceros"), "FURNITURE": ("20", "malaga"),
         "HOUSEHOLD": ("05", "extranjeros"), "MACHINERY": ("09", "litoral")}
_ABBR = "['ene','feb','mar','abr','may','jun','jul','ago','sep','oct','nov','dic']"
_CAT_SQL = "CASE categoria WHEN 'AUTOMOBILE' THEN 'total_turistas' WHEN 'BUILDING' THEN 'cruceros' WHEN 'FURNITURE' THEN 'malaga' WHEN 'HOUSEHOLD' THEN 'extranjeros' ELSE 'litoral' END"
_NUM_SQL = "CASE categoria WHEN 'AUTOMOBILE' THEN '01' WHEN 'BUILDING' THEN '11' WHEN 'FURNITURE' THEN '20' WHEN 'HOUSEHOLD' THEN '05' ELSE '09' END"
_FILE_SQL = f"{_NUM_SQL} || '_' || {_CAT_SQL} || '_' || ({_ABBR})[mes] || lpad(CAST(anio % 100 AS VARCHAR), 2, '0') || '.xlsx'"


def _pivoted(spark, d):
    """One row per segment, month and nation with its file name and line number."""
    fact = long_fact(spark, d)
    rows = facts.pivot_values(fact, ["categoria", "provincia", "anio", "mes"], "metrica_nombre", "metrica_valor", ["pedidos", "importe"])
    number = F.create_map(*[F.lit(x) for k, (n, _) in _CATS.items() for x in (k, n)])[F.col("categoria")]
    token = F.create_map(*[F.lit(x) for k, (_, t) in _CATS.items() for x in (k, t)])[F.col("categoria")]
    name = F.concat(number, F.lit("_"), token, F.lit("_"), times.month_abbr(F.col("mes")), F.lpad((F.col("anio") % 100).cast("string"), 2, "0"), F.lit(".xlsx"))
    return rows.withColumns({"file": name, "linea": F.regexp_extract("provincia", r"(\d+)$", 1).cast("int")})


def _cells(rows, extra, keep, cells, sheet="ficha"):
    """Grid from per-row cells plus fixed cells once per file."""
    own = rows.select("file", F.col(keep).alias("row"), F.explode(F.array(*[F.struct(F.lit(c).alias("col"), v.alias("value")) for c, v in cells])).alias("c"))
    fixed = rows.select("file").distinct().select("file", F.explode(F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(v).alias("value")) for r, c, v in extra])).alias("x"))
    grid = own.select("file", "row", "c.col", "c.value").unionByName(fixed.select("file", "x.row", "x.col", "x.value"))
    return grid.filter(F.col("value").isNotNull()).select("file", F.lit(sheet).alias("sheet"), "row", "col", "value")


def metric_grid(spark, d):
    """Headings, a section, and a line per nation; every fifth line has its value two columns to the right."""
    rows = _pivoted(spark, d).withColumn("fila", F.col("linea") + 12)
    shifted = F.col("linea") % 5 == 0
    amount, count = F.col("importe").cast("string"), F.col("pedidos").cast("string")
    cells = [
        (1, F.col("provincia")),
        (2, F.when(~shifted, amount)), (3, F.when(shifted, F.lit("0,245")).otherwise(F.lit("-0,3"))),
        (4, F.when(shifted, amount).otherwise(F.lit("abril - 2024"))),
        (5, count), (6, F.lit("0,5")), (7, F.lit("enero-abril - 2024")),
    ]
    extra = [(10, 2, "DATOS MENSUALES"), (10, 5, "datos acumulado año"), (11, 1, "VIAJEROS EN ESTABLECIMIENTOS HOTELEROS DE ANDALUCÍA")]
    return _cells(rows, extra, "fila", cells)


_WIDE = FACT + """
, w AS (SELECT categoria, provincia, anio, mes, CAST(regexp_extract(provincia, '(\\d+)$', 1) AS INT) AS linea,
   max(metrica_valor) FILTER (metrica_nombre = 'pedidos') AS pedidos, max(metrica_valor) FILTER (metrica_nombre = 'importe') AS importe
   FROM fact WHERE periodo_tipo = 'mensual' GROUP BY ALL)
"""


@query("H06_grid_to_metrics", _WIDE + f"""
SELECT {_CAT_SQL} AS categoria, mes, 2000 + anio % 100 AS anio, t AS periodo_tipo, 'Número de viajeros en establecimientos hoteleros - ' || provincia AS metrica_nombre,
 CASE WHEN t = 'mensual' THEN CAST(importe AS DOUBLE) ELSE CAST(pedidos AS DOUBLE) END AS metrica_valor,
 CASE WHEN t = 'acumulado' THEN CAST(pedidos AS VARCHAR) WHEN linea % 5 = 0 THEN NULL ELSE CAST(importe AS VARCHAR) END AS metrica_valor_raw,
 CASE WHEN t = 'acumulado' THEN 0.5 WHEN linea % 5 = 0 THEN 0.245 ELSE -0.3 END::DOUBLE AS variacion_interanual,
 CASE WHEN t = 'acumulado' THEN 'enero-abril - 2024' WHEN linea % 5 = 0 THEN CAST(importe AS VARCHAR) ELSE 'abril - 2024' END AS periodo_descripcion,
 CASE WHEN categoria = 'FURNITURE' THEN 'Malaga' END AS provincia, linea + 12 AS fila_excel FROM w, (VALUES ('mensual'), ('acumulado')) x(t)
""")
def _(spark, d):
    return grids.grid_to_metrics(metric_grid(spark, d), min_abs=1.0, first_row=10).select(
        "categoria", "mes", "anio", "periodo_tipo", "metrica_nombre", "metrica_valor", "metrica_valor_raw", "variacion_interanual",
        "periodo_descripcion", "provincia", "fila_excel")


def _eu(col):
    return F.translate(F.format_number(col, 2), ",.", ".,")


@query("H07_table_to_metrics", _WIDE + f"""
, big AS (SELECT categoria, anio, mes FROM w GROUP BY ALL HAVING count(*) >= 4)
SELECT {_CAT_SQL} AS categoria, mes, 2000 + anio % 100 AS anio, t AS periodo_tipo, 'Número ' || provincia AS metrica_nombre,
 CAST(CASE WHEN t = 'mensual' THEN importe ELSE pedidos END AS DOUBLE) AS metrica_valor, CASE WHEN t = 'mensual' THEN -0.3 END::DOUBLE AS variacion_interanual,
 ({_ABBR})[mes] || ' - ' || (2000 + anio % 100) AS periodo_descripcion FROM w JOIN big USING (categoria, anio, mes), (VALUES ('mensual'), ('acumulado'), ('anual')) x(t)
WHERE t <> 'anual' OR linea % 2 = 0
""")
def _(spark, d):
    rows = _pivoted(spark, d).withColumns({"fila": F.col("linea") + 2, "hoja": F.col("categoria")})
    rows = rows.withColumn("file", F.concat(F.lit("ultimos-datos_"), times.month_abbr(F.col("mes")), F.lpad((F.col("anio") % 100).cast("string"), 2, "0"), F.lit(".pdf|"), "categoria"))
    cells = [(0, F.concat(F.lit("N(cid:184)mero "), "provincia")), (1, F.concat(_eu(F.col("importe")), F.lit(" -0,3% abril - 2024"))),
             (4, _eu(F.col("pedidos"))), (6, F.when(F.col("linea") % 2 == 0, _eu(F.col("pedidos"))))]
    grid = _cells(rows, [(0, 1, "DATOS MENSUALES"), (1, 0, "Indicador")], "fila", cells)
    token = F.create_map(*[F.lit(x) for k, (_, t) in _CATS.items() for x in (k, t)])
    parts = F.split("file", r"\|")
    grid = grid.withColumns({"categoria": token[F.get(parts, F.lit(1))], "sheet": F.get(parts, F.lit(1)), "file": F.get(parts, F.lit(0))})
    return grids.table_to_metrics(grid, min_rows=6).select(
        "categoria", "mes", "anio", "periodo_tipo", "metrica_nombre", "metrica_valor", "variacion_interanual", "periodo_descripcion")


@query("H08_grid_to_wide", _WIDE + f"""
SELECT file, max_by(CAST(importe AS DOUBLE), linea) FILTER (linea % 2 = 0) AS viajeros_hoteles, max_by(CAST(pedidos AS DOUBLE), linea) FILTER (linea % 2 = 1) AS gasto_medio_diario
FROM (SELECT *, {_FILE_SQL} AS file FROM w) GROUP BY ALL
""")
def _(spark, d):
    rows = _pivoted(spark, d)
    even = F.col("linea") % 2 == 0
    label = F.when(even, F.lit(" Número de viajeros en establecimientos hoteleros. Total")).otherwise(F.lit("Gasto medio diario (euros)"))
    value = F.when(even, F.format_number("importe", 2)).otherwise(F.format_number("pedidos", 2))
    grid = _cells(rows, [(100, 1, "Gasto medio diario (euros)"), (100, 2, "-")], "linea", [(1, label), (2, value)])
    return grids.grid_to_wide(grid).select("file", "viajeros_hoteles", "gasto_medio_diario")


@query("H08_grid_to_first_monthly", _WIDE + f"""
SELECT file, min_by(CAST(pedidos * 100 AS DOUBLE), linea) FILTER (linea % 3 <> 0) AS viajeros, NULL::DOUBLE AS pernoctaciones FROM (SELECT *, {_FILE_SQL} AS file FROM w) GROUP BY ALL HAVING count(*) FILTER (linea % 3 <> 0) > 0
""")
def _(spark, d):
    period = F.when(F.col("linea") % 3 == 0, F.lit("enero-junio - 2025")).otherwise(F.lit("junio - 2025"))
    cells = [(1, F.lit("Número de viajeros en establecimientos hoteleros")), (2, _eu(F.col("pedidos"))), (4, period)]
    grid = _cells(_pivoted(spark, d), [(0, 1, "FICHA")], "linea", cells)
    return grids.grid_to_first_monthly(grid, {"viajeros": "viajeros", "pernoctaciones": "pernoctaciones"}, F.lit(2025))


@query("H08_grid_to_countries", _WIDE + f"""
, iso(k, pais, codigo) AS (VALUES {", ".join(f"({i}, '{p}', '{c}')" for i, (p, c) in enumerate(fv.COUNTRY_ISO.items()))})
SELECT {_FILE_SQL} AS file, codigo AS codigo_pais, pais AS nombre_pais, CAST(importe * 100 AS BIGINT) AS viajeros_hoteles, CASE WHEN linea % 2 = 0 THEN CAST(pedidos * 100 AS BIGINT) END AS pernoctaciones_hoteles
FROM w JOIN iso ON linea = k
""")
def _(spark, d):
    rows = _pivoted(spark, d)
    country = F.get(F.array(*[F.lit(n) for n in fv.COUNTRY_ISO]), F.col("linea"))
    top = _cells(rows.withColumn("fila", F.col("linea") + 1), [(0, 0, "VIAJEROS EN ESTABLECIMIENTOS HOTELEROS")], "fila", [(1, country), (3, _eu(F.col("importe")))])
    low = _cells(rows.withColumn("fila", F.col("linea") + 101), [(100, 0, "PERNOCTACIONES EN ESTABLECIMIENTOS HOTELEROS")], "fila",
                 [(1, country), (3, F.when(F.col("linea") % 2 == 0, _eu(F.col("pedidos"))).otherwise(F.lit("-")))])
    return grids.grid_to_countries(top.unionByName(low))


# ---------------------------------------------------------------- names and sheets

@query("S04_parse_report_filename", FACT + f"""
SELECT DISTINCT {_FILE_SQL} AS file, {_NUM_SQL} AS numero, {_CAT_SQL} AS categoria, mes, 2000 + anio % 100 AS anio, make_date(2000 + anio % 100, mes, 1) AS periodo FROM fact WHERE periodo_tipo = 'mensual'
""")
def _(spark, d):
    names = _pivoted(spark, d).select("file").distinct()
    bad = names.select(F.concat(F.lit("x"), "file").alias("file"))
    good, _ = reports.with_report_parts(names.unionByName(bad))
    return good.select("file", "numero", "categoria", "mes", "anio", "periodo")


@query("F20_period_from_name", FACT + """
SELECT DISTINCT anio, mes, make_date(2000 + anio % 100, mes, 1) AS abreviado, make_date(anio + 20, mes, 1) AS completo, make_date(anio + 30, mes, 1) AS numerico, CAST(NULL AS DATE) AS nada FROM fact WHERE periodo_tipo = 'mensual'
""")
def _(spark, d):
    rows = long_fact(spark, d).select("anio", "mes").distinct()
    m, a = F.col("mes"), F.col("anio")
    yy = F.lpad((a % 100).cast("string"), 2, "0")
    return rows.select(
        "anio", "mes",
        times.period_from_name(F.concat(F.lit("08_otros_"), times.month_abbr(m), yy, F.lit(".xlsx"))).alias("abreviado"),
        times.period_from_name(F.concat(F.lit("datos-"), times.month_name(m), F.lit("_"), (a + 20).cast("string"))).alias("completo"),
        times.period_from_name(F.concat(F.lit("serie_"), (a + 30).cast("string"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"))).alias("numerico"),
        times.period_from_name(F.lit("sin fecha.xlsx")).alias("nada"))


@query("F27_report_indicators", """
SELECT o_orderkey, 'viajeros_hoteles' AS indicator, CAST(o_totalprice AS DOUBLE) AS value FROM orders UNION ALL SELECT o_orderkey, 'llegadas_aeropuertos', NULL FROM orders
UNION ALL SELECT o_orderkey, 'gasto_medio_diario', CAST(o_custkey AS DOUBLE) FROM orders UNION ALL SELECT o_orderkey, 'pernoctaciones_hoteles', CAST(o_orderkey AS DOUBLE) FROM orders
UNION ALL SELECT o_orderkey, 'turistas_millones', CAST(o_custkey AS DOUBLE) FROM orders UNION ALL SELECT o_orderkey, 'estancia_media_dias', NULL FROM orders
""")
def _(spark, d):
    body = F.concat(F.lit("Ficha. Número de  viajeros en establecimientos hoteleros : "), _eu(F.col("o_totalprice")),
                    F.lit("\nLLEGADAS de pasajeros a aeropuertos andaluces: N/A\nGasto medio diario (euros): "), F.col("o_custkey").cast("string"),
                    F.lit(" fin\nNúmero de pernoctaciones en establecimientos hoteleros: "), F.col("o_orderkey").cast("string"),
                    F.lit("\nNúmero de turistas (millones) : "), F.col("o_custkey").cast("string"))
    rows = table(spark, d, "orders").select("o_orderkey", F.explode(numbers.report_indicators(body)).alias("x"))
    return rows.select("o_orderkey", "x.indicator", "x.value")


@query("S05_choose_sheet", FACT + f"""
SELECT {_FILE_SQL} AS file, CASE WHEN categoria = 'BUILDING' THEN 'HojaFinal' ELSE 'Ficha' END AS sheet, count(*) AS n FROM (
 SELECT DISTINCT categoria, anio, mes, provincia FROM fact WHERE periodo_tipo = 'mensual') GROUP BY ALL
""")
def _(spark, d):
    cells = _cells(_pivoted(spark, d), [(0, 0, None)], "linea", [(1, F.col("provincia"))], "HojaFinal")
    ficha = cells.filter(~F.contains("file", F.lit("cruceros"))).withColumn("sheet", F.lit("Ficha"))
    other = cells.withColumn("sheet", F.lit("Notas"))
    root = work_dir(spark, "grid")
    cells.unionByName(ficha).unionByName(other).write.parquet(root)
    grid = reports.scan_cell_grid(spark, root)
    return reports.choose_sheet(grid).groupBy("file", "sheet").agg(F.count("*").alias("n"))


@query("S06_stage_sheets", FACT + f"""
SELECT {_FILE_SQL} AS fname, {_CAT_SQL} AS token, 'ficha' AS sheet_name, count(*) AS n_rows, '["Indicador","Valor"]' AS header_json,
 '[' || string_agg('["' || provincia || '","' || n || '"]', ',' ORDER BY linea) || ']' AS data_json
FROM (SELECT categoria, anio, mes, provincia, CAST(regexp_extract(provincia, '(\\d+)$', 1) AS INT) AS linea, CAST(metrica_valor AS VARCHAR) AS n FROM fact WHERE periodo_tipo = 'mensual' AND metrica_nombre = 'pedidos') GROUP BY ALL
""")
def _(spark, d):
    rows = _pivoted(spark, d).withColumn("fila", F.col("linea") + 1)
    grid = _cells(rows, [(0, 0, "Indicador"), (0, 1, "Valor")], "fila", [(0, F.col("provincia")), (1, F.col("pedidos").cast("string"))])
    staged = reports.stage_sheets(grid).withColumn("orden", F.lit(1))
    # the second load of the same sheets changes nothing
    merged = upserts.upsert(staged.drop("orden"), staged, ["fname", "sheet_name"], "orden").drop("accion")
    return merged.select("fname", "token", "sheet_name", "n_rows", "header_json", "data_json")


# ---------------------------------------------------------------- sources and sinks

@query("S01_scan_json_tree", "SELECT doc_id, md5(text) AS h, source FROM documents")
def _(spark, d):
    root = work_dir(spark, "tree")
    docs(spark, d).filter("lang = 'en'").write.json(f"{root}/en")
    corpus.write_json_gz(docs(spark, d).filter("lang <> 'en'"), f"{root}/otros/gz")
    rows = corpus.scan_json_tree(spark, root, "doc_id BIGINT, text STRING, source STRING", multi_line=False)
    return rows.select("doc_id", F.md5("text").alias("h"), "source")


@query("S02_quarantine_corrupt", """
SELECT CASE WHEN doc_id % 10 <> 3 THEN doc_id END AS doc_id, CASE WHEN doc_id % 10 <> 3 THEN text END AS text,
  CASE WHEN doc_id % 10 = 3 THEN '{"doc_id": ' || doc_id || ', "text": "sin cerrar' END AS crudo
FROM documents
""")
def _(spark, d):
    """Readable rows with their fields, unreadable ones as they were found."""
    root = work_dir(spark, "mixed")
    good = F.to_json(F.struct("doc_id", "text"))
    broken = F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "text": "sin cerrar'))
    docs(spark, d).select(F.when(F.col("doc_id") % 10 == 3, broken).otherwise(good).alias("value")).write.text(root)
    ok, bad = corpus.quarantine_corrupt(_scan_text(spark, root))
    return ok.select("doc_id", "text").unionByName(bad.select(F.col(corpus.CORRUPT).alias("crudo")), allowMissingColumns=True)


def _scan_text(spark, root):
    """Text part files carry no .json suffix, so they are read with the suffix filter open."""
    rows = spark.read.schema(f"doc_id BIGINT, text STRING, {corpus.CORRUPT} STRING").option("columnNameOfCorruptRecord", corpus.CORRUPT).option("recursiveFileLookup", True).json(root)
    return corpus.with_file_meta(rows)


@query("S03_file_meta", "SELECT doc_id, true AS con_fecha, doc_id % 2 = 1 AS de_fichero FROM documents")
def _(spark, d):
    root = work_dir(spark, "meta")
    docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit("2024-03-01")).alias("fecha")).write.json(root)
    rows = corpus.scan_json_tree(spark, root, "doc_id BIGINT, fecha STRING", multi_line=False)
    published = corpus.publication_time(F.col("fecha"), F.col("mtime"))
    return rows.select("doc_id", published.isNotNull().alias("con_fecha"), (published == F.col("mtime")).alias("de_fichero"))


@query("S07_table_round_trip", "SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderstatus FROM orders")
def _(spark, d):
    root = work_dir(spark, "store")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    tables.write_table(rows, "orders", root, partition_by=["o_orderstatus"])
    return tables.read_table(spark, "orders", root)


@query("S08_write_json_gz", "SELECT lang, count(*) AS n, sum(length(text)) AS letras FROM documents GROUP BY ALL")
def _(spark, d):
    root = work_dir(spark, "gz")
    corpus.write_json_gz(docs(spark, d), root)
    rows = corpus.scan_json_tree(spark, root, "doc_id BIGINT, text STRING, lang STRING", multi_line=False)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("letras"))


@query("S09_write_csv_report", "SELECT 'd' || doc_id AS filepath, lang <> 'fr' AS ok, n_chars AS tokens_used FROM documents")
def _(spark, d):
    root = work_dir(spark, "csv")
    rows = docs(spark, d).select(F.concat(F.lit("d"), "doc_id").alias("filepath"), (F.col("lang") != "fr").alias("ok"), F.lit("").alias("error"), F.col("n_chars").alias("tokens_used"))
    tables.write_csv_report(rows, root)
    return spark.read.schema("filepath STRING, ok BOOLEAN, error STRING, tokens_used BIGINT").option("header", True).csv(root).drop("error")


@query("S10_append_history", "SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, text FROM conversations WHERE role <> 'user'")
def _(spark, d):
    root = work_dir(spark, "history")
    rows = table(spark, d, "conversations")
    for part in (rows.filter("role = 'user'"), rows.filter("role <> 'user'")):
        tables.append_history(part.select("conv_id", "turn", F.col("text").alias("question")), root)
    return spark.read.parquet(root)


@query("S11_write_vectors", "SELECT vec_id AS document_id, len(embedding) AS dim FROM embeddings")
def _(spark, d):
    root = work_dir(spark, "vectors")
    rows = table(spark, d, "embeddings").select(
        F.concat("vec_id", F.lit("_0")).alias("id"), F.col("embedding").alias("vector"), F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"))
    tables.write_vectors(rows, root)
    return spark.read.parquet(root).select("document_id", F.size("vector").alias("dim"))


@query("S12_describe_tables", """
SELECT table_name AS tabla, column_name AS col_name, true AS "isTemporary",
 CASE WHEN data_type = 'BIGINT' THEN 'bigint' WHEN data_type = 'INTEGER' THEN 'int' WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type = 'DOUBLE' THEN 'double'
  WHEN data_type = 'DATE' THEN 'date' WHEN data_type LIKE 'TIMESTAMP WITH%' THEN 'timestamp' WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz' ELSE data_type END AS data_type
FROM information_schema.columns WHERE table_name IN ('documents', 'pages', 'events', 'orders')
""")
def _(spark, d):
    out = None
    for name in ("documents", "pages", "events", "orders"):
        table(spark, d, name).createOrReplaceTempView(f"v_{name}")
        part = tables.describe_table(spark, f"v_{name}").withColumn("tabla", F.lit(name))
        out = part if out is None else out.unionByName(part)
    listed = tables.catalog_tables(spark).filter(F.col("tableName").startswith("v_"))
    return out.join(listed.select(F.substring("tableName", 3, 100).alias("tabla"), "isTemporary"), "tabla")


@query("S13_snapshot_and_clear", """
SELECT t AS tabla, e AS estado, CASE WHEN e = 'despues' THEN 0 WHEN t = 'orders' THEN (SELECT count(*) FROM orders) ELSE (SELECT count(*) FROM documents) END AS n
FROM (VALUES ('orders'), ('documents')) a(t), (VALUES ('antes'), ('copia'), ('despues')) b(e)
""")
def _(spark, d):
    root = work_dir(spark, "clear")
    return tables.snapshot_and_clear({t: table(spark, d, t) for t in ("orders", "documents")}, f"{root}/copy", f"{root}/live", 2)


# ---------------------------------------------------------------- dimensions and table functions

@query("M06_build_dims", f"""
WITH p AS (SELECT *, row_number() OVER (ORDER BY c) AS i FROM (VALUES {", ".join(str(v) for v in fv.PROVINCE_CODES.values())}) x(c, n)),
 m AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}', '{t}')" for i, (c, _, t) in enumerate(fv.MARKETS, 1))}) x(i, c, t))
SELECT p.c AS codigo_provincia, p.n AS nombre_provincia, m.c AS codigo_mercado, m.t AS tipo_mercado, count(*) AS n FROM orders
JOIN p ON p.i = o_custkey % 8 + 1 JOIN m ON m.i = o_orderkey % 7 + 1 GROUP BY ALL
""")
def _(spark, d):
    """Scope of the orders by the dimension tables: nations stand in for provinces by position."""
    dims = reference_data.build_dims(spark)
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 8 + 1).alias("id_provincia"), (F.col("o_orderkey") % 7 + 1).alias("id_mercado"))
    return (
        rows.groupBy("id_provincia", "id_mercado").agg(F.count("*").alias("n"))
        .join(dims["provincias"], "id_provincia").join(dims["mercados"], "id_mercado")
        .select("codigo_provincia", "nombre_provincia", "codigo_mercado", "tipo_mercado", "n")
    )


_BUSCAR = "WITH q AS (SELECT lower(n_name) AS termino FROM nation UNION ALL SELECT 'N7') "


@query("X01_find_member", _BUSCAR + """
SELECT termino, n_nationkey AS id, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS codigo, n_name AS nombre FROM q JOIN nation ON lower(n_name) = termino OR lower('n' || n_nationkey) = lower(termino)
""")
def _(spark, d):
    from marisma.plans.functions import register_member_lookup

    nation = table(spark, d, "nation")
    provinces(spark, d).select(F.col("id_provincia").alias("_x"), "codigo_provincia", "nombre_provincia", (F.col("id_provincia") - 1).alias("id")).createOrReplaceTempView("dim_pais")
    nation.select(F.col("n_nationkey").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("alias")).createOrReplaceTempView("alias_pais")
    register_member_lookup(spark, "buscar_pais", "dim_pais", "alias_pais", "id", "codigo_provincia", "nombre_provincia")
    asked = nation.select(F.lower("n_name").alias("termino")).unionByName(nation.filter("n_nationkey = 7").select(F.lit("N7").alias("termino")))
    asked.createOrReplaceTempView("preguntas")
    return spark.sql("SELECT termino, b.id, b.codigo, b.nombre FROM preguntas, LATERAL buscar_pais(termino) b")


@query("X02_find_indicator", """
SELECT p_partkey AS id, p_brand AS codigo, p_name AS nombre FROM part WHERE lower(p_name) LIKE '%bolt%' OR lower(p_brand) = 'bolt'
""")
def _(spark, d):
    from marisma.plans.functions import register_contains_lookup

    part = table(spark, d, "part")
    part.createOrReplaceTempView("dim_parte")
    part.select(F.col("p_partkey").alias("id"), F.lit("").alias("alias")).filter("false").createOrReplaceTempView("alias_parte")
    register_contains_lookup(spark, "buscar_parte", "dim_parte", "alias_parte", "p_partkey", "p_brand", "p_name", "id")
    return spark.sql("SELECT id, codigo, nombre FROM buscar_parte('BOLT')")


@query("X02_find_indicators", """
WITH q AS (SELECT DISTINCT string_split(p_name, ' ')[2] AS termino FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT 'Ref 7' UNION SELECT 'o' UNION SELECT 'nada')
SELECT DISTINCT termino, p_partkey AS id, p_brand AS codigo, p_name AS nombre FROM q JOIN part
ON contains(lower(p_name), lower(termino)) OR lower(p_brand) = lower(termino) OR 'ref ' || p_partkey = lower(termino)
""")
def _(spark, d):
    """A table of terms, asked by a lateral call."""
    from marisma.plans.functions import register_contains_lookup

    part = table(spark, d, "part")
    part.createOrReplaceTempView("dim_partes")
    part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("ref "), "p_partkey").alias("alias")).createOrReplaceTempView("alias_partes")
    register_contains_lookup(spark, "buscar_partes", "dim_partes", "alias_partes", "p_partkey", "p_brand", "p_name", "id")
    asked = part.select(F.get(F.split("p_name", " "), F.lit(1)).alias("termino")).unionByName(part.select(F.col("p_brand").alias("termino")))
    more = part.select(F.explode(F.array(*map(F.lit, ("Ref 7", "o", "nada")))).alias("termino"))
    asked.unionByName(more).distinct().createOrReplaceTempView("terminos_buscados")
    return spark.sql("SELECT termino, b.id, b.codigo, b.nombre FROM terminos_buscados, LATERAL buscar_partes(termino) b")


@query("X03_period_function", STAR + """
SELECT coalesce(nombre_provincia, 'Total Andalucía') AS provincia, coalesce(nombre_mercado, 'Todos los mercados') AS mercado,
  coalesce(nombre_tipo, 'Todos los tipos') AS tipo_turismo, nombre_indicador AS indicador, valor_absoluto AS valor, fecha_periodo AS fecha
FROM star JOIN indicadores USING (id_indicador) LEFT JOIN provincias USING (id_provincia) LEFT JOIN mercados USING (id_mercado) LEFT JOIN tipos USING (id_tipo_turismo) WHERE date_id = 199801
""")
def _(spark, d):
    from marisma.plans.functions import register_period_function

    for name, df in {"datos_turismo": star_fact(spark, d), "provincias": provinces(spark, d), "mercados": markets(spark, d),
                     "tipos_turismo": tourism_types(spark, d), "indicadores": indicators(spark, d)}.items():
        df.createOrReplaceTempView(name)
    register_period_function(spark, "obtener_datos_periodo")
    return spark.sql("SELECT provincia, mercado, tipo_turismo, indicador, valor, fecha FROM obtener_datos_periodo(199801)")
