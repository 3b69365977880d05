"""Report sheets as cell grids to long facts and wide rows.

A grid is (file, sheet, row, col, value).  A sheet is one page of a monthly
report, so a window or an array per sheet is small; files spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marisma.functions import fixed_values as fv
from marisma.functions import text, times
from marisma.functions.numbers import parse_number, parse_value_and_change
from marisma.sources.reports import parse_bulletin_name, parse_report_name

SHEET = ["file", "sheet"]


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def sheet_rows(grid: DataFrame) -> DataFrame:
    """One row per sheet line with its cells as an array from column 0."""
    lines = grid.groupBy(*SHEET, "row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("_c"), F.max("col").alias("_last")
    )
    cells = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda i: F.try_element_at("_c", i))
    return lines.select(*SHEET, "row", cells.alias("celdas"))


def _province(category: Column) -> Column:
    return F.when(category.isin(list(fv.PROVINCE_CODES)), F.initcap(category))


def grid_to_metrics(grid: DataFrame, min_abs: float = 0.0, first_row: int = 0, last_row: int | None = None) -> DataFrame:
    """Sheet lines to long facts.

    A line with period headings sets the value columns of the lines below, a line
    without numbers sets their section.  A value that is missing or under min_abs
    is looked for up to three columns to the right, then to the left; min_abs 0
    accepts every number.  The change must be smaller than the value.  Lines above first_row are the
    report's head; last_row, if given, is where its notes begin.
    """
    # ---- lines and what they are
    rows = sheet_rows(grid).filter(F.col("row") >= first_row)
    rows = rows if last_row is None else rows.filter(F.col("row") <= last_row)
    rows = rows.withColumn("_n", F.transform("celdas", lambda v: parse_number(v, "grid")))
    # cells that are words, not numbers or blanks
    rows = rows.withColumn(
        "_words", F.transform("celdas", lambda v, i: F.when(F.get("_n", i).isNull() & ~text.is_blank(v), v))
    )
    heads = F.filter(
        F.transform(
            "celdas",
            lambda v, i: F.struct(F.try_element_at(_map(fv.PERIOD_HEADERS), F.upper(text.strip(v))).alias("periodo"), i.alias("idx")),
        ),
        lambda h: h["periodo"].isNotNull(),
    )
    label = text.strip(F.get("celdas", F.lit(1)))
    named = F.coalesce(label, F.lit("")) != ""
    numeric = F.exists(F.array(*[F.get("_n", F.lit(i)) for i in (2, 3, 4)]), lambda v: v.isNotNull())
    is_head = F.size(F.col("_h")) > 0
    is_section = ~is_head & named & ~numeric
    below = W.partitionBy(*SHEET).orderBy("row").rowsBetween(W.unboundedPreceding, W.currentRow)
    section_name = F.coalesce(F.try_element_at(_map(fv.SECTION_NAMES), F.upper(label)), label)
    rows = rows.withColumn("_h", heads).withColumns(
        {
            "_conf": F.last(F.when(is_head, F.col("_h")), ignorenulls=True).over(below),
            "_section": F.last(F.when(is_section, section_name), ignorenulls=True).over(below),
            "_label": label,
            "_metric": ~is_head & ~is_section & named,
        }
    ).filter("_metric")

    # ---- value column of each period
    def usable(v: Column) -> Column:
        return v.isNotNull() & (F.abs(v) >= min_abs)

    def number_at(i: Column) -> Column:
        return F.get("_n", i)

    def first_text_after(i: Column) -> Column:
        return F.get(F.array_compact(F.slice("_words", i + 2, F.size("_words"))), F.lit(0))

    found = F.get(F.filter(F.sequence(F.lit(2), F.greatest(F.size("_n"), F.lit(2))), lambda i: usable(number_at(i))), F.lit(0))
    guessed = F.when(
        found.isNotNull(),
        F.array(F.struct(times.period_type(first_text_after(found)).alias("periodo"), found.alias("idx"))),
    )
    rows = rows.withColumn("_p", F.explode(F.coalesce("_conf", guessed))).withColumns(
        {"_i": F.col("_p.idx"), "periodo_tipo": F.col("_p.periodo")}
    )
    i = F.col("_i")
    right = F.filter(F.sequence(i + 1, i + 3), lambda j: usable(number_at(j)))
    left = F.filter(F.sequence(F.greatest(i - 1, F.lit(1)), F.lit(1)), lambda j: (j > 1) & usable(number_at(j)))
    at = F.when(usable(number_at(i)), i).otherwise(F.coalesce(F.get(right, F.lit(0)), F.get(left, F.lit(0))))
    rows = rows.withColumn("_at", at).filter(F.col("_at").isNotNull()).withColumn("metrica_valor", number_at(F.col("_at")))

    # ---- change and description
    value, beside = F.abs("metrica_valor"), number_at(i + 1)
    smaller = F.filter(F.slice("_n", F.col("_at") + 2, F.size("_n")), lambda v: v.isNotNull() & (F.abs(v) < value))
    change = F.when(beside.isNull() | (F.abs(beside) >= value), F.coalesce(F.get(smaller, F.lit(0)), beside)).otherwise(beside)
    described = F.coalesce(text.truthy(F.get("celdas", i + 2)), first_text_after(F.col("_at")), F.lit(""))
    section = F.coalesce("_section", F.try_element_at(_map(fv.SECTION_NAMES), F.upper("_label")))
    name = F.when(section.isNotNull(), F.concat(section, F.lit(" - "), F.col("_label"))).otherwise(F.col("_label"))
    meta = parse_report_name(F.col("file"))
    return (
        rows.withColumn("_m", meta)
        .filter(F.col("_m").isNotNull())
        .select(
            F.col("_m.categoria").alias("categoria"), F.col("_m.mes").alias("mes"), F.col("_m.mes_str").alias("mes_str"),
            F.col("_m.anio").alias("anio"), "periodo_tipo", name.alias("metrica_nombre"), "metrica_valor",
            F.get("celdas", i).alias("metrica_valor_raw"), change.alias("variacion_interanual"),
            described.alias("periodo_descripcion"), _province(F.col("_m.categoria")).alias("provincia"),
            F.col("file").alias("fuente_archivo"), F.lit("excel").alias("fuente_tipo"),
            F.col("_m.es_limpio").alias("es_limpio"), F.col("row").alias("fila_excel"),
        )
    )


def table_to_metrics(tables: DataFrame, min_rows: int = 0) -> DataFrame:
    """Bulletin tables (file, sheet, row, col, value, categoria) to long facts.

    Data starts two lines below the first monthly heading; column 1 is monthly, 4
    accumulated, 6 the full year.
    """
    heads = tables.groupBy(*SHEET).agg(
        F.min(F.when(F.contains("value", F.lit("DATOS MENSUALES")), F.col("row"))).alias("_head"),
        F.count_distinct("row").alias("_rows"),
    )

    def cell(i: int) -> Column:
        return F.max(F.when(F.col("col") == i, F.col("value")))

    lines = tables.groupBy(*SHEET, "row", "categoria").agg(
        cell(0).alias("_name"), cell(1).alias("mensual"), cell(4).alias("acumulado"), cell(6).alias("anual")
    )
    rows = (
        lines.join(heads, SHEET)
        .filter((F.col("_rows") >= min_rows) & (F.col("row") >= F.col("_head") + 2) & ~text.is_blank(F.col("_name")))
        .unpivot([*SHEET, "row", "categoria", "_name"], ["mensual", "acumulado", "anual"], "periodo_tipo", "_cell")
        .withColumns({"_v": parse_value_and_change(F.col("_cell")), "_m": parse_bulletin_name(F.col("file"))})
        .filter(F.col("_v.value").isNotNull() & F.col("_m").isNotNull())
    )
    return rows.select(
        "categoria", F.col("_m.mes").alias("mes"), F.col("_m.mes_str").alias("mes_str"), F.col("_m.anio").alias("anio"),
        "periodo_tipo", text.fix_encoding(text.strip(F.col("_name"))).alias("metrica_nombre"),
        F.col("_v.value").alias("metrica_valor"), F.col("_v.change").alias("variacion_interanual"),
        F.concat_ws(" - ", F.col("_m.mes_str"), F.col("_m.anio")).alias("periodo_descripcion"),
        _province(F.col("categoria")).alias("provincia"), F.col("file").alias("fuente_archivo"),
        F.lit("pdf").alias("fuente_tipo"), F.lit(False).alias("es_limpio"),
    )


def _columns(grid: DataFrame, wanted: list[int]) -> DataFrame:
    """One row per sheet line with the wanted columns side by side."""
    return grid.filter(F.col("col").isin(wanted)).groupBy(*SHEET, "row").agg(
        *[F.max(F.when(F.col("col") == i, F.col("value"))).alias(f"c{i}") for i in wanted]
    )


def _usable(value: Column) -> Column:
    return ~text.is_blank(value) & (text.strip(value) != "-")


def grid_to_wide(grid: DataFrame, indicators: list[tuple[str, str]] | None = None, label_col: int = 1,
                 value_col: int = 2) -> DataFrame:
    """One row per file with a column per indicator; a later line of the same indicator wins."""
    indicators = indicators or fv.SHEET_INDICATORS
    rows = _columns(grid, [label_col, value_col])
    label, value = F.col(f"c{label_col}"), F.col(f"c{value_col}")
    rows = rows.select(
        "file", "row", text.first_route(text.strip(label), indicators).alias("_field"),
        F.when(_usable(value), parse_number(value, "us")).alias("_value"),
    ).filter(F.col("_field").isNotNull() & F.col("_value").isNotNull())
    return rows.groupBy("file").agg(
        *[
            F.max_by("_value", F.when(F.col("_field") == field, F.col("row"))).alias(field)
            for _, field in indicators
        ]
    )


def grid_to_first_monthly(grid: DataFrame, fields: dict[str, str], year: Column) -> DataFrame:
    """One row per file with the first strictly monthly line of each field.

    fields: column name -> word its label must hold next to 'hoteleros'
    """
    rows = _columns(grid, [1, 2, 4])
    rows = rows.withColumn("_monthly", times.is_strictly_monthly(F.col("c4"), year)).filter("_monthly")
    low = F.lower(F.coalesce("c1", F.lit("")))

    def hit(word: str) -> Column:
        return F.contains(low, F.lit(word)) & F.contains(low, F.lit("hoteleros"))

    # min_by skips rows whose order is null, so lines of other fields do not count
    return rows.groupBy("file").agg(
        *[
            F.min_by(parse_number(F.col("c2"), "digits"), F.when(hit(word), F.col("row"))).alias(name)
            for name, word in fields.items()
        ]
    )


def grid_to_countries(grid: DataFrame) -> DataFrame:
    """Country lines under two section headings to one wide row per file and country."""
    joined = sheet_rows(grid).withColumn("_text", F.concat_ws(" ", "celdas"))
    section = text.first_route(F.col("_text"), fv.COUNTRY_SECTIONS)
    above = W.partitionBy(*SHEET).orderBy("row").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = joined.withColumn("_section", F.last(section, ignorenulls=True).over(above))
    country, value = F.get("celdas", F.lit(1)), F.get("celdas", F.lit(3))
    rows = rows.select(
        "file", "row", "_section", country.alias("nombre_pais"),
        F.try_element_at(_map(fv.COUNTRY_ISO), country).alias("codigo_pais"),
        F.when(_usable(value), parse_number(value, "digits").cast("long")).alias("_value"),
    ).filter("_section IS NOT NULL AND codigo_pais IS NOT NULL AND _value IS NOT NULL")
    return rows.groupBy("file", "codigo_pais", "nombre_pais").agg(
        *[
            F.max_by("_value", F.when(F.col("_section") == field, F.col("row"))).alias(field)
            for _, field in fv.COUNTRY_SECTIONS
        ]
    )
