"""Report files: names, cell grids, staging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marisma.functions import fixed_values as fv
from marisma.functions import times
from marisma.functions.text import strip
from marisma.schemas import CELL_GRID


def _part(name: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, group), F.lit(""))


def parse_report_name(name: Column) -> Column:
    """NN_token_mmmYY.xlsx, with or without _limpio, to its parts; null if the name does not fit."""
    base = F.replace(F.replace(name, F.lit(".xlsx"), F.lit("")), F.lit("_limpio"), F.lit(""))
    pattern = r"^(\d{2})_([a-z_]+)_([a-z]{3})(\d{2})$"
    number, token, month_text = (_part(base, pattern, i) for i in (1, 2, 3))
    month = times.month_number(month_text)
    categories = F.create_map(*[F.lit(x) for pair in fv.REPORT_CATEGORIES.items() for x in pair])
    year = _part(base, pattern, 4).cast("int") + 2000
    return F.when(
        month.isNotNull(),
        F.struct(
            number.alias("numero"),
            F.coalesce(F.try_element_at(categories, number), token).alias("categoria"),
            month.alias("mes"),
            month_text.alias("mes_str"),
            year.alias("anio"),
            F.contains(name, F.lit("_limpio")).alias("es_limpio"),
            times.first_of_month(year, month).alias("periodo"),
        ),
    )


def parse_ingest_name(name: Column) -> Column:
    """[NN_]token_mmmYY.xlsx in any case: prefix, token and period; null if it does not fit."""
    pattern = r"(?i)^(?:(\d{2})_)?([a-zA-Z0-9_]+)_([a-zA-Z]{3})(\d{2})\.xlsx$"
    month = times.month_number(_part(name, pattern, 3))
    year = _part(name, pattern, 4).cast("int") + 2000
    return F.when(
        month.isNotNull(),
        F.struct(
            _part(name, pattern, 1).alias("prefijo"), _part(name, pattern, 2).alias("token"),
            month.alias("mes"), year.alias("anio"), times.first_of_month(year, month).alias("periodo"),
        ),
    )


def parse_bulletin_name(name: Column) -> Column:
    """ultimos-datos_mmmYY.pdf, also with the suffix _2."""
    base = F.replace(F.replace(name, F.lit(".pdf"), F.lit("")), F.lit("_2"), F.lit(""))
    pattern = r"^ultimos-datos_([a-z]{3})(\d{2})$"
    month = times.month_number(_part(base, pattern, 1))
    year = _part(base, pattern, 2).cast("int") + 2000
    return F.when(
        month.isNotNull(),
        F.struct(month.alias("mes"), _part(base, pattern, 1).alias("mes_str"), year.alias("anio")),
    )


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def with_report_parts(df: DataFrame, name: str = "file") -> tuple[DataFrame, DataFrame]:
    """(rows of well-named files with their parts, rejected rows)."""
    parsed = df.withColumn("_p", parse_report_name(F.col(name)))
    good = parsed.filter(F.col("_p").isNotNull()).select(*df.columns, "_p.*")
    return good, parsed.filter(F.col("_p").isNull()).drop("_p")


def scan_cell_grid(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Sheets as cells (file, sheet, row, col, value)."""
    reader = spark.read.schema(CELL_GRID)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def choose_sheet(grid: DataFrame, wanted: tuple[str, ...] = ("ficha", "hojafinal")) -> DataFrame:
    """Cells of one sheet per file: the first of the wanted names it has."""
    rank = F.lit(None).cast("int")
    for i in range(len(wanted) - 1, -1, -1):
        rank = F.when(F.lower("sheet") == wanted[i], F.lit(i)).otherwise(rank)
    ranked = grid.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
    best = ranked.groupBy("file").agg(F.min_by("sheet", "_rank").alias("sheet"))
    return grid.join(best, ["file", "sheet"], "left_semi")


def stage_sheets(grid: DataFrame) -> DataFrame:
    """One row per (file, sheet): header and rows as JSON, number of rows, scope and period of the name.

    A sheet is a page of a report, so its rows fit one JSON value.
    """
    rows = grid.groupBy("file", "sheet", "row").agg(
        F.array_sort(F.collect_list(F.struct("col", "value"))).alias("cells")
    )
    lines = rows.select("file", "sheet", F.struct("row", F.transform("cells", lambda c: c["value"]).alias("v")).alias("line"))
    sheets = lines.groupBy("file", "sheet").agg(F.array_sort(F.collect_list("line")).alias("_l"))
    body = F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0)))
    name = parse_ingest_name(F.col("file"))
    return sheets.select(
        F.col("file").alias("fname"), name["token"].alias("token"), name["periodo"].alias("periodo"),
        F.col("sheet").alias("sheet_name"),
        F.to_json(F.get("_l", F.lit(0))["v"]).alias("header_json"),
        F.to_json(F.transform(body, lambda x: x["v"])).alias("data_json"),
        F.size(body).alias("n_rows"),
    )


