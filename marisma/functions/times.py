"""Date, month and period columns.  The session zone is expected to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marisma.functions import fixed_values as fv


def _lookup(mapping: dict) -> Column:
    pairs = []
    for key, value in mapping.items():
        pairs += [F.lit(key), F.lit(value)]
    return F.create_map(*pairs)


def month_number(name: Column) -> Column:
    """Spanish month name or abbreviation to 1..12; null if unknown."""
    table = _lookup({**fv.MONTH_ABBR, **fv.MONTH_FULL})
    return F.try_element_at(table, F.lower(F.trim(name)))


def full_year(year: Column) -> Column:
    """Two digits mean the 2000s."""
    y = year.cast("int")
    return F.when(y < 100, y + 2000).otherwise(y)


def month_name(month: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in fv.MONTH_FULL]), month - 1)


def month_abbr(month: Column) -> Column:
    return F.get(F.array(*[F.lit(m) for m in fv.MONTH_ABBR]), month - 1)


def date_id(year: Column, month: Column) -> Column:
    return year * 100 + month


def first_of_month(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def quarter_of(month: Column) -> Column:
    return F.ceil(month / F.lit(3)).cast("int")


def semester_of(month: Column) -> Column:
    return F.when(month <= 6, F.lit(1)).otherwise(F.lit(2))


def in_month_group(month: Column, group: str) -> Column:
    """Quarter, semester or season membership."""
    return month.isin(fv.MONTH_GROUPS[group])


def to_utc(text: Column) -> Column:
    """ISO text with or without an offset, or one of four plain layouts; null if none fits."""
    t = F.trim(text)
    iso = F.contains(t, F.lit("T"))
    plain = F.coalesce(
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(t, F.lit("d/M/yyyy HH:mm:ss")),
        F.try_to_timestamp(t, F.lit("d/M/yyyy")),
    )
    return F.when(iso, t.try_cast("timestamp")).otherwise(plain)


def to_utc_rescued(text: Column) -> Column:
    """As to_utc, but also finds an ISO timestamp inside other text."""
    inner = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[+-]\d{2}:\d{2})?)", 1)
    return F.coalesce(to_utc(text), inner.try_cast("timestamp"))


def to_utc_search(text: Column) -> Column:
    """Layouts accepted on the search side: to_utc plus day-first dates with dashes."""
    return F.coalesce(
        to_utc_rescued(text),
        F.try_to_timestamp(F.trim(text), F.lit("d-M-yyyy")),
    )


def null_time(text: Column) -> Column:
    return F.when(~text.isin("", "0"), text)


def time_parts(ts: Column) -> Column:
    return F.struct(
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.dayofmonth(ts).alias("day"),
        F.weekofyear(ts).alias("iso_week"),
    )


def period_from_report_date(day: Column) -> Column:
    """First of the month a report speaks about: issued up to the 10th means the month before."""
    month = F.trunc(day, "month")
    return F.when(F.dayofmonth(day) <= 10, F.add_months(month, -1)).otherwise(month).cast("date")


def period_from_text(text: Column) -> Column:
    """Report period from the issue date printed in the text."""
    parts = [F.regexp_extract(text, fv.REPORT_DATE_PATTERN, i) for i in (3, 2, 1)]
    issued = F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd")
    return period_from_report_date(issued)


def period_from_name(name: Column, cell_text: Column | None = None) -> Column:
    """First of the month named in a file name, else in a cell text; null if neither has one."""
    low = F.lower(name)
    abbr = "|".join(fv.MONTH_ABBR)
    full = "|".join(fv.MONTH_FULL)

    def named(names: str, source: Column, sep: str = r"[_-]?") -> Column:
        pattern = rf"({names}){sep}(\d{{4}}|\d{{2}})"
        month = month_number(F.regexp_extract(source, pattern, 1))
        year = F.nullif(F.regexp_extract(source, pattern, 2), F.lit(""))
        return F.when(year.isNotNull(), first_of_month(full_year(year), month))

    numeric = r"(20\d{2})[_-]?(0[1-9]|1[0-2])"
    by_number = F.when(
        F.rlike(low, F.lit(numeric)),
        first_of_month(
            F.nullif(F.regexp_extract(low, numeric, 1), F.lit("")).cast("int"),
            F.nullif(F.regexp_extract(low, numeric, 2), F.lit("")).cast("int"),
        ),
    )
    candidates = [named(abbr, low), named(full, low), by_number]
    if cell_text is not None:
        cell = F.lower(cell_text)
        month = month_number(F.regexp_extract(cell, rf"({full})", 1))
        year = F.nullif(F.regexp_extract(cell, r"(20\d{2})", 1), F.lit("")).cast("int")
        candidates.append(F.when(month.isNotNull() & year.isNotNull(), first_of_month(year, month)))
    return F.coalesce(*candidates)


def period_type(text: Column) -> Column:
    """Full year, accumulated, or monthly, from the period text of a row."""
    low = F.lower(F.coalesce(text, F.lit("")))
    head = F.get(F.split(low, " - "), F.lit(0))
    a_range = F.contains(head, F.lit("-")) & F.rlike(head, F.lit("|".join(fv.MONTH_ABBR)))
    return (
        F.when(F.contains(low, F.lit("año completo")), F.lit("anual"))
        .when(F.contains(low, F.lit("acumulado")), F.lit("acumulado"))
        .when(a_range, F.lit("acumulado"))
        .otherwise(F.lit("mensual"))
    )


def is_strictly_monthly(text: Column, year: Column) -> Column:
    """One month and this year, no range and no accumulation."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        ~F.rlike(low, F.lit("enero-|año|acumulado"))
        & (F.size(F.split(low, "-")) == 2)
        & F.contains(low, year.cast("string"))
    )


def query_period_type(period: Column) -> Column:
    """Yearly questions are answered from accumulated rows."""
    return F.when(period == "anual", F.lit("acumulado")).otherwise(period)
