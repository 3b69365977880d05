"""Number columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marisma.functions import fixed_values as fv
from marisma.functions.text import strip

_PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _to_double(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(_PLAIN_NUMBER)), text.try_cast("double"))


def _drop(col: Column, *chars: str) -> Column:
    for c in chars:
        col = F.replace(col, F.lit(c), F.lit(""))
    return col


def parse_number(text: Column, policy: str = "eu") -> Column:
    """Number text to double; blank, dash and N/A are null.

    eu      dots group thousands, comma is the decimal sign, a percent sign is dropped
    grid    eu only with one comma and several dots, else comma is the decimal sign
    us      commas group thousands
    digits  dots and commas both dropped
    """
    t = strip(text)
    if policy == "eu":
        t = strip(_drop(t, "%"))
        return _to_double(F.replace(_drop(t, "."), F.lit(","), F.lit(".")))
    if policy == "grid":
        t = _drop(t, " ", " ")
        commas = F.length(t) - F.length(_drop(t, ","))
        dots = F.length(t) - F.length(_drop(t, "."))
        point = F.replace(t, F.lit(","), F.lit("."))
        eu = F.replace(_drop(t, "."), F.lit(","), F.lit("."))
        return _to_double(F.when((commas == 1) & (dots > 1), eu).otherwise(point))
    if policy == "us":
        return _to_double(_drop(t, ","))
    if policy == "digits":
        return _to_double(strip(_drop(t, ",", ".")))
    raise ValueError(f"unknown number policy: {policy}")


def parse_value_and_change(text: Column) -> Column:
    """First number and first percentage in text such as '1.847.648 -0,3% abril - 2024'."""
    value = parse_number(F.regexp_extract(text, r"([\d.]+(?:,\d+)?)", 1), "eu")
    change = F.regexp_extract(text, r"([+-]?[\d,]+)%", 1)
    return F.struct(
        value.alias("value"),
        _to_double(F.replace(change, F.lit(","), F.lit("."))).alias("change"),
    )


def report_indicators(text: Column) -> Column:
    """Array of (indicator, value) for the labelled figures of a report text."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("indicator"),
                parse_number(F.regexp_extract(text, "(?iu)" + pattern, 1), "eu").alias("value"),
            )
            for name, pattern in fv.REPORT_TEXT_PATTERNS
        ]
    )


def clamp(col: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def reach_color(reach: Column) -> Column:
    """Linear ramp between two colors for reach 0..100, as (r, g, b)."""
    share = clamp(reach / F.lit(100.0))
    channels = zip("rgb", fv.REACH_COLOR_LOW, fv.REACH_COLOR_HIGH)
    return F.struct(*[(F.lit(a) + F.lit(b - a) * share).alias(n) for n, a, b in channels])


# ---------------------------------------------------------------- numbers in claims

_CLAIM_NUMBER = r"(?i)\d+[.,]?\d*(?:\s*(?:millones|millón|m|k))?"
_STRICT_NUMBER = r"(?iu)\b\d{1,3}(?:\.\d{3})+(?:,\d+)?(?:\s*(?:millones|millón|mil)\b)?|\b\d+(?:[.,]\d+)?(?:\s*(?:millones|millón|mil|m|k)\b)?"


def claim_numbers(text: Column, strict: bool = False) -> Column:
    """Every number of a claim with its multiplier applied.

    The default splits '1.847.648', reads '2 mil' as two million and counts years;
    strict keeps grouped thousands together, reads 'mil' as thousand and skips years.
    """
    raw = F.regexp_extract_all(
        F.coalesce(text, F.lit("")), F.lit(_STRICT_NUMBER if strict else _CLAIM_NUMBER), F.lit(0)
    )

    def value(token: Column) -> Column:
        low = F.lower(token)
        grouped = F.rlike(low, F.lit(r"^\d{1,3}(\.\d{3})+")) if strict else F.lit(False)
        low = F.when(grouped, F.replace(low, F.lit("."), F.lit(""))).otherwise(low)
        low = F.replace(low, F.lit(","), F.lit("."))
        thousand = F.rlike(low, F.lit(r"mil$")) if strict else F.lit(False)
        factor = (
            F.when(F.contains(low, F.lit("mill")), F.lit(1e6))
            .when(thousand, F.lit(1e3))
            .when(low.endswith("m"), F.lit(1e6))
            .when(low.endswith("k"), F.lit(1e3))
            .otherwise(F.lit(1.0))
        )
        digits = strip(F.regexp_replace(low, r"(millones|millón|mil|m|k)$", ""))
        return digits.try_cast("double") * factor

    kept = F.filter(F.transform(raw, value), lambda v: v.isNotNull())
    if strict:
        years = F.transform(claim_years(text), lambda y: y.cast("double"))
        kept = F.filter(kept, lambda v: ~F.array_contains(years, v))
    return kept


def primary_number(values: Column) -> Column:
    """The value of largest magnitude; the first one wins a tie."""
    best = F.aggregate(
        values,
        F.lit(None).cast("double"),
        lambda acc, v: F.when(acc.isNull() | (F.abs(v) > F.abs(acc)), v).otherwise(acc),
    )
    return best


def claim_years(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))


def claim_entities(text: Column) -> Column:
    """Distinct runs of two or more capitalised words."""
    upper, lower = "[A-ZÁÉÍÓÚÑ]", "[a-záéíóúñ]+"
    runs = F.regexp_extract_all(
        F.coalesce(text, F.lit("")), F.lit(rf"{upper}{lower}(?:\s+{upper}{lower})*"), F.lit(0)
    )
    return F.array_distinct(
        F.filter(
            runs,
            lambda r: F.rlike(r, F.lit(r"\s")) & ~F.lower(r).isin(fv.ENTITY_STOP_PHRASES),
        )
    )


def claim_type(numbers: Column, years: Column) -> Column:
    return (
        F.when(F.size(numbers) > 0, F.lit("numeric"))
        .when(F.size(years) > 0, F.lit("temporal"))
        .otherwise(F.lit("factual"))
    )


# ---------------------------------------------------------------- vectors

def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda v: v.cast("double") / size)).otherwise(
        F.transform(a, lambda v: v.cast("double"))
    )


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


# ---------------------------------------------------------------- labels

def coverage_label(score: Column) -> Column:
    return (
        F.when(score > fv.SENTIMENT_BAND, F.lit("positive"))
        .when(score < -fv.SENTIMENT_BAND, F.lit("negative"))
        .otherwise(F.lit("neutral"))
    )


def score_class(score: Column) -> Column:
    return (
        F.when(score > 0.2, F.lit("true")).when(score < -0.2, F.lit("fake")).otherwise(F.lit("insufficient"))
    )
