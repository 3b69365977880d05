"""Text columns: everything here is a native Column expression, safe inside codegen."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from marisma.functions import fixed_values as fv

WORD = r"[\p{L}\p{N}_]+"


def _accent_table() -> tuple[str, str]:
    """Letters with a one-letter base, by rule from Unicode, then the combining marks to drop."""
    src, dst = [], []
    for start, stop in ((0xC0, 0x250), (0x1E00, 0x1F00)):
        for code in range(start, stop):
            base = "".join(
                c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"
            )
            if len(base) == 1 and base != chr(code):
                src.append(chr(code))
                dst.append(base)
    marks = [chr(c) for c in range(0x300, 0x370) if unicodedata.category(chr(c)) == "Mn"]
    return "".join(src + marks), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


def strip(col: Column) -> Column:
    """Trim every kind of white space, not just blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def collapse(col: Column) -> Column:
    """Runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def truthy(col: Column) -> Column:
    """Empty string counts as missing; white space does not."""
    return F.nullif(col, F.lit(""))


def first_truthy(*cols: Column) -> Column:
    return F.coalesce(*[truthy(c) for c in cols])


def is_blank(col: Column) -> Column:
    return F.coalesce(strip(col), F.lit("")) == ""


def clean_text(col: Column) -> Column:
    return truthy(collapse(col))


def strip_accents(col: Column) -> Column:
    return F.translate(col, _ACCENTED, _PLAIN)


def normalize_title(col: Column) -> Column:
    plain = strip_accents(F.lower(F.coalesce(col, F.lit(""))))
    return collapse(F.regexp_replace(plain, r"[^a-z0-9\s]", " "))


def slugify(col: Column, max_length: int = 100) -> Column:
    slug = strip_accents(F.lower(F.coalesce(col, F.lit(""))))
    slug = F.regexp_replace(slug, r"[^a-z0-9\s-]", "")
    slug = F.regexp_replace(slug, r"\s+", "-")
    slug = F.regexp_replace(slug, r"-+", "-")
    slug = F.regexp_replace(slug, r"^-|-$", "")
    cut = F.regexp_replace(F.substring(slug, 1, max_length), r"-[^-]*$", "")
    return F.when(F.length(slug) > max_length, cut).otherwise(slug)


def words(col: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(WORD), F.lit(0))


def count_words(col: Column) -> Column:
    return F.size(words(col))


def tokens(col: Column) -> Column:
    """Split on white space, lower case, no empty tokens."""
    return F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), r"(?U)\s+"), lambda t: t != "")


def reading_time(word_count: Column) -> Column:
    return F.when(word_count == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.ceil(word_count / F.lit(200)).cast("int"))
    )


def fix_encoding(col: Column) -> Column:
    for broken, fixed in fv.GLYPH_FIXES:
        col = F.replace(col, F.lit(broken), F.lit(fixed))
    return col


def normalize_pdf_text(col: Column) -> Column:
    for broken, fixed in fv.PDF_GLYPH_FIXES:
        col = F.replace(col, F.lit(broken), F.lit(fixed))
    return F.regexp_replace(F.lower(strip_accents(col)), r"(?U)\s+", " ")


def join_body(paragraphs: Column) -> Column:
    return F.array_join(paragraphs, "\n\n")


def split_body(col: Column, min_chars: int = 40) -> Column:
    """Paragraphs: split on blank lines or a wide gap after a full stop, then clean, then drop stubs."""
    parts = F.split(F.coalesce(col, F.lit("")), r"\n{2,}|\r{2,}|(?<=\.)\s{2,}")
    return F.filter(F.transform(parts, collapse), lambda p: F.length(p) >= min_chars)


def truncate(col: Column, size: int, suffix: str = "") -> Column:
    return F.when(F.length(col) > size, F.concat(F.substring(col, 1, size), F.lit(suffix))).otherwise(col)


def contains_any(col: Column, needles: list[str]) -> Column:
    """Case-insensitive: does the text hold any of these literals."""
    low = F.lower(F.coalesce(col, F.lit("")))
    hit = F.lit(False)
    for needle in needles:
        hit = hit | F.contains(low, F.lit(needle))
    return hit


def contains_keyword(col: Column, pattern: str = r"incendio(s)?") -> Column:
    """Whole-word, case-insensitive, Unicode-aware search."""
    return F.coalesce(F.rlike(col, F.lit(rf"(?iU)\b{pattern}\b")), F.lit(False))


def found_literals(col: Column, needles: list[str]) -> Column:
    """The literals that occur in the text, in list order."""
    low = F.lower(F.coalesce(col, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(n)), F.lit(n)) for n in needles]))


def first_route(col: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """First rule whose substring occurs in the text decides."""
    out = F.lit(default).cast("string")
    for needle, label in reversed(rules):
        out = F.when(F.contains(col, F.lit(needle)), F.lit(label)).otherwise(out)
    return out


def newspaper_route(url: Column) -> Column:
    """Which newspaper a URL belongs to; null for others."""
    return first_route(F.lower(url), fv.NEWSPAPER_ROUTES)


def origin_name(url: Column) -> Column:
    return first_route(F.lower(url), fv.ORIGIN_ROUTES, fv.ORIGIN_DEFAULT)


def query_intent(col: Column) -> Column:
    out = F.lit(fv.DEFAULT_INTENT)
    for label, needles in reversed(fv.QUERY_INTENTS):
        out = F.when(contains_any(col, needles), F.lit(label)).otherwise(out)
    return out


def title_category(col: Column) -> Column:
    return first_route(F.upper(F.coalesce(col, F.lit(""))), fv.TITLE_CATEGORIES)


def page_category(text: Column) -> Column:
    """Category of the first of the top five lines that names one."""
    top = F.slice(F.split(fix_encoding(text), "\n"), 1, 5)
    hits = F.filter(F.transform(top, title_category), lambda c: c.isNotNull())
    return F.get(hits, F.lit(0))


# ---------------------------------------------------------------- article checks

def paywall_blocks(body: Column) -> Column:
    """Paragraphs that carry a subscription notice."""
    pattern = "(?iu)" + "|".join(fv.PAYWALL_PATTERNS)
    paragraphs = F.transform(F.split(F.coalesce(body, F.lit("")), "\n\n"), strip)
    return F.filter(paragraphs, lambda p: (p != "") & F.rlike(p, F.lit(pattern)))


def strip_paywall(body: Column, blocks: Column) -> Column:
    cleaned = F.aggregate(blocks, body, lambda text, block: F.replace(text, block, F.lit("")))
    cleaned = strip(F.regexp_replace(cleaned, r"\n{3,}", "\n\n"))
    return F.when(F.size(blocks) > 0, cleaned).otherwise(body)


def non_article_reason(body: Column, url: Column, word_count: Column) -> Column:
    """Why this is not an article; null if it is one."""
    url = F.coalesce(url, F.lit(""))
    lines = F.filter(
        F.transform(F.split(F.coalesce(body, F.lit("")), "\n"), strip), lambda x: x != ""
    )
    n_lines = F.size(lines)
    n_short = F.size(F.filter(lines, lambda x: F.length(x) < 50))
    starts = F.array_distinct(
        F.transform(F.filter(lines, lambda x: F.length(x) > 20), lambda x: F.substring(x, 1, 20))
    )
    reason = (
        F.when((n_lines > 20) & (n_short / n_lines > 0.7), F.lit("index_structure_bullets"))
        .when((n_lines > 10) & (F.size(starts) < n_lines * 0.3), F.lit("repetitive_content"))
    )
    for pattern in reversed(fv.INDEX_URL_PATTERNS):
        reason = F.when(F.rlike(url, F.lit("(?i)" + pattern)), F.lit(f"index_url_pattern:{pattern}")).otherwise(reason)
    return F.when(word_count < 120, F.lit("too_short")).otherwise(reason)


# ---------------------------------------------------------------- flags

def is_contradiction(col: Column) -> Column:
    return contains_any(col, fv.CONTRADICTION_PHRASES)


def is_no_result(col: Column) -> Column:
    return contains_any(col, fv.NO_RESULT_PHRASES)


def wants_latest(col: Column) -> Column:
    return contains_any(col, fv.RECENCY_WORDS)


def cited_source_words(col: Column) -> Column:
    return found_literals(col, fv.CITED_SOURCE_WORDS)


def domain_tags(text: Column, justification: Column, token_list: list[str] | None = None,
                prefixes: list[str] | None = None, tag: str = "turismo") -> Column:
    """Tag the row when a token of either text is in the list or starts with a prefix."""
    vocab = F.array(*[F.lit(t) for t in (token_list or fv.TOURISM_TOKENS)])
    both = F.array_union(tokens(text), tokens(justification))
    start = "^(" + "|".join(prefixes or fv.TOURISM_TOKEN_PREFIXES) + ")"
    by_prefix = F.exists(both, lambda t: F.rlike(t, F.lit(start)))
    return F.when(F.arrays_overlap(both, vocab) | by_prefix, F.array(F.lit(tag))).otherwise(
        F.array().cast("array<string>")
    )


# ---------------------------------------------------------------- reply text

def reply_json_text(reply: Column) -> Column:
    """The JSON object inside a model reply: after the reasoning, bare, fenced, or embedded."""
    tail = strip(F.element_at(F.split(reply, "</think>"), -1))
    fenced = F.regexp_extract(tail, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    embedded = F.regexp_extract(tail, r"(?s)\{.*\}", 0)
    return F.coalesce(
        F.when(F.try_parse_json(tail).isNotNull(), tail), truthy(fenced), truthy(embedded)
    )


def present_parties(raw_json: Column) -> Column:
    """A JSON list as it is, or the keys of a JSON object whose values are truthy."""
    as_list = F.from_json(raw_json, "array<string>")
    as_map = F.map_filter(
        F.from_json(raw_json, "map<string,string>"),
        lambda k, v: v.isNotNull() & ~v.isin("", "false", "0", "0.0", "[]", "{}", "null"),
    )
    is_list = F.ltrim(raw_json).startswith("[")
    return F.coalesce(F.when(is_list, as_list).otherwise(F.map_keys(as_map)), F.array().cast("array<string>"))


def mask_stance(stance: Column, present: Column) -> Column:
    """If any party is present, absent parties have stance zero."""
    masked = F.transform_values(
        stance, lambda k, v: F.when(F.array_contains(present, k), v).otherwise(F.lit(0.0))
    )
    return F.when(F.size(present) > 0, masked).otherwise(stance)


def neutral_stance() -> Column:
    return F.map_from_arrays(
        F.array(*[F.lit(p) for p in fv.PARTIES]), F.array(*[F.lit(0.0) for _ in fv.PARTIES])
    )


def mask_radar(radar: Column, present: Column, n_axes: int = 5) -> Column:
    """Absent parties get an array of nulls; the programme row is never masked."""
    blank = F.array(*[F.lit(None).cast("double") for _ in range(n_axes)])
    maskable = F.array(*[F.lit(p) for p in fv.RADAR_MASKED_PARTIES])
    return F.transform_values(
        radar,
        lambda k, v: F.when(F.array_contains(maskable, k) & ~F.array_contains(present, k), blank).otherwise(v),
    )
