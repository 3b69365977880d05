"""URL and identity columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marisma.functions import fixed_values as fv
from marisma.functions.text import slugify, strip

_NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"  # RFC 4122 name space for URLs
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def url_reason(url: Column) -> Column:
    """Why a URL is not usable; null if it is."""
    u = F.coalesce(url, F.lit(""))
    parts = F.split(F.regexp_replace(u, r"/+$", ""), "/")
    marked = F.contains(u, F.lit(".html")) | F.contains(u, F.lit(".php")) | F.contains(u, F.lit("-"))
    return (
        F.when(u == "", F.lit("empty_url"))
        .when(~F.rlike(u, F.lit(r"^https?://[A-Za-z0-9.\-]+(?::[0-9]+)?/.*$")), F.lit("invalid_format"))
        .when(F.rlike(u, F.lit(r"/\d{4}/?$")), F.lit("truncated_year"))
        .when(u.endswith("/") & ~marked & (F.size(parts) <= 4), F.lit("possible_index"))
    )


def validate_url(url: Column) -> Column:
    reason = url_reason(url)
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def is_truncated_url(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return (
        (u == "")
        | ~F.rlike(u, F.lit(r"^https?://"))
        | F.rlike(u, F.lit(r"/\d{4}/?$"))
        | (F.length(u) < 30)
    )


def extract_domain(url: Column) -> Column:
    """Network location, or the first path part of a bare address, without a leading www."""
    u = F.coalesce(url, F.lit(""))
    netloc = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    bare = F.regexp_extract(u, r"^([^/?#]*)", 1)
    return F.regexp_replace(F.when(netloc != "", netloc).otherwise(bare), r"^www\.", "")


def outlet_of(domain: Column, url: Column) -> Column:
    """(name, home_url) of the newspaper behind a domain."""
    def pair(name, home):
        return F.struct(name.alias("name"), home.alias("home_url"))

    bare = F.replace(F.replace(domain, F.lit(".es"), F.lit("")), F.lit(".com"), F.lit(""))
    name = F.concat(F.upper(F.substring(bare, 1, 1)), F.lower(F.substring(bare, 2, 10**6)))
    out = pair(name, F.concat(F.lit("https://"), domain, F.lit("/")))

    region = pair(*map(F.lit, fv.ABC_DEFAULT))
    for path, (label, home) in fv.ABC_REGIONS.items():
        region = F.when(F.contains(F.lower(url), F.lit(path)), pair(F.lit(label), F.lit(home))).otherwise(region)
    out = F.when(domain == fv.ABC_DOMAIN, region).otherwise(out)
    for known, (label, home) in fv.OUTLET_OVERRIDES.items():
        out = F.when(domain == known, pair(F.lit(label), F.lit(home))).otherwise(out)
    return out


def is_spanish_domain(domain: Column) -> Column:
    return F.coalesce(domain.endswith(".es") | domain.isin(fv.SPANISH_DOMAINS), F.lit(False))


def domain_country(domain: Column) -> Column:
    return F.when(is_spanish_domain(domain), F.lit("ES"))


def domain_time_zone(domain: Column) -> Column:
    return F.when(is_spanish_domain(domain), F.lit(fv.SPANISH_TIME_ZONE))


def offset_time_zone(offset: Column) -> Column:
    return F.when(offset.isin(fv.SPANISH_OFFSETS), F.lit(fv.SPANISH_TIME_ZONE))


def repair_url(url: Column, domain: Column, title: Column) -> Column:
    """Only for an address without a scheme: host plus the slug of the title."""
    slug = slugify(title)
    has_scheme = F.coalesce(F.rlike(url, F.lit(r"^https?://")), F.lit(False))
    usable = (F.coalesce(domain, F.lit("")) != "") & (F.coalesce(title, F.lit("")) != "") & (slug != "")
    return F.when(usable & ~has_scheme, F.concat(F.lit("https://"), domain, F.lit("/"), slug, F.lit(".html")))


def _without_dots(path: Column) -> Column:
    """Fold the '.' and '..' segments of a rooted path."""
    folded = F.aggregate(
        F.split(F.substring(path, 2, 10**6), "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    rooted = F.concat(F.lit("/"), F.array_join(folded, "/"))
    open_end = F.rlike(path, F.lit(r"/\.{1,2}$")) & (F.size(folded) > 0)
    return F.when(open_end, F.concat(rooted, F.lit("/"))).otherwise(rooted)


def absolute_url(base: Column, href: Column) -> Column:
    """Resolve a link against the page it stands on."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    host = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    root = F.concat(scheme, F.lit("://"), host)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    no_fragment = F.regexp_replace(base, r"#.*$", "")
    no_query = F.regexp_replace(base, r"[?#].*$", "")

    target = F.regexp_extract(href, r"^[^?#]*", 0)
    tail = F.substring(href, F.length(target) + 1, F.length(href))
    joined = F.when(target.startswith("/"), target).otherwise(F.concat(folder, target))
    dotted = F.rlike(joined, F.lit(r"(^|/)\.{1,2}(/|$)"))
    clean = F.when(dotted, _without_dots(joined)).otherwise(joined)
    return (
        F.when(F.rlike(href, F.lit(_SCHEME)), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href == "", no_fragment)
        .when(href.startswith("#"), F.concat(no_fragment, href))
        .when(href.startswith("?"), F.concat(no_query, href))
        .otherwise(F.concat(root, clean, tail))
    )


def safe_filename(name: Column) -> Column:
    """Percent-decode, then keep letters, digits, dot, dash and underscore."""
    decoded = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    safe = F.regexp_replace(F.replace(strip(decoded), F.lit(" "), F.lit("_")), r"[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("archivo.pdf"))


def is_official_source(url: Column) -> Column:
    netloc = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))
    hit = F.lit(False)
    for suffix in fv.OFFICIAL_SUFFIXES:
        hit = hit | netloc.endswith(suffix)
    return hit


# ---------------------------------------------------------------- identities

def stable_id(url: Column, title: Column, date: Column) -> Column:
    parts = [F.coalesce(c, F.lit("")) for c in (url, title, date)]
    return F.concat(F.lit("sha1:"), F.sha1(F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), parts[2])))


def content_md5(col: Column) -> Column:
    return F.md5(F.coalesce(col, F.lit("")))


def short_hash(col: Column) -> Column:
    return F.substring(F.md5(col), 1, 8)


def payload_key(payload: Column) -> Column:
    """Key of a request: sha256 of its canonical JSON."""
    return F.sha2(payload, 256)


def uuid5_url(col: Column) -> Column:
    """Name-based UUID (version 5) in the URL name space."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACE_URL)), F.encode(col, "utf-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )
