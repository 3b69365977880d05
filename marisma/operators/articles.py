"""Article records: field selection, template defaults, recency policies and audit columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marisma.functions import fixed_values as fv
from marisma.functions import text, times, urls
from marisma.session import cut_lineage

# where each field may live in a raw record, best first; dots reach into structs
FIELD_SOURCES = {
    "url": ["url", "url_original", "link", "source.url"],
    "title": ["title", "headline", "titulo", "text.title"],
    "body": ["contenido_completo", "body", "content", "text", "descripcion", "text.body", "text.body_plain"],
    "date": ["published", "date", "fecha", "published_date", "time.published_utc"],
}


def _field(schema: T.StructType, path: str) -> T.DataType | None:
    here: T.DataType = schema
    for part in path.split("."):
        if not isinstance(here, T.StructType) or part not in here.fieldNames():
            return None
        here = here[part].dataType
    return here


def coalesce_fields(df: DataFrame, sources: dict[str, list[str]] | None = None) -> DataFrame:
    """First truthy spelling of each field; spellings the schema lacks, or that are structs, are skipped."""
    out = {}
    for name, paths in (sources or FIELD_SOURCES).items():
        usable = [p for p in paths if isinstance(_field(df.schema, p), T.StringType)]
        candidates = [text.truthy(F.col(p)) for p in usable]
        out[name] = F.coalesce(*candidates, F.lit(""))
    return df.withColumns({f"_{k}": v for k, v in out.items()}).drop(*out).withColumnsRenamed({f"_{k}": k for k in out})


def merge_template(df: DataFrame, template: T.StructType | str, defaults: dict[str, Column]) -> DataFrame:
    """Complete a record to the template at every depth.

    A missing or null leaf takes its default (keyed by dotted path, else null);
    what the record already has is kept.
    """
    template = T.StructType.fromDDL(template) if isinstance(template, str) else template

    def build(target: T.StructType, have: T.DataType | None, ref: Column | None, prefix: str) -> list[Column]:
        cols = []
        for f in target.fields:
            path = f"{prefix}{f.name}"
            present = isinstance(have, T.StructType) and f.name in have.fieldNames()
            value = (ref[f.name] if ref is not None else F.col(f.name)) if present else None
            if isinstance(f.dataType, T.StructType):
                inner = build(f.dataType, have[f.name].dataType if present else None, value, path + ".")
                cols.append(F.struct(*inner).alias(f.name))
                continue
            default = defaults.get(path, F.lit(None)).cast(f.dataType)
            cols.append((F.coalesce(value.cast(f.dataType), default) if present else default).alias(f.name))
        return cols

    extra = [F.col(c) for c in df.columns if c not in template.fieldNames()]
    return df.select(*build(template, df.schema, None, ""), *extra)


def to_search_record(df: DataFrame) -> DataFrame:
    """Raw Spanish article keys to the search record; rows without title and body are dropped."""
    body = F.coalesce(text.join_body(F.col("contenido")), F.lit(""))
    depth = F.when(F.rlike(F.col("depth").cast("string"), F.lit(r"^\d+$")), F.col("depth").try_cast("int"))
    fallback = F.col("path") if "path" in df.columns else F.lit("")
    out = df.select(
        urls.uuid5_url(F.trim(text.first_truthy(F.col("url"), fallback))).alias("id"),
        F.coalesce("titulo", F.lit("")).alias("title"),
        F.coalesce("subtitulo", F.lit("")).alias("subtitle"),
        F.coalesce("autor", F.lit("")).alias("author"),
        times.to_utc_search(F.col("fecha")).alias("publishedAt"),
        body.alias("body"),
        F.coalesce("fuente", F.lit("")).alias("source"),
        F.coalesce("url", F.lit("")).alias("sourceUrl"),
        depth.alias("depth"),
    )
    return out.filter((F.col("title") != "") | (F.col("body") != ""))


# ---------------------------------------------------------------- recency

def as_of_max(df: DataFrame, ts: str = "ts") -> Column:
    """Newest timestamp of the table as a literal: the reproducible stand-in for the wall clock.

    One number comes to the driver, so that later filters on it reach the scan.
    """
    return F.lit(df.agg(F.max(ts)).first()[0]).cast(df.schema[ts].dataType)


def keep_recent(df: DataFrame, ts: str, as_of: Column, days: int, keep_null: bool) -> DataFrame:
    recent = F.col(ts) >= as_of - F.make_interval(days=F.lit(days))
    return df.filter(F.coalesce(recent, F.lit(keep_null)))


def crawl_recent(df: DataFrame, ts: str, as_of: Column, days: int = fv.CRAWL_MAX_AGE_DAYS) -> DataFrame:
    """Crawl policy: an article without a date is kept."""
    return keep_recent(df, ts, as_of, days, keep_null=True)


def enrich_recent(df: DataFrame, ts: str, as_of: Column, days: int = fv.ENRICH_MAX_AGE_DAYS) -> DataFrame:
    """Enrichment policy: whole days of age up to the limit, or no date."""
    age = F.floor((F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col(ts).cast("timestamp"))) / 86400)
    return df.filter(F.coalesce(age <= days, F.lit(True)))


def search_recent(df: DataFrame, ts: str, as_of: Column, days: int = fv.SEARCH_RECENT_DAYS) -> DataFrame:
    """Search policy: recent dated rows, or every row if there is none."""
    recent = F.coalesce(F.col(ts) >= as_of - F.make_interval(days=F.lit(days)), F.lit(False))
    some = df.agg(F.coalesce(F.bool_or(recent), F.lit(False))).scalar()
    return df.filter(recent | ~some)


def smallest_window(df: DataFrame, ts: str, as_of: Column, windows: list[int] | None = None) -> DataFrame:
    """Rows of the first window that has any: day floor at the start, all rows as the last resort."""
    windows = windows or fv.SEARCH_WINDOWS_DAYS
    end = F.date_trunc("day", as_of) + F.make_interval(days=F.lit(1))
    tag = F.lit(len(windows))
    for rank in range(len(windows) - 1, -1, -1):
        start = F.date_trunc("day", as_of - F.make_interval(days=F.lit(windows[rank])))
        tag = F.when((F.col(ts) >= start) & (F.col(ts) < end), F.lit(rank)).otherwise(tag)
    best = df.agg(F.min(tag)).scalar()
    return df.filter(tag <= best)


def newest_first(df: DataFrame, ts: str, *tiebreak: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(ts), *tiebreak)


# ---------------------------------------------------------------- checks

def mark_valid(df: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """A usable article has a title and a body."""
    ok = (F.coalesce(F.col(title), F.lit("")) != "") & (F.coalesce(F.col(body), F.lit("")) != "")
    return df.withColumn("es_noticia_valida", ok)


def unprocessed(df: DataFrame, done: DataFrame | None = None, key: str = "id", radar: str | None = None) -> DataFrame:
    """Rows without scores of their own and without an output under the same key."""
    if radar:
        df = df.filter(F.col(radar).isNull())
    return df.join(done.select(key).distinct(), key, "left_anti") if done is not None else df


def enrich_static(df: DataFrame, processed_at: Column | None = None) -> DataFrame:
    """Everything about an article that needs no model call, as one narrow projection.

    Input: url, title, body, date (strings).  Output: the columns of the enriched
    record that are known without a model, with audit columns.
    """
    processed_at = F.lit(None).cast("timestamp") if processed_at is None else processed_at
    url, title, body, date = (F.coalesce(F.col(c), F.lit("")) for c in ("url", "title", "body", "date"))
    step = df.withColumns({"_url": url, "_title": title, "_body": body, "_date": date})
    step = step.withColumn("_blocks", text.paywall_blocks(F.col("_body")))
    step = step.withColumns(
        {
            "_clean": text.strip_paywall(F.col("_body"), F.col("_blocks")),
            "_domain": urls.extract_domain(F.col("_url")),
            "_url_reason": urls.url_reason(F.col("_url")),
            "_published": times.to_utc(F.col("_date")),
        }
    )
    step = step.withColumn("_words", text.count_words(F.col("_clean")))
    step = step.withColumn("_excluded", text.non_article_reason(F.col("_clean"), F.col("_url"), F.col("_words")))

    c = F.col
    url_ok, has_paywall = c("_url_reason").isNull(), F.size("_blocks") > 0
    repairable = c("_url_reason").isin("truncated_year", "invalid_format")
    repaired = F.when(repairable, urls.repair_url(c("_url"), c("_domain"), c("_title")))
    id_base = F.when(url_ok, c("_url")).when(c("_url") != "", c("_domain")).otherwise(F.lit("unknown"))
    outlet = urls.outlet_of(c("_domain"), c("_url"))
    parts = times.time_parts(c("_published"))
    errors = F.array_compact(
        F.array(
            F.when(~url_ok, F.concat(F.lit("url_invalid:"), c("_url_reason"))),
            F.when(c("_excluded").isNotNull(), F.concat(F.lit("non_article_index:"), c("_excluded"))),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(has_paywall, F.lit("paywall_overlay_stripped")),
            F.when(~url_ok, F.lit("id_uses_domain_fallback")),
            F.when(c("_published").isNull() & (c("_date") != ""), F.lit("no_publish_time")),
        )
    )
    hidden = ["_url", "_title", "_body", "_date", "_blocks", "_clean", "_domain", "_url_reason", "_published", "_words", "_excluded"]
    out = {
        "schema_version": F.lit(fv.SCHEMA_VERSION),
        "id": urls.stable_id(id_base, c("_title"), c("_date")),
        "url_original_repaired": repaired,
        "domain": c("_domain"),
        "media_name": outlet["name"],
        "media_home_url": outlet["home_url"],
        "paywall": F.when(has_paywall, F.lit(True)),
        "published_utc": c("_published"),
        "published_tz": urls.domain_time_zone(c("_domain")),
        "country": urls.domain_country(c("_domain")),
        "year": parts["year"],
        "month": parts["month"],
        "day": parts["day"],
        "iso_week": parts["iso_week"],
        "title_norm": text.normalize_title(c("_title")),
        "body_plain": text.strip(c("_clean")),
        "word_count": c("_words"),
        "reading_time_min": text.reading_time(c("_words")),
        "es_noticia_valida": c("_excluded").isNull(),
        "excluded_reason": c("_excluded"),
        "id_confidence": F.when(~url_ok, F.lit("low")),
        "errors": errors,
        "warnings": warnings,
        "fixed": ~url_ok | has_paywall,
        "pipeline_version": F.lit(fv.PIPELINE_VERSION),
        "created_at": processed_at,
    }
    return step.withColumns(out).drop(*hidden)


def apply_model_fields(df: DataFrame) -> DataFrame:
    """Rules on top of model replies: stance mask, neutral values for non-articles, label, affinity.

    Needs excluded_reason, parties_present, stance_by_party, sentiment_score,
    argument_affinity_index and radar.
    """
    from marisma.functions.numbers import coverage_label

    off = F.col("excluded_reason").isNotNull()
    present = F.coalesce("parties_present", F.array().cast("array<string>"))
    affinity = F.when(off, F.lit(0.0)).otherwise(F.coalesce("argument_affinity_index", F.lit(0.0)))
    return df.withColumns(
        {
            "stance_by_party": F.when(off, text.neutral_stance()).otherwise(
                text.mask_stance(F.col("stance_by_party"), present)
            ),
            "radar": F.transform_values("radar", lambda topic, parties: text.mask_radar(parties, present)),
            "affinity_contrib": affinity,
            "coverage_label": coverage_label(F.coalesce("sentiment_score", F.lit(0.0))),
            "axes_method": F.when(off, F.lit("skipped")).when(F.col("radar").isNull(), F.lit("failed")).otherwise(F.lit("llm")),
        }
    )


# ---------------------------------------------------------------- model plumbing

def prompt_batch(df: DataFrame, key: str, title: str, body: str, cache: DataFrame | None = None,
                 max_body: int | None = None) -> DataFrame:
    """Request rows, nine per article: classify, summarize, entities and one per topic.

    Bodies are whole unless max_body cuts them.  Each row has the sha256 key of its payload; rows whose key is cached are left out.
    """
    calls = [("classify", None, None), ("summarize", None, None), ("entities", None, None)]
    calls += [("radar", topic, axes) for topic, axes in fv.TOPIC_AXES.items()]
    call_array = F.array(
        *[
            F.struct(
                F.lit(kind).alias("call"),
                F.lit(topic).cast("string").alias("topic"),
                (F.array(*[F.lit(a) for a in axes]) if axes else F.lit(None)).cast("array<string>").alias("axes"),
            )
            for kind, topic, axes in calls
        ]
    )
    cut = df.select(
        key,
        F.col(title).alias("title"),
        (F.substring(F.col(body), 1, max_body) if max_body else F.col(body)).alias("body"),
    )
    rows = cut.withColumn("c", F.explode(call_array)).select(key, "c.call", "c.topic", "c.axes", "title", "body")
    payload = F.to_json(F.struct("axes", "body", "call", "title", "topic"))
    rows = rows.withColumn("payload_key", urls.payload_key(payload))
    if cache is None:
        return rows
    # keys alone are matched with the cache; the texts are attached to what is left
    names = [key, "call", "topic", "axes", "payload_key"]
    pending = rows.select(*names).join(cache.select("payload_key").distinct(), "payload_key", "left_anti")
    return pending.join(cut, key).select(key, "call", "topic", "axes", "title", "body", "payload_key")


def cached_replies(requests: DataFrame, cache: DataFrame, key: str = "payload_key") -> DataFrame:
    """Requests with the stored reply where there is one."""
    return requests.join(cache.select(key, "reply"), key, "left")


def reply_fields(df: DataFrame, reply: str, schema: str) -> DataFrame:
    """Parse model replies; a reply without usable JSON gives a null struct."""
    return df.withColumn("json_text", text.reply_json_text(F.col(reply))).withColumn(
        "parsed", F.from_json("json_text", schema)
    )


def flatten_candidates(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Every object nested in a JSON payload, with the usual spellings of its fields.

    Objects are found level by level until a level is empty; one without a title is no candidate.  A level is
    written once, with the fields of its objects, and parsed once, for its children.
    """
    def field(*names: str) -> Column:
        return F.coalesce(*[text.truthy(F.try_variant_get("child", f"$.{n}", "string")) for n in names], F.lit(""))

    def written(nodes: DataFrame) -> DataFrame:
        # a filter moves below a projection and would repeat what it computes, but not below an explode
        rows = nodes.select(*keys, "child", F.explode(F.array(F.to_json("child"))).alias("json")).filter(F.rlike("json", F.lit(r"^[\[{]")))
        return cut_lineage(rows.select(
            *keys, "json",
            text.strip(field("title", "headline", "titulo")).alias("title"),
            text.strip(field("source", "publisher", "mediaSource", "fuente")).alias("source"),
            text.strip(field("sourceUrl", "url", "link")).alias("url"),
            text.strip(field("published_at", "publishedAt", "date", "publishedDate", "published", "fecha")).alias("published"),
        ), "level")

    def parsed(rows: DataFrame, json: str, name: str) -> DataFrame:
        return rows.select(*keys, F.explode(F.array(F.try_parse_json(json))).alias(name))

    # a payload costs far more than its bytes tell: the rows are dealt evenly, and so are the files of the levels
    dealt = df.select(*keys, payload).filter(F.col(payload).isNotNull()).hint("rebalance")
    level, found = written(parsed(dealt, payload, "child")), None
    while found is None or not level.isEmpty():
        hits = level.filter(F.col("title") != "").drop("json")
        found = hits if found is None else found.unionByName(hits)
        children = parsed(level, "json", "node").lateralJoin(spark_variant_children("node"), how="inner")
        level = written(children.select(*keys, "child"))
    return found


def spark_variant_children(column: str) -> DataFrame:
    """Lateral table of the direct children of a variant column of the outer row."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    return spark.tvf.variant_explode(F.col(column).outer()).select(F.col("value").alias("child"))
