"""Explicit schemas of the sources as DDL text.  Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marisma.functions import fixed_values as fv


def ddl(text: str) -> T.StructType:
    """Parsed schema; needs a running session."""
    return T.StructType.fromDDL(text)


RAW_ARTICLE = (
    "titulo STRING, subtitulo STRING, autor STRING, fecha STRING, fecha_formateada STRING,"
    "contenido ARRAY<STRING>, contenido_completo STRING, url_original STRING, fecha_extraccion STRING,"
    "es_noticia_valida BOOLEAN, diario_origen STRING, profundidad INT, fuente STRING, url STRING, depth STRING,"
    "title STRING, headline STRING, link STRING, body STRING, content STRING, descripcion STRING,"
    "published STRING, date STRING, published_date STRING"
)

NEWS_V2 = (
    "schema_version STRING, id STRING,"
    "source STRUCT<domain: STRING, section: STRING, paywall: BOOLEAN, region_hint: STRING,"
    "  media: STRUCT<name: STRING, home_url: STRING>>,"
    "time STRUCT<published_utc: TIMESTAMP, published_tz: STRING, updated_utc: TIMESTAMP, extracted_utc: TIMESTAMP,"
    "  year: INT, month: INT, day: INT, iso_week: INT>,"
    "text STRUCT<lang: STRING, word_count: INT, reading_time_min: INT, title_norm: STRING, body_plain: STRING, quotes: ARRAY<STRING>>,"
    "entities STRUCT<persons: ARRAY<STRING>, orgs: ARRAY<STRING>, locations: ARRAY<STRING>, parties_present: ARRAY<STRING>>,"
    "classify STRUCT<primary_topic: STRING, subtopics: ARRAY<STRING>, sentiment_label: STRING, sentiment_score: DOUBLE,"
    "  stance_by_party: MAP<STRING,DOUBLE>, argument_affinity_index: DOUBLE>,"
    "signals STRUCT<radar: MAP<STRING,MAP<STRING,ARRAY<DOUBLE>>>,"
    "  media_affinity: STRUCT<media_key: STRING, media_url: STRING, affinity_contrib: DOUBLE, reach_hint: DOUBLE, weight: DOUBLE>,"
    "  coverage_label: STRING>,"
    "links STRUCT<outbound: ARRAY<STRING>, media: ARRAY<STRING>, related_ids: ARRAY<STRING>>,"
    "geo STRUCT<country: STRING, adm1: STRING, city: STRING>,"
    "nlp STRUCT<model: STRING, summary_abstractive: STRING, bullets_extractive: ARRAY<STRING>, keywords: ARRAY<STRING>>,"
    "audit STRUCT<pipeline_version: STRING, created_at: TIMESTAMP, errors: ARRAY<STRING>, warnings: ARRAY<STRING>,"
    "  fixed: BOOLEAN, excluded_reason: STRING, id_confidence: STRING, axes_method: STRING>"
)

CELL_GRID = ("file STRING, sheet STRING, `row` INT, col INT, value STRING")

QA_HISTORY = (
    "question STRING, answer STRING, query_type STRING, aql_query STRING, sources ARRAY<STRING>, timestamp TIMESTAMP, system STRING"
)

RUN_REPORT = ("filepath STRING, ok BOOLEAN, error STRING, tokens_used BIGINT, latency_ms DOUBLE")


class _Defaults(dict):
    """Defaults of the article template; columns are built when first asked for."""

    def get(self, path, default=None):
        made = self.make(path)
        return default if made is None else made

    @staticmethod
    def make(path: str):
        empty = F.array().cast("array<string>")
        if path in ("entities.persons", "entities.orgs", "entities.locations", "entities.parties_present",
                    "classify.subtopics", "text.quotes", "links.outbound", "links.media", "links.related_ids",
                    "nlp.bullets_extractive", "nlp.keywords"):
            return empty
        if path == "classify.stance_by_party":
            return F.map_from_arrays(F.array(*[F.lit(p) for p in fv.PARTIES]), F.array(*[F.lit(0.0) for _ in fv.PARTIES]))
        if path == "signals.radar":
            blank = F.array(*[F.lit(None).cast("double") for _ in range(5)])
            parties = F.map_from_arrays(F.array(*[F.lit(p) for p in fv.RADAR_PARTIES]), F.array(*[blank for _ in fv.RADAR_PARTIES]))
            return F.map_from_arrays(F.array(*[F.lit(t) for t in fv.TOPIC_AXES]), F.array(*[parties for _ in fv.TOPIC_AXES]))
        plain = {
            "schema_version": fv.SCHEMA_VERSION, "id": "", "source.domain": "", "source.media.name": "",
            "source.media.home_url": "", "text.lang": "es", "text.word_count": 0, "text.reading_time_min": 0,
            "text.title_norm": "", "text.body_plain": "", "classify.primary_topic": "",
            "classify.sentiment_label": "neutral", "classify.sentiment_score": 0.0,
            "classify.argument_affinity_index": 0.0, "signals.media_affinity.media_key": "",
            "signals.media_affinity.media_url": "", "signals.media_affinity.affinity_contrib": 0.0,
            "signals.media_affinity.weight": 1.0, "signals.coverage_label": "neutral", "nlp.model": "",
            "nlp.summary_abstractive": "", "audit.pipeline_version": fv.PIPELINE_VERSION,
        }
        return F.lit(plain[path]) if path in plain else None


NEWS_DEFAULTS = _Defaults()
