"""The public functions under their usual names: columns in, columns out, unless a DataFrame is named."""

from __future__ import annotations

from marisma.functions.fixed_values import TOPIC_AXES as AXES_BY_TOPIC
from marisma.functions.numbers import coverage_label, parse_number
from marisma.functions.text import count_words, normalize_title, slugify
from marisma.functions.text import paywall_blocks as detect_paywall_overlay
from marisma.functions.text import non_article_reason as is_non_article_content
from marisma.functions.text import reading_time as calculate_reading_time
from marisma.functions.text import strip_paywall as clean_paywall_content
from marisma.functions.times import null_time as normalize_time_field
from marisma.functions.times import time_parts as extract_time_components
from marisma.functions.times import to_utc as normalize_datetime_to_utc
from marisma.functions.urls import extract_domain, is_spanish_domain, is_truncated_url, repair_url, validate_url
from marisma.functions.urls import offset_time_zone as infer_timezone_from_offset
from marisma.functions.urls import outlet_of as get_media_info
from marisma.functions.urls import stable_id as create_stable_id
from marisma.operators.articles import enrich_static
from marisma.operators.articles import merge_template as deep_merge
from marisma.schemas import NEWS_V2 as NEWS_TEMPLATE


def has_axes(topic: str) -> bool:
    return topic in AXES_BY_TOPIC


def get_axes_for_topic(topic: str) -> list[str]:
    return AXES_BY_TOPIC.get(topic, [])


__all__ = [
    "AXES_BY_TOPIC", "NEWS_TEMPLATE", "calculate_reading_time", "clean_paywall_content", "count_words", "coverage_label",
    "create_stable_id", "deep_merge", "detect_paywall_overlay", "enrich_static", "extract_domain", "extract_time_components",
    "get_axes_for_topic", "get_media_info", "has_axes", "infer_timezone_from_offset", "is_non_article_content",
    "is_spanish_domain", "is_truncated_url", "normalize_datetime_to_utc", "normalize_time_field", "normalize_title",
    "parse_number", "repair_url", "slugify", "validate_url",
]
