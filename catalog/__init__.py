from catalog import corpus, facts, reports, retrieval, scores, streams  # noqa: F401
from catalog.base import ORACLE, QUERIES  # noqa: F401
