"""Spark jobs for a news corpus, tourism statistics and evidence scoring."""

__version__ = "0.1.0"
