"""Silkmoth: a Spark-first engine for crawling, indexing, ranking and cleaning a web corpus."""

__version__ = "0.1.0"
