"""All registered queries."""

from __future__ import annotations

from corpusweave.plans import builder_queries, corpus_queries, group_queries, metric_queries, style_queries, text_queries  # noqa: F401  they register themselves
from corpusweave.plans.registry import QUERIES, SQL
from corpusweave.plans.text_queries import doc_comma_summary_by_lang

__all__ = ["QUERIES", "SQL", "doc_comma_summary_by_lang"]
