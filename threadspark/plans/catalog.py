"""Imports every module that registers queries."""

from threadspark.plans import capture_queries, corpus_queries, document_queries, html_queries, ledger_queries, payload_queries, report_queries, result_queries, stream_queries, text_queries, thread_queries  # noqa: F401
from threadspark.plans.registry import all_queries, all_sql  # noqa: F401

FLAGSHIP = "analyze_replies"
