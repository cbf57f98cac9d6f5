"""Imports every module that registers queries."""

from posada.plans import account_queries, dialogue_queries, evaluation_queries, header_queries, hotel_queries, ledger_queries, more_queries, queue_queries, rate_queries, report_queries, rule_queries, shape_queries, text_queries  # noqa: F401
