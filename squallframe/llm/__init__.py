"""Operators of a training-data pipeline; nothing else in the library imports this package."""

from __future__ import annotations

from . import (chat_format_query, disclosure_query, filter_audit_query, imatch_query, language_id_query, mil_quality_query,
               ngram_join_query, packing_query, piece_scan_query, simplex_clusters_query, suffix_dedup_query, token_counts_query,
               topk_search_query)

MODULES = (chat_format_query, packing_query, suffix_dedup_query, language_id_query, imatch_query, ngram_join_query, mil_quality_query,
           topk_search_query, piece_scan_query, disclosure_query, filter_audit_query, simplex_clusters_query, token_counts_query)


def queries():
    return {m.NAME: m.query for m in MODULES}


def oracle_sql():
    return {m.NAME: m.SQL for m in MODULES if m.SQL is not None}
