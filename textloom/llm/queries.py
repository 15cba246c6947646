"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from textloom.llm import chat, decontaminate, exact_dedup, line_dedup, ngram_join, packing, pii, toxicity, url_filter, warc

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _m in (chat, decontaminate, warc, pii, exact_dedup, ngram_join, line_dedup, toxicity, url_filter, packing):
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
