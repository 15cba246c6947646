"""All queries of the library over the standard tables, and their DuckDB SQL."""

from __future__ import annotations

from textloom.plans import comparisons, corpora, coverage, networks, searches, statistics

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _m in (corpora, coverage, searches, statistics, comparisons, networks):
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
FLAGSHIP = "count_query"
