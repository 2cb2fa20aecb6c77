"""All queries of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from lodestone.plans import catalog_queries, index_queries, more_queries, report_queries, stream_queries

FLAGSHIP = "vec_topk_collapsed"


def queries() -> dict:
    return {f.__name__: f for f in (*catalog_queries.QUERIES, *more_queries.QUERIES, *index_queries.QUERIES, *report_queries.QUERIES, *stream_queries.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return catalog_queries.SQL | more_queries.SQL | index_queries.SQL | report_queries.SQL | stream_queries.SQL
