"""Queries of tables at rest in an order: searches through trigrams, pages at any depth, vectors in cells, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.indexes import TableIndex
from lodestone.operators.pivots import PivotIndex
from lodestone.plans import stream_queries
from lodestone.sources.shared import scratch

PAGE = 50


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog_search_indexed(spark, sf_dir):
    """Two ways to match, each with trigrams that few rows have."""
    index = TableIndex.build(_t(spark, sf_dir, "part"), scratch(spark, "parts"), ["p_partkey"], ["p_name", "p_type"])
    return index.search("^small ri.g$|^OLD g[a-i]z+mo$").select("p_partkey", "p_name", "p_brand")


def pages_search_indexed(spark, sf_dir):
    """A literal term in URLs of pages."""
    index = TableIndex.build(_t(spark, sf_dir, "pages"), scratch(spark, "pages"), ["page_id"], ["url"])
    return index.search("/10", literal=True).select("page_id", "url")


def catalog_deep_page(spark, sf_dir):
    """The page in the middle of all line items."""
    index = TableIndex.build(_t(spark, sf_dir, "lineitem"), scratch(spark, "lines"), ["l_orderkey", "l_linenumber", "l_partkey"])
    return index.page(index.total() // PAGE // 2 + 1, PAGE).select("l_orderkey", "l_linenumber", "l_partkey")


def vec_topk_pivots(spark, sf_dir):
    """vec_topk_raw by way of cells and bounds."""
    rows = stream_queries._index(spark, sf_dir)
    index = PivotIndex.build(rows, scratch(spark, "cells"))
    return index.search(stream_queries._asked(rows), 5, collapse=False).withColumn("score", F.round("score", 6))


QUERIES = [catalog_search_indexed, pages_search_indexed, catalog_deep_page, vec_topk_pivots]

SQL = {
    "catalog_search_indexed": "SELECT p_partkey, p_name, p_brand FROM part WHERE regexp_matches(lower(p_name), '^small ri.g$|^old g[a-i]z+mo$') OR regexp_matches(lower(p_type), '^small ri.g$|^old g[a-i]z+mo$')",
    "pages_search_indexed": "SELECT page_id, url FROM pages WHERE contains(lower(url), '/10')",
    "vec_topk_pivots": stream_queries.SQL["vec_topk_raw"],
    "catalog_deep_page": f"""WITH n AS (SELECT count(*) // {PAGE} // 2 * {PAGE} AS skipped FROM lineitem)
      SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem, n QUALIFY row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) BETWEEN skipped + 1 AND skipped + {PAGE}""",
}
