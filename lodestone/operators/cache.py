"""URL and content caches: what is known already, what is new, what is the same content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unseen(new: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return new.join(cache.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def insert_new(cache: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The cache with the new rows whose key it lacks, the first of each key in the batch."""
    fresh = unseen(new, cache, key)
    first = fresh.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
    return cache.unionByName(first, allowMissingColumns=True)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def first_of_content(df: DataFrame, content: str, order: str) -> DataFrame:
    """df with content_hash, first (the smallest order of the same content) and duplicate.

    The first of each hash is aggregated before it is joined, so copies of one content don't gather in a task.
    """
    hashed = df.withColumn("content_hash", content_hash(F.col(content)))
    first = hashed.groupBy("content_hash").agg(F.min(order).alias("first"))
    return hashed.join(first, "content_hash").withColumn("duplicate", F.col(order) != F.col("first"))


def cache_stats(downloads: DataFrame, products: DataFrame | None = None, types: tuple[str, ...] = ("image", "pdf")) -> DataFrame:
    """One row: files in all and by type, bytes, and cached product pages."""
    stats = downloads.agg(F.count("*").alias("total_files"), *[F.count_if(F.col("file_type") == t).alias(f"{t}_files") for t in types], F.coalesce(F.sum("file_size_bytes"), F.lit(0)).cast("long").alias("total_bytes"))
    return stats if products is None else stats.crossJoin(products.agg(F.count("*").alias("cached_products")))  # one row each


def cached_or_extracted(pages: DataFrame, cache: DataFrame, extract) -> DataFrame:
    """Details of all pages: from the cache where it has the url, else from extract(pages it lacks)."""
    fresh = extract(pages.join(cache.select("url"), "url", "left_anti"))
    known = cache.join(pages.select("url").distinct(), "url", "left_semi")
    return known.unionByName(fresh, allowMissingColumns=True)
