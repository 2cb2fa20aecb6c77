"""The product catalog: records, filters, pages, facets, counts. DataFrame in, DataFrame out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import specs, text


def last_by_id(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with a non-blank key, trimmed; of those that share it, the last by order."""
    keyed = df.withColumn(key, F.trim(F.col(key).cast("string"))).where(F.coalesce(F.col(key), F.lit("")) != "")
    return keyed.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def as_records(products: DataFrame) -> DataFrame:
    """The typed view: JSON text parsed with defaults, empty names filled from the next best."""
    model = F.coalesce(text.blank_to_null(F.col("model_name")), F.col("camera_id"))
    return products.withColumns({
        "model_name": model,
        "display_name": F.coalesce(text.blank_to_null(F.col("display_name")), model),
        "source": F.coalesce(text.blank_to_null(F.col("source")), F.lit("Unknown")),
        "category": F.coalesce(text.blank_to_null(F.col("category")), F.lit("Unknown")),
        "image_urls": text.json_strings(F.col("image_urls")),
        "image_files": text.json_strings(F.col("image_files")),
        "specifications": text.json_map(F.col("specifications")),
    })


def as_rows(records: DataFrame) -> DataFrame:
    """The table at rest again: lists and maps as JSON text."""
    return records.withColumns({c: F.to_json(c) for c in ("image_urls", "image_files", "specifications")})


def filter_equal(df: DataFrame, **wanted) -> DataFrame:
    """Equality on each column whose wanted value is given; an empty or missing one doesn't filter."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])) if kv[1] else d, wanted.items(), df)


def search(df: DataFrame, term: str | None, columns: list[str], literal: bool = False) -> DataFrame:
    """Rows with a column that, in lower case, matches the term (a regular expression, unless literal); null doesn't."""
    if not term:
        return df
    hit = [F.coalesce(F.lower(c).contains(term.lower()) if literal else F.lower(c).rlike(term.lower()), F.lit(False)) for c in columns]
    return df.where(reduce(Column.__or__, hit))


def page(df: DataFrame, number: int, limit: int, *order: str) -> DataFrame:
    """One page in a stable order; number from 1, limit from 1 to 100."""
    if number < 1 or not 1 <= limit <= 100:
        raise ValueError("page must be at least 1 and limit between 1 and 100")
    return df.orderBy(*order).offset((number - 1) * limit).limit(limit)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows of an order; without one, any n, for which Spark reads no more partitions than it needs."""
    return (df.orderBy(*order) if order else df).limit(n)


def page_info(total: int, number: int, limit: int) -> dict[str, int]:
    return {"page": number, "limit": limit, "total": total, "total_pages": -(-total // limit)}


def by_id(df: DataFrame, key: str, value, order: str) -> DataFrame:
    """The first row of an id, or none."""
    return df.where(F.col(key) == F.lit(value)).orderBy(order).limit(1)


def facets(df: DataFrame, *columns: str) -> DataFrame:
    """facet, value, n for every value of each column in one scan; nulls have no facet."""
    keyed = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    unpivoted = keyed.unpivot([], list(columns), "facet", "value")
    return unpivoted.where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Non-null values by falling count, then value; with top, only so many."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return counts.limit(top) if top else counts


def null_profile(df: DataFrame, *columns: str) -> DataFrame:
    """field, n_null, n_rows per column: one scan, one aggregate."""
    counts = df.agg(F.count("*").alias("__all"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot(["__all"], list(columns), "field", "n_null").select("field", "n_null", F.col("__all").alias("n_rows"))


def statistics(products: DataFrame, index: DataFrame | None = None, vendor: str = "source") -> DataFrame:
    """One row: total, vendors (distinct, but for null and empty ones), index_loaded, and its vectors."""
    counts = products.agg(F.count("*").alias("total"), F.count_distinct(F.nullif(F.col(vendor), F.lit(""))).alias("vendors"))
    if index is None:
        return counts.withColumns({"index_loaded": F.lit(False), "vectors": F.lit(0).cast("long")})
    return counts.crossJoin(index.agg(F.lit(True).alias("index_loaded"), F.count("*").alias("vectors")))  # one row each


def json_list_stats(df: DataFrame, column: str) -> DataFrame:
    """total and mean (one decimal, over all rows) of JSON list lengths; broken text counts 0."""
    n = F.coalesce(F.json_array_length(column), F.lit(0))
    return df.agg(F.sum(n).cast("long").alias("total"), F.round(F.try_divide(F.sum(n), F.count("*")), 1).alias("mean"))


def largest_count(df: DataFrame, column: str) -> DataFrame:
    """The largest number among displayed counts such as '1,234 products'."""
    digits = F.nullif(F.regexp_replace(column, r"[^\d]", ""), F.lit(""))
    return df.agg(F.max(digits.cast("long")).alias("largest"))


def list_view(products: DataFrame) -> DataFrame:
    """What a list shows of each product."""
    files = text.json_strings(F.col("image_files"))
    return products.select(
        "camera_id", "model_name", "display_name", "source", "product_category", "product_series",
        F.when(F.size(files) > 0, text.thumbnail_url(F.get(files, 0))).alias("thumbnail_url"), specs.summary(F.col("specifications")).alias("specs"),
    )


def detail_view(products: DataFrame) -> DataFrame:
    """All fields of a product: absolute image URLs only, files as routes."""
    return products.withColumns({
        "image_urls": F.filter(text.json_strings(F.col("image_urls")), lambda u: u.startswith("http")),
        "image_files": F.transform(text.json_strings(F.col("image_files")), text.thumbnail_url),
        "specifications": text.json_map(F.col("specifications")),
    })


def first_images(records: DataFrame, n: int = 1, existing: DataFrame | None = None) -> DataFrame:
    """camera_id, pos, path of the first n image files of each product, of those that exist if a listing is given."""
    each = records.select("camera_id", F.posexplode("image_files").alias("pos", "path"))
    each = each.join(existing.select("path").distinct(), "path", "left_semi") if existing is not None else each
    rank = F.row_number().over(Window.partitionBy("camera_id").orderBy("pos"))
    return each.withColumn("__n", rank).where(F.col("__n") <= n).select("camera_id", "pos", "path")


def columns_of(df: DataFrame, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """The wanted columns that exist, and the names of those that don't."""
    return df.select(*[c for c in wanted if c in df.columns]), [c for c in wanted if c not in df.columns]
