"""The product manifest: a tree of categories, series and products, and its flat form.

The flat form, one row per product, is canonical; trees are read into it and rendered from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text


def flatten(tree: DataFrame) -> DataFrame:
    """category, series and product fields of a manifest (schema.MANIFEST), with positions in the document."""
    return (
        tree.select(F.posexplode("categories").alias("category_pos", "category", "c"))
        .select("category_pos", "category", F.posexplode("c.series").alias("series_pos", "series", "s"))
        .select("category_pos", "category", "series_pos", "series", F.posexplode("s.products").alias("pos", "p"))
        .select("category_pos", "category", "series_pos", "series", "pos", "p.*")
    )


def to_products(flat: DataFrame) -> DataFrame:
    """Rows of the product table; products without an id or a name are left out."""
    usable = flat.where((F.coalesce("camera_id", F.lit("")) != "") & (F.coalesce("model_name", F.lit("")) != ""))
    vendor = F.col("vendor") if "vendor" in flat.columns else F.lit(None).cast("string")
    return usable.select(
        "camera_id", "model_name", F.col("model_name").alias("display_name"), F.lit(None).cast("string").alias("description"),
        F.coalesce(text.blank_to_null(vendor), F.lit("Unknown")).alias("source"), F.lit("Network Camera").alias("category"),
        F.col("category").alias("product_category"), F.col("series").alias("product_series"),
        F.to_json(F.coalesce("image_urls", F.array().cast("array<string>"))).alias("image_urls"), F.lit("[]").alias("image_files"),
        "datasheet_url", F.lit(None).cast("string").alias("datasheet_file"), F.to_json("specifications_html").alias("specifications"),
    )


def with_counts(flat: DataFrame) -> DataFrame:
    """image_count, has_datasheet, has_specs of each product."""
    return flat.withColumns({
        "image_count": F.greatest(F.size(F.coalesce("image_urls", F.array().cast("array<string>"))), F.lit(0)),
        "has_datasheet": F.col("datasheet_url").isNotNull(),
        "has_specs": F.coalesce(F.size("specifications_html"), F.lit(0)) > 0,
    })


def rollup(counted: DataFrame, *levels: str) -> DataFrame:
    """Products, images, PDFs and specs at every level and in all, in one pass; level 0 is the leaves' parents."""
    return counted.rollup(*levels).agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("product_count"), F.sum("image_count").cast("long").alias("image_count"),
        F.count_if("has_datasheet").alias("pdf_count"), F.count_if("has_specs").alias("spec_count"),
    )


#: Products of a document of render() on average, where its parts are not given.
DOCUMENT_PRODUCTS = 10_000


def render(flat: DataFrame, parts: int | None = None) -> DataFrame:
    """category, series, part and json: documents in the shape of schema.MANIFEST, one for each series, or more
    where a large series' products are dealt over several by id and name: over parts, or by default over as many
    as its count of products takes. Together they are the manifest, as JSON lines; rollup() has its totals."""
    product = F.struct("camera_id", "model_name", "image_urls", "datasheet_url", "specifications_html")
    if parts is None:
        counts = flat.groupBy(F.col("category").alias("_c"), F.col("series").alias("_s")).agg(F.ceil(F.count("*") / F.lit(DOCUMENT_PRODUCTS)).alias("_parts"))
        same = F.col("category").eqNullSafe(F.col("_c")) & F.col("series").eqNullSafe(F.col("_s"))
        dealt = flat.join(counts, same).drop("_c", "_s")
    else:
        dealt = flat.withColumn("_parts", F.lit(parts))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("camera_id", "model_name"), F.col("_parts")))
    each = dealt.groupBy("category", "series", "part").agg(F.collect_list(product).alias("products"))
    tree = F.create_map("category", F.struct(F.create_map("series", F.struct("products")).alias("series")))
    return each.select("category", "series", "part", F.to_json(F.struct(tree.alias("categories"))).alias("json"))


def compare(expected: DataFrame, actual: DataFrame, *keys: str) -> DataFrame:
    """keys, expected, actual, status (ok, missing, extra, differs) of product counts on both sides."""
    e = expected.groupBy(*keys).agg(F.count("*").alias("expected"))
    a = actual.groupBy(*keys).agg(F.count("*").alias("actual"))
    both = e.join(a, list(keys), "full").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("expected", "actual")})
    status = F.when(F.col("expected") == F.col("actual"), "ok").when(F.col("actual") == 0, "missing").when(F.col("expected") == 0, "extra").otherwise("differs")
    return both.withColumn("status", status)


def tree_paths(files: DataFrame) -> DataFrame:
    """vendor, category, series, camera_id (and the folders) of files vendor/category/series/id/n.webp or
    vendor/category/series/id.pdf below a root; files: path, relative to it."""
    parts = F.split("path", "/")
    pdf = F.lower("path").endswith(".pdf") & (F.size(parts) == 4)
    image = F.lower("path").endswith(".webp") & (F.size(parts) == 5)
    camera = F.when(pdf, F.regexp_replace(parts[3], r"(?i)\.pdf$", "")).otherwise(F.get(parts, 3))
    return files.where(pdf | image).select(
        "path", pdf.alias("is_pdf"), F.get(parts, 0).alias("vendor_dir"), F.get(parts, 1).alias("category_dir"), F.get(parts, 2).alias("series_dir"), camera.alias("camera_id"),
        text.vendor_name(F.get(parts, 0)).alias("vendor"), text.folder_title(F.get(parts, 1)).alias("category"), F.replace(F.get(parts, 2), F.lit("_"), F.lit(" ")).alias("series"),
    )


def media(paths: DataFrame) -> DataFrame:
    """Image files in order and the PDF of each product, from the first vendor folder that has the product."""
    keys = ["category_dir", "series_dir", "camera_id"]
    per_vendor = paths.groupBy(*keys, "vendor_dir").agg(
        F.first("vendor").alias("vendor"), F.first("category").alias("category"), F.first("series").alias("series"),
        F.sort_array(F.collect_list(F.when(~F.col("is_pdf"), F.col("path")))).alias("image_files"), F.min(F.when(F.col("is_pdf"), F.col("path"))).alias("datasheet_file"),
    )
    has = lambda c: F.min(F.when(c, F.col("vendor_dir")))
    chosen = per_vendor.groupBy(*keys).agg(has(F.size("image_files") > 0).alias("image_vendor"), has(F.col("datasheet_file").isNotNull()).alias("pdf_vendor"))
    images = per_vendor.select(*keys, F.col("vendor_dir").alias("image_vendor"), "vendor", "category", "series", "image_files")
    pdfs = per_vendor.select(*keys, F.col("vendor_dir").alias("pdf_vendor"), "datasheet_file", F.col("vendor").alias("pdf_owner"), F.col("category").alias("c2"), F.col("series").alias("s2"))
    joined = chosen.join(images, [*keys, "image_vendor"], "left").join(pdfs, [*keys, "pdf_vendor"], "left")
    return joined.select(
        *keys, F.coalesce("vendor", "pdf_owner").alias("vendor"), F.coalesce("category", "c2").alias("category"), F.coalesce("series", "s2").alias("series"),
        F.coalesce("image_files", F.array().cast("array<string>")).alias("image_files"), "datasheet_file",
    )


def decoded(product_cache: DataFrame) -> DataFrame:
    """product_cache with image_urls and specifications_html decoded; both are empty if either is broken."""
    images, specs = F.from_json("image_urls", "array<string>"), F.from_json("specifications_html", "map<string, map<string, string>>")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    whole = (blank("image_urls") | images.isNotNull()) & (blank("specifications_html") | specs.isNotNull())
    none, empty = F.array().cast("array<string>"), F.create_map().cast("map<string, map<string, string>>")
    return product_cache.withColumns({"image_urls": F.when(whole, F.coalesce(images, none)).otherwise(none), "specifications_html": F.when(whole, F.coalesce(specs, empty)).otherwise(empty)})


def reconstruct(paths: DataFrame, product_cache: DataFrame) -> DataFrame:
    """A flat manifest from files and the product cache (schema.PRODUCT_CACHE); ids the cache lacks keep their
    id as name. The cache's last row of a slug wins, by product_url."""
    found = media(paths)
    cached = decoded(product_cache).withColumn("camera_id", text.slug(F.col("model_name"))).groupBy("camera_id").agg(
        F.max_by(F.struct("model_name", "image_urls", "datasheet_url", "specifications_html"), "product_url").alias("p")
    )
    joined = found.join(cached, "camera_id", "left")
    return joined.select(
        "category", "series", "vendor", "camera_id", F.coalesce("p.model_name", "camera_id").alias("model_name"), F.coalesce("p.image_urls", F.array().cast("array<string>")).alias("image_urls"),
        F.col("p.datasheet_url").alias("datasheet_url"), F.col("p.specifications_html").alias("specifications_html"), F.size("image_files").alias("n_image_files"), "datasheet_file",
    )
