"""Queries of operators beside the main paths: records and views, product rows, images, files, versions, probes.

Inputs are made of the test tables' rows by expressions, so that SQL can say what must come out.
"""

from __future__ import annotations

import contextlib
import os
import sqlite3
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import text
from lodestone.functions import vectors as V
from lodestone.operators import cache, catalog, evaluation, manifest, merge, validation, vectors
from lodestone.schema import MANIFEST_PRODUCT
from lodestone.sources import snapshots, tables
from lodestone.sources.shared import scratch


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _products(spark, sf_dir):
    """part as the product table at rest, with blanks, broken JSON and several image files."""
    key, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    return _t(spark, sf_dir, "part").select(
        s.alias("camera_id"), F.when(key % 7 == 0, " ").otherwise(F.col("p_name")).alias("model_name"), F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("The "), "p_name")).alias("display_name"),
        F.lit(None).cast("string").alias("description"), F.when(key % 5 == 0, None).otherwise(F.col("p_brand")).alias("source"), F.when(key % 11 == 0, "").otherwise("Camera").alias("category"),
        F.col("p_type").alias("product_category"), F.col("p_brand").alias("product_series"),
        F.when(key % 4 == 0, "[broken").otherwise(F.concat(F.lit('["http://h/'), s, F.lit('.jpg", "/local.jpg"]'))).alias("image_urls"),
        F.when(key % 2 == 0, F.concat(F.lit('["data/images/'), s, F.lit('/1.webp", "'), s, F.lit('/2.webp"]'))).otherwise("[]").alias("image_files"),
        F.lit(None).cast("string").alias("datasheet_url"), F.lit(None).cast("string").alias("datasheet_file"),
        F.when(key % 4 == 1, None).otherwise(F.concat(F.lit('{"Body": {"Size": "'), F.col("p_size").cast("string"), F.lit('"}, "n": 3}'))).alias("specifications"),
    )


def catalog_records(spark, sf_dir):
    """The typed view: defaults filled in, broken JSON empty."""
    records = catalog.as_records(_products(spark, sf_dir))
    size = F.size("specifications").cast("long")
    return records.select("camera_id", "model_name", "display_name", "source", "category", F.size("image_urls").cast("long").alias("n_urls"), F.size("image_files").cast("long").alias("n_files"), size.alias("n_specs"))


def catalog_rows_again(spark, sf_dir):
    """Records written back as JSON text, and read once more."""
    again = catalog.as_records(catalog.as_rows(catalog.as_records(_products(spark, sf_dir))))
    return again.select("camera_id", F.array_join("image_urls", " ").alias("urls"), F.array_join("image_files", " ").alias("files"), F.coalesce(F.try_element_at("specifications", F.lit("n")), F.lit("")).alias("n"))


def catalog_detail_view(spark, sf_dir):
    view = catalog.detail_view(_products(spark, sf_dir))
    return view.select("camera_id", F.array_join("image_urls", " ").alias("urls"), F.array_join("image_files", " ").alias("files"))


def catalog_first_images(spark, sf_dir):
    """The first image of each product that exists; those with keys that 6 divides have only their second."""
    records = catalog.as_records(_products(spark, sf_dir))
    there = records.select("camera_id", F.posexplode("image_files").alias("pos", "path")).where("cast(camera_id as long) % 6 <> 0 or pos = 1").select("path")
    return catalog.first_images(records, 1, there).select("camera_id", F.col("pos").cast("long").alias("pos"), "path")


def catalog_columns_missing(spark, sf_dir):
    found, missing = catalog.columns_of(_t(spark, sf_dir, "nation"), ["n_nationkey", "nothing", "n_name", "n_gone"])
    return found.withColumn("missing", F.lit(",".join(missing)))


def optional_columns(spark, sf_dir):
    """A table read by a layout with a column that it lacks."""
    layout = T.StructType([T.StructField("r_regionkey", T.LongType()), T.StructField("r_name", T.StringType()), T.StructField("r_absent", T.StringType())])
    return tables.parquet(spark, f"{sf_dir}/region.parquet", layout).withColumn("r_absent", F.coalesce("r_absent", F.lit("null")))


def manifest_products(spark, sf_dir):
    """Product rows of a flat manifest; those without an id or a name are left out."""
    key = F.col("p_partkey")
    flat = _t(spark, sf_dir, "part").select(
        F.col("p_type").alias("category"), F.col("p_brand").alias("series"), F.when(key % 9 == 0, "").otherwise(key.cast("string")).alias("camera_id"), F.when(key % 5 == 0, None).otherwise(F.col("p_name")).alias("model_name"),
        F.when(key % 2 == 0, F.array(F.lit("u"))).alias("image_urls"), F.when(key % 3 == 0, "d").alias("datasheet_url"), F.when(key % 4 == 0, F.create_map(F.lit("a"), F.create_map(F.lit("b"), F.lit("c")))).alias("specifications_html"),
        F.when(key % 2 == 0, " ").otherwise(F.col("p_brand")).alias("vendor"),
    )
    rows = manifest.to_products(flat)
    return rows.select("camera_id", "model_name", "display_name", "source", "category", "product_category", "product_series", "image_urls", F.coalesce("datasheet_url", F.lit("")).alias("datasheet_url"), F.coalesce("specifications", F.lit("")).alias("specifications"))


def manifest_counts(spark, sf_dir):
    """What each product of a manifest has."""
    flat = _t(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_partkey") % 3 > 0, F.array_repeat(F.lit("u"), (F.col("p_partkey") % 3).cast("int"))).alias("image_urls"), F.when(F.col("p_partkey") % 2 == 0, "d").alias("datasheet_url"),
        F.when(F.col("p_partkey") % 5 == 0, F.create_map().cast(MANIFEST_PRODUCT["specifications_html"].dataType)).otherwise(F.create_map(F.lit("a"), F.create_map(F.lit("b"), F.lit("c")))).alias("specifications_html"),
    )
    counted = manifest.with_counts(flat)
    return counted.select("p_partkey", F.col("image_count").cast("long").alias("image_count"), "has_datasheet", "has_specs")


def manifest_of_products(spark, sf_dir):
    flat = validation.manifest_of(_products(spark, sf_dir).withColumn("specifications", F.lit('{"a": {"b": "c"}}')))
    return flat.select("category", "series", "camera_id", F.array_join("image_urls", " ").alias("urls"), F.size("specifications_html").cast("long").alias("n_specs"))


def validation_quality_issues(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(F.col("source").alias("camera_id"), F.when(F.col("doc_id") % 2 == 0, "[]").otherwise('["u"]').alias("image_urls"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("d").alias("datasheet_url"))
    return validation.quality_issues(rows).select("severity", "type", F.coalesce("field", F.lit("")).alias("field"), "cnt")


def validation_distribution(spark, sf_dir):
    return validation.distribution(_t(spark, sf_dir, "documents"), "lang")


def text_helpers(spark, sf_dir):
    """Hashes, codes, lengths and sizes of an upload."""
    key = F.col("p_partkey")
    code = (key % 26 + 65) + (key % 10 + 48) * 256 + F.lit(86 * 65536 + 67 * 16777216)
    return _t(spark, sf_dir, "part").select(
        "p_partkey", F.left(text.file_hash(F.col("p_name").cast("binary")), F.lit(16)).alias("hash"), text.fourcc(code.cast("int")).alias("fourcc"), text.video_seconds(key.cast("double"), (key % 5 - 1).cast("double")).alias("seconds"),
        text.megabytes(key * 524288).alias("megabytes"),
        text.vendor_name(F.when(key % 3 == 0, "HIKVISION").when(key % 3 == 1, "AXIS_COMMUNICATIONS").otherwise(F.col("p_brand"))).alias("vendor"),
    )


def augmentation_recipes(spark, sf_dir):
    """The first three recipes for every nation."""
    rows = [(i, *r) for i, r in enumerate(evaluation.recipes(3))]
    few = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), F.lit(s).alias("severity")) for i, n, s in rows])
    return _t(spark, sf_dir, "nation").select("n_nationkey", F.inline(few))


def files_roundtrip(spark, sf_dir):
    """Rows written as Parquet, replaced by force, and as CSV, and read back; the folder's files by their first bytes."""
    path, part = scratch(spark, "files"), _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    tables.write_parquet(part.limit(0), f"{path}/p")
    tables.write_parquet(part, f"{path}/p", force=True)
    tables.write_csv(part, f"{path}/c")
    back = tables.parquet(spark, f"{path}/p").agg(F.count("*").alias("rows"), F.sum("p_partkey").alias("keys"))
    lines = spark.read.option("header", True).csv(f"{path}/c").agg(F.sum(F.col("p_partkey").cast("long")).alias("csv_keys"), F.count_distinct("p_brand").alias("brands"))
    heads = tables.files(spark, f"{path}/p", "part-*.parquet").agg(F.min(F.col("head").cast("string")).alias("head"), F.max(F.col("head").cast("string")).alias("head_too"))
    return back.crossJoin(lines).crossJoin(heads)  # one row each


def versions_kept(spark, sf_dir):
    """Four versions, the pointer back at the second, all but the last removed: the second stays, as it is current."""
    store, nation = snapshots.Snapshots(spark, scratch(spark, "versions")), _t(spark, sf_dir, "nation")
    for n in range(4):
        store.create(nation.where(F.col("n_nationkey") < 5 * (n + 1)))
    store.point_to(2)
    store.keep_last(1)
    own = store.read().agg(F.count("*").alias("current_rows"))
    return store.log().select("version", "record_count").crossJoin(own)  # one row


def merge_conflicts(spark, sf_dir):
    """Keys that an append by error would name."""
    old, new = _t(spark, sf_dir, "region").select("r_regionkey", "r_name"), _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("r_name"))
    named = []
    try:
        merge.error(old, new, "r_regionkey", "r_name")
    except merge.MergeConflict as e:
        named = e.keys
    both = merge.conflicts(old, new, "r_regionkey").select(F.col("r_regionkey").alias("both"))
    met = old.join(both, F.col("r_regionkey") == F.col("both"), "left")
    return met.select("r_regionkey", (F.col("both").isNotNull() & F.col("r_regionkey").isin(named)).alias("named"))


def sqlite_product_cache(spark, sf_dir):
    """part as product caches in SQLite files, a third of it with broken JSON, read again in ranges of rows.

    Each task leaves a file of its rows in the shared folder, as crawlers would; files of failed tasks stay unread."""
    part = _t(spark, sf_dir, "part").select(
        F.concat(F.lit("/p/"), F.col("p_partkey")).alias("product_url"), F.col("p_name").alias("model_name"),
        F.when(F.col("p_partkey") % 3 == 0, "[broken").otherwise(F.to_json(F.array(F.concat(F.lit("i/"), F.col("p_partkey"))))).alias("image_urls"),
        F.lit(None).cast("string").alias("datasheet_url"), F.to_json(F.struct(F.struct("p_brand").alias("body"))).alias("specifications_html"),
    )
    folder = scratch(spark, "caches").removeprefix("file://").removeprefix("file:")

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/{uuid.uuid4().hex}.db"
        with contextlib.closing(sqlite3.connect(path)) as db:
            db.execute("CREATE TABLE product_cache (product_url TEXT PRIMARY KEY, model_name TEXT, image_urls TEXT, datasheet_url TEXT, specifications_html TEXT)")
            for batch in batches:
                db.executemany("INSERT INTO product_cache VALUES (?, ?, ?, ?, ?)", zip(*(c.to_pylist() for c in batch.columns)))
            db.commit()
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    paths = [r["path"] for r in part.mapInArrow(leave, "path string").collect()]  # one for each task
    found = manifest.decoded(tables.sqlite(spark, paths, "product_cache"))
    return found.select("product_url", "model_name", F.array_join("image_urls", " ").alias("images"), F.coalesce(F.col("specifications_html")["body"]["p_brand"], F.lit("")).alias("brand"))


def cached_details(spark, sf_dir):
    """Details of pages: known ones from the cache, the others extracted."""
    pages = _t(spark, sf_dir, "pages").select("url", "html")
    known = pages.where(F.col("url").rlike("[02468]$")).select("url", F.lit("known").alias("name"))
    return cache.cached_or_extracted(pages, known, lambda fresh: fresh.select("url", F.lit("fresh").alias("name")))


def index_of_images(spark, sf_dir):
    """Vectors of images in two variants; images whose vector can't be made are left out."""
    images = _t(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("camera_id"), F.concat(F.lit("i"), F.col("vec_id").cast("string")).alias("image_path"), F.lit("s").alias("source"), F.col("vec_id").cast("string").cast("binary").alias("content"))

    def embed(contents, tag):
        return [None if int(c) % 10 == 0 else [float(int(c)), 1.0 if tag == "orig" else 2.0] for c in contents]

    index = vectors.build_index(images, embed, ["warp1"])
    size = vectors.check_index(index)
    return index.select("camera_id", "image_path", "variant_tag", F.element_at("embedding", 1).cast("long").alias("x"), F.element_at("embedding", 2).cast("long").alias("y"), F.lit(size).alias("size"))


def eval_probe(spark, sf_dir):
    """Recall by vendor of labelled probes: vectors of the index itself, some without an embedding."""
    index = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("camera_id"), "embedding")
    asked = index.where("row_id % 50 = 0")
    probes = asked.select(F.col("row_id").cast("string").alias("image"), "camera_id", F.when(F.col("row_id") % 100 == 0, "axis").alias("vendor"), F.when(F.col("row_id") % 150 != 0, V.doubles(F.col("embedding"))).alias("embedding"))
    rates, without = evaluation.probe(probes, index)
    return rates.select("group", "n", "top1_hits", "top5_hits").withColumn("without", F.lit(without).cast("long"))


QUERIES = [
    catalog_records, catalog_rows_again, catalog_detail_view, catalog_first_images, catalog_columns_missing, optional_columns, manifest_products, manifest_counts, manifest_of_products, validation_quality_issues,
    validation_distribution, text_helpers, augmentation_recipes, files_roundtrip, sqlite_product_cache, versions_kept, merge_conflicts, cached_details, index_of_images, eval_probe,
]

_P = """(SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS s, p_name, p_brand, p_type, p_size FROM part)"""
_URLS = "CASE WHEN k % 4 = 0 THEN '' ELSE 'http://h/' || s || '.jpg"

SQL = {
    "catalog_records": f"""WITH r AS (SELECT *, CASE WHEN k % 7 = 0 THEN s ELSE p_name END AS model_name FROM {_P})
      SELECT s AS camera_id, model_name, CASE WHEN k % 3 = 0 THEN model_name ELSE 'The ' || p_name END AS display_name, CASE WHEN k % 5 = 0 THEN 'Unknown' ELSE p_brand END AS source, CASE WHEN k % 11 = 0 THEN 'Unknown' ELSE 'Camera' END AS category,
        CAST(CASE WHEN k % 4 = 0 THEN 0 ELSE 2 END AS BIGINT) AS n_urls, CAST(CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_files, CAST(CASE WHEN k % 4 = 1 THEN 0 ELSE 2 END AS BIGINT) AS n_specs FROM r""",
    "catalog_rows_again": f"SELECT s AS camera_id, {_URLS} /local.jpg' END AS urls, CASE WHEN k % 2 = 0 THEN 'data/images/' || s || '/1.webp ' || s || '/2.webp' ELSE '' END AS files, CASE WHEN k % 4 = 1 THEN '' ELSE '3' END AS n FROM {_P}",
    "catalog_detail_view": f"SELECT s AS camera_id, {_URLS}' END AS urls, CASE WHEN k % 2 = 0 THEN '/api/v1/images/' || s || '/1.webp /api/v1/images/' || s || '/2.webp' ELSE '' END AS files FROM {_P}",
    "catalog_first_images": f"SELECT s AS camera_id, CAST(CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS pos, CASE WHEN k % 6 = 0 THEN s || '/2.webp' ELSE 'data/images/' || s || '/1.webp' END AS path FROM {_P} WHERE k % 2 = 0",
    "catalog_columns_missing": "SELECT n_nationkey, n_name, 'nothing,n_gone' AS missing FROM nation",
    "optional_columns": "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name, 'null' AS r_absent FROM region",
    "manifest_products": f"""SELECT s AS camera_id, p_name AS model_name, p_name AS display_name, CASE WHEN k % 2 = 0 THEN 'Unknown' ELSE p_brand END AS source, 'Network Camera' AS category, p_type AS product_category, p_brand AS product_series,
      CASE WHEN k % 2 = 0 THEN '["u"]' ELSE '[]' END AS image_urls, CASE WHEN k % 3 = 0 THEN 'd' ELSE '' END AS datasheet_url, CASE WHEN k % 4 = 0 THEN '{{"a":{{"b":"c"}}}}' ELSE '' END AS specifications FROM {_P} WHERE k % 9 <> 0 AND k % 5 <> 0""",
    "manifest_counts": "SELECT p_partkey, CAST(p_partkey % 3 AS BIGINT) AS image_count, p_partkey % 2 = 0 AS has_datasheet, p_partkey % 5 <> 0 AS has_specs FROM part",
    "manifest_of_products": f"SELECT p_type AS category, p_brand AS series, s AS camera_id, {_URLS} /local.jpg' END AS urls, CAST(1 AS BIGINT) AS n_specs FROM {_P} WHERE k % 5 <> 0 AND p_type IS NOT NULL AND p_brand IS NOT NULL",
    "validation_quality_issues": """SELECT 'error' AS severity, 'duplicate_ids' AS type, 'camera_id' AS field, CAST(sum(n) AS BIGINT) AS cnt FROM (SELECT count(*) AS n FROM documents GROUP BY source HAVING count(*) > 1) HAVING sum(n) > 0
      UNION ALL SELECT 'warning', 'no_media_records', '', count(*) FROM documents WHERE doc_id % 6 = 0 HAVING count(*) > 0""",
    "validation_distribution": "SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang",
    "text_helpers": f"""SELECT k AS p_partkey, left('sha256:' || sha256(p_name), 16) AS hash, chr(CAST(k % 26 + 65 AS INTEGER)) || chr(CAST(k % 10 + 48 AS INTEGER)) || 'VC' AS fourcc, CASE WHEN k % 5 - 1 > 0 THEN k / (k % 5 - 1)::DOUBLE ELSE 0.0::DOUBLE END AS seconds,
      CAST(round(CAST(k * 0.5 AS DECIMAL(18, 4)), 2) AS DOUBLE) AS megabytes, CASE k % 3 WHEN 0 THEN 'HikVision' WHEN 1 THEN 'Axis Communications' ELSE p_brand END AS vendor FROM {_P}""",
    "augmentation_recipes": "SELECT n_nationkey, pos, name, severity FROM nation, (VALUES (0, 'perspective_warp', 1), (1, 'blur', 1), (2, 'lighting', 1)) AS r(pos, name, severity)",
    "files_roundtrip": "SELECT count(*) AS rows, CAST(sum(p_partkey) AS BIGINT) AS keys, CAST(sum(p_partkey) AS BIGINT) AS csv_keys, count(DISTINCT p_brand) AS brands, 'PAR1' AS head, 'PAR1' AS head_too FROM part",
    "sqlite_product_cache": "SELECT '/p/' || p_partkey AS product_url, p_name AS model_name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'i/' || p_partkey END AS images, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS brand FROM part",
    "versions_kept": "SELECT v AS version, (SELECT count(*) FROM nation WHERE n_nationkey < 5 * v) AS record_count, (SELECT count(*) FROM nation WHERE n_nationkey < 10) AS current_rows FROM (VALUES (2), (4)) AS t(v)",
    "merge_conflicts": "SELECT r_regionkey, true AS named FROM region",
    "cached_details": "SELECT url, CASE WHEN regexp_matches(url, '[02468]$') THEN 'known' ELSE 'fresh' END AS name FROM pages",
    "index_of_images": "SELECT CAST(label AS VARCHAR) AS camera_id, 'i' || vec_id AS image_path, t.tag AS variant_tag, CAST(vec_id AS BIGINT) AS x, CAST(t.y AS BIGINT) AS y, 2 AS size FROM embeddings, (VALUES ('orig', 1), ('warp1', 2)) AS t(tag, y) WHERE vec_id % 10 <> 0",
    "eval_probe": """WITH v AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v WHERE vec_id % 50 = 0 AND vec_id % 150 <> 0),
      s AS (SELECT n.vec_id AS q, n.label AS truth, v.label AS camera_id, CAST(v.vec_id AS VARCHAR) AS row_id, list_dot_product(n.u, v.e) AS score FROM n CROSS JOIN v),
      b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q, camera_id ORDER BY score DESC, row_id) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, camera_id, row_id) AS rank FROM b),
      f AS (SELECT q, min(rank) FILTER (camera_id = truth AND rank <= 5) AS found FROM r GROUP BY q)
      SELECT CASE WHEN q % 100 = 0 THEN 'axis' ELSE 'unknown' END AS "group", count(*) AS n, count(*) FILTER (found = 1) AS top1_hits, count(*) FILTER (found <= 5) AS top5_hits, (SELECT count(*) FROM embeddings WHERE vec_id % 150 = 0) AS without FROM f GROUP BY 1""",
}
