"""Queries of whole reports: validation, evaluation summaries, versions' records, detections' metadata, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import geometry
from lodestone.operators import catalog, evaluation, identify, merge, validation
from lodestone.plans import more_queries, stream_queries
from lodestone.sources import snapshots, tables
from lodestone.sources.shared import scratch

#: Lines of the validation report that have a number.
SHOWN = ["Errors", "Warnings", "Total Records", "Missing Images", "Invalid Image Format", "Duplicate IDs", "Expected Products"]


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def validation_whole(spark, sf_dir):
    """All layers over the product table and a listing of its images, which lacks some and has some of another kind: the
    report's numbers, and those of its text (one row each)."""
    products = more_queries._products(spark, sf_dir)
    each = catalog.as_records(products).select(F.col("camera_id").cast("long").alias("k"), F.posexplode("image_files").alias("pos", "path"))
    files = each.where("k % 6 <> 0 or pos = 1").select("path", F.when(F.col("k") % 10 == 0, F.lit(b"JUNK")).otherwise(F.lit(b"RIFF")).alias("head"))
    report = validation.validate(products, files)
    numbers = {name: value for name, value in report.stats.items() if isinstance(value, int)} | {"n_errors": report.n_errors, "n_warnings": report.n_warnings}
    lines = (line.partition(": ") for line in validation.format_report(report).split("\n"))
    numbers |= {name: int(value) for name, _, value in lines if name in SHOWN}
    return spark.createDataFrame(list(numbers.items()), "name string, value long")


def eval_limited(spark, sf_dir):
    """The evaluation of the first five products alone."""
    return evaluation.synthetic(stream_queries._index(spark, sf_dir), ["cut"], [1], limit=5).select("group", "severity", "n", "top1_hits", "top5_hits")


def eval_summary(spark, sf_dir):
    """The summary's lines; a vector's own label is at rank one to seven, by its id."""
    labelled = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("truth"), F.concat(F.lit("label "), F.col("label") % 3).alias("group"), F.lit(1).alias("severity"))
    matches = labelled.select("query_id", (F.col("query_id") % 7 + 1).alias("rank"), F.col("truth").alias("camera_id"))
    rates = evaluation.recall(labelled, matches, "group", "severity").orderBy("group").collect()  # a row for each group
    lines = evaluation.format_summary(rates, "recall by label").split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "n long, line string")


def identify_degenerate(spark, sf_dir):
    """Boxes of detections of enough confidence, those without an area too."""
    k = F.col("p_partkey")
    found = _t(spark, sf_dir, "part").select(
        k.alias("detection_id"), (k % 50).cast("double").alias("x_min"), F.lit(10.0).alias("y_min"), (k % 50 + F.when(k % 3 == 0, 0).otherwise(20)).cast("double").alias("x_max"), F.lit(30.0).alias("y_max"),
        (k % 10 / 10).alias("confidence"), F.lit(60).alias("width"), F.lit(80).alias("height"),
    )
    return identify.crop_boxes(found, margin=0.0, keep_degenerate=True).select("detection_id", "box.x_min", "box.y_min", "box.x_max", "box.y_max", "degenerate")


def identify_metadata(spark, sf_dir):
    k = F.col("n_nationkey")
    box = geometry.box(k.cast("double"), F.lit(1.0), (k + 10).cast("double"), F.lit(21.0))
    match = F.struct(F.lit(1).alias("rank"), F.col("n_name").alias("camera_id"), (k / 32).alias("score"))
    found = _t(spark, sf_dir, "nation").select(k.cast("string").alias("detection_id"), box.alias("box"), (1 - k / 64).alias("confidence"), F.when(k % 4 == 0, F.array().cast("array<struct<rank:int,camera_id:string,score:double>>")).otherwise(F.array(match)).alias("matches"))
    return identify.metadata(found)


def version_facts(spark, sf_dir):
    """What is recorded of a version and of an append to it, half of whose keys it has already."""
    store, nation = snapshots.Snapshots(spark, scratch(spark, "facts")), _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("camera_id"), "n_name")
    store.create(nation.where("camera_id < 10"))
    store.append(nation.where("camera_id >= 5"), "camera_id", "n_name")
    facts = [store.info(n) for n in (1, 2)]
    rows = [(v.version, v.parent_version or 0, bool(v.append_mode), v.record_count, v.records_added or 0, v.records_updated or 0) for v in facts]
    return spark.createDataFrame(rows, "version long, parent_version long, append_mode boolean, record_count long, records_added long, records_updated long")


def version_manifests(spark, sf_dir):
    """Three versions, of whose manifests the first has all parts, the second the same dealt anew, and the third all but the
    last: whether their hashes are that of the first."""
    part, store = _t(spark, sf_dir, "part"), snapshots.Snapshots(spark, scratch(spark, "manifests"))
    documents = part.select("p_partkey", F.to_json(F.struct("p_partkey", "p_name", "p_type")).alias("json"))
    last = documents.agg(F.max("p_partkey").alias("last"))
    fewer = documents.join(last, F.col("p_partkey") == F.col("last"), "left_anti")
    rows = part.select("p_partkey").limit(1)
    hashes = [store.create(rows, manifest=d.select("json")).manifest_hash for d in (documents, documents.repartition(7, "json"), fewer)]
    told = spark.createDataFrame([(n + 1, h == hashes[0]) for n, h in enumerate(hashes)], "version long, same boolean")
    return told.crossJoin(documents.agg(F.count("*").alias("n_documents")))  # one row


def report_files(spark, sf_dir):
    """A small report written as JSON and CSV, and both read again."""
    path = scratch(spark, "report")
    tables.write_report(catalog.value_counts(_t(spark, sf_dir, "documents"), "lang"), path)
    lines = spark.read.option("header", True).csv(f"{path}/csv").select("lang", F.col("n").cast("long").alias("csv_n"))
    return spark.read.json(f"{path}/json").join(lines, "lang")


def catalog_head(spark, sf_dir):
    return catalog.head(_t(spark, sf_dir, "part"), 7, "p_name", "p_partkey").select("p_partkey", "p_name")


def catalog_reloaded(spark, sf_dir):
    """A cached table that grows on disk: rows seen before it is reloaded, and after."""
    path, part = scratch(spark, "cached"), _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    part.where("p_partkey % 2 = 0").write.parquet(path)
    cached = tables.CachedTable(spark, path)
    before = cached.df.groupBy("p_brand").agg(F.count("*").alias("n_before")).collect()  # a row for each brand
    part.where("p_partkey % 2 = 1").write.mode("append").parquet(path)
    after = cached.reload().groupBy("p_brand").agg(F.count("*").alias("n_after"))
    return after.join(spark.createDataFrame(before, "p_brand string, n_before long"), "p_brand", "left").withColumn("n_before", F.coalesce("n_before", F.lit(0).cast("long")))


def merge_registered(spark, sf_dir):
    """A strategy of one's own: of two rows with a key, the one with the longer name; and the message for an unknown one."""
    key = F.col("p_partkey")
    old = _t(spark, sf_dir, "part").where(key % 3 < 2).select(key.alias("camera_id"), F.col("p_name").alias("name"))
    new = _t(spark, sf_dir, "part").where(key % 3 > 0).select(key.alias("camera_id"), F.col("p_type").alias("name"))
    longest = F.max_by("name", F.struct(F.length("name"), F.col("name")))
    merge.register("longest", lambda a, b, k, order: a.unionByName(b).groupBy(k).agg(longest.alias("name")))
    try:
        merged, _ = merge.merge(old, new, "camera_id", "name", "longest")
    finally:
        del merge.STRATEGIES["longest"]
    try:
        merge.merge(old, new, "camera_id", "name", "longest")
        refused = ""
    except ValueError as e:
        refused = str(e)
    return merged.withColumn("refused", F.lit(refused))


QUERIES = [catalog_head, catalog_reloaded, merge_registered, validation_whole, eval_limited, eval_summary, identify_degenerate, identify_metadata, version_facts, version_manifests, report_files]

SQL = {
    "catalog_head": "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 7",
    "catalog_reloaded": "SELECT p_brand, count(*) FILTER (p_partkey % 2 = 0) AS n_before, count(*) AS n_after FROM part GROUP BY p_brand",
    "merge_registered": """SELECT p_partkey AS camera_id, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 2 THEN p_type ELSE CASE WHEN (length(p_name), p_name) > (length(p_type), p_type) THEN p_name ELSE p_type END END AS name,
      'unknown strategy ''longest''; there are [''error'', ''skip'', ''update'']' AS refused FROM part""",
    "validation_whole": """WITH c AS (SELECT count(*) AS total, count(*) FILTER (p_partkey % 4 <> 1) AS specs, count(*) FILTER (p_partkey % 6 = 0) AS missing,
        2 * count(*) FILTER (p_partkey % 10 = 0) - count(*) FILTER (p_partkey % 30 = 0) AS junk, count(*) FILTER (p_partkey % 5 <> 0) AS listed FROM part),
      n AS (SELECT *, missing + junk + CASE WHEN listed < total THEN 2 ELSE 0 END AS errors, CASE WHEN listed < total THEN 1 ELSE 0 END AS warnings FROM c)
      SELECT t.name, CAST(t.value AS BIGINT) AS value FROM n, LATERAL (VALUES ('total_records', total), ('records_with_images', total), ('records_with_pdfs', 0), ('records_with_specs', specs), ('missing_images', missing), ('invalid_format_images', junk),
        ('missing_pdfs', 0), ('invalid_format_pdfs', 0), ('duplicate_ids', 0), ('no_media_records', 0), ('manifest_products', listed), ('n_errors', errors), ('n_warnings', warnings),
        ('Errors', errors), ('Warnings', warnings), ('Total Records', total), ('Missing Images', missing), ('Invalid Image Format', junk), ('Duplicate IDs', 0), ('Expected Products', listed)) AS t(name, value)""",
    "eval_limited": """WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      o AS (SELECT vec_id, label, e FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1 ORDER BY vec_id LIMIT 5),
      c AS (SELECT vec_id, label, list_transform(e, lambda x, i: CASE WHEN i <= 8 THEN 0.0 ELSE x END) AS e FROM o),
      n AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM c),
      s AS (SELECT n.vec_id AS q, n.label AS truth, v.label AS camera_id, v.vec_id AS row_id, list_dot_product(n.u, v.e) AS score FROM n CROSS JOIN v),
      b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q, camera_id ORDER BY score DESC, row_id) = 1),
      r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, camera_id, row_id) AS rank FROM b),
      f AS (SELECT q, min(rank) FILTER (camera_id = truth AND rank <= 5) AS found FROM r GROUP BY q)
      SELECT 'cut' AS "group", 1 AS severity, count(*) AS n, count(*) FILTER (found = 1) AS top1_hits, count(*) FILTER (found <= 5) AS top5_hits FROM f""",
    "eval_summary": """WITH g AS (SELECT 'label ' || label % 3 AS grp, count(*) AS n, count(*) FILTER (vec_id % 7 = 0) AS one, count(*) FILTER (vec_id % 7 <= 4) AS five FROM embeddings GROUP BY 1)
      SELECT CAST(0 AS BIGINT) AS n, 'recall by label' AS line UNION ALL SELECT 1, printf('%-24s%9s%8s%9s%9s', 'group', 'severity', 'n', 'top-1', 'top-5')
      UNION ALL SELECT 1 + row_number() OVER (ORDER BY grp), printf('%-24s%9d%8d%9.4f%9.4f', grp, 1, n, round_even(one / n, 4), round_even(five / n, 4)) FROM g""",
    "identify_degenerate": """SELECT p_partkey AS detection_id, CAST(p_partkey % 50 AS INTEGER) AS x_min, 10 AS y_min, CAST(least(p_partkey % 50 + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 20 END, 60) AS INTEGER) AS x_max, 30 AS y_max, p_partkey % 3 = 0 AS degenerate
      FROM part WHERE p_partkey % 10 >= 3""",
    "identify_metadata": """SELECT CAST(n_nationkey AS VARCHAR) AS detection_id, '{"bbox":[' || n_nationkey || ',1,' || n_nationkey + 10 || ',21],"confidence":' || round(1 - n_nationkey / 64, 2) || ',"matches":['
        || CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE '{"camera_id":"' || n_name || '","score":' || round(n_nationkey / 32, 2) || '}' END || ']}' AS metadata FROM nation""",
    "version_facts": """WITH c AS (SELECT count(*) FILTER (n_nationkey < 10) AS a, count(*) AS b, count(*) FILTER (n_nationkey >= 10) AS fresh, count(*) FILTER (n_nationkey BETWEEN 5 AND 9) AS met FROM nation)
      SELECT CAST(1 AS BIGINT) AS version, CAST(0 AS BIGINT) AS parent_version, false AS append_mode, a AS record_count, CAST(0 AS BIGINT) AS records_added, CAST(0 AS BIGINT) AS records_updated FROM c
      UNION ALL SELECT 2, 1, true, b, fresh, met FROM c""",
    "version_manifests": "SELECT CAST(v AS BIGINT) AS version, v < 3 AS same, (SELECT count(*) FROM part) AS n_documents FROM (VALUES (1), (2), (3)) AS t(v)",
    "report_files": "SELECT lang, count(*) AS n, count(*) AS csv_n FROM documents WHERE lang IS NOT NULL GROUP BY lang",
}
