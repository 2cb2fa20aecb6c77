"""Exact cosine search over catalog vectors with one result per product.

Index vectors are stored at unit length. Queries go out in blocks of a bounded size; each block meets each
shard of the index once, a matrix product scores them in tiles of a bounded size, and a shard sends only its
best product rows per query. The best row of a product over all shards, then the k best products, are small
aggregates. Equal scores go to the smaller row, then to the smaller product.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.sources.shared import scratch

QUERY_BLOCK, SHARD_ROWS = 1024, 16384
TILE_SCORES, CHUNK = 1 << 19, 1 << 14  # scores that a task holds at once (4 MB), and rows that it sums again at once


def build_index(images: DataFrame, embed: Callable[[pd.Series], list], variants: list[str] | None = None, kind: str = "binary") -> DataFrame:
    """Vectors of images (camera_id, image_path, source, content) by an injected embed function, one call per
    batch; with variants, embed gets (contents, variant) and each image has a row for 'orig' and each variant.
    Images that embed returns None for are left out; row_id follows camera_id, path and variant."""
    tags = ["orig", *(variants or [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tag in tags:
                found = embed(pdf["content"]) if variants is None else embed(pdf["content"], tag)
                out = pdf.drop(columns="content").assign(variant_tag=tag if variants is not None else None, embedding=list(found))
                yield out[out["embedding"].notna()]

    rows = images.select("camera_id", "image_path", "source", "content").mapInPandas(run, "camera_id string, image_path string, source string, variant_tag string, embedding array<float>")
    return rows.withColumn("row_id", F.xxhash64("camera_id", "image_path", "variant_tag"))


def check_index(index: DataFrame) -> int:
    """The vectors' length; raises if columns are missing, there are no rows, or lengths differ."""
    missing = {"row_id", "camera_id", "embedding"} - set(index.columns)
    if missing:
        raise ValueError(f"the index lacks {sorted(missing)}")
    size = index.agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
    if size["lo"] is None or size["lo"] != size["hi"]:
        raise ValueError("the index is empty" if size["lo"] is None else "vectors of different lengths")
    return size["lo"]


def mean_vector(index: DataFrame) -> DataFrame:
    """One row: mean, the average per dimension over all rows."""
    each = index.select(F.posexplode(V.doubles(F.col("embedding"))).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"))
    return each.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))


def centred(df: DataFrame, mean: DataFrame | None, column: str = "embedding") -> DataFrame:
    """Vectors minus the mean, at unit length again; without a mean, a warning and the vectors as they are."""
    if mean is None:
        warnings.warn("no mean vector: searching without centring", stacklevel=2)
        return df
    return df.crossJoin(F.broadcast(mean)).withColumn(column, V.unit_or_zero(V.minus(V.doubles(F.col(column)), F.col("mean")))).drop("mean")  # the mean is one row


def search(queries: DataFrame, index: DataFrame, k: int = 5, threshold: float | None = None, collapse: bool = True, mean: DataFrame | None = None, exclude_self: bool = False) -> DataFrame:
    """query_id, rank, camera_id, row_id, score. queries: query_id, embedding (any length but zero).

    collapse: one row per product, its best; else every row ranks. threshold applies after the ranking, so
    fewer than k may be left. exclude_self drops rows whose row_id is the query's id. mean centres both sides.
    """
    q = queries.select("query_id", V.unit(V.doubles(F.col("embedding"))).alias("embedding"))
    rows = index.select("row_id", "camera_id", V.doubles(F.col("embedding")).alias("embedding"))
    if mean is not None:
        path = scratch(mean.sparkSession, "mean")  # one row, computed once for both sides and all passes
        mean.write.parquet(path)
        mean = mean.sparkSession.read.schema(mean.schema).parquet(path)
        q, rows = centred(queries.select("query_id", V.doubles(F.col("embedding")).alias("embedding")), mean), centred(rows, mean)
    blocks, shards = max(1, -(-queries.count() // QUERY_BLOCK)), max(1, -(-index.count() // SHARD_ROWS))
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = rows.withColumns({"shard": slot("row_id", shards), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    right = q.withColumns({"block": slot("query_id", blocks), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    ranked = best(scored(left, right, k, collapse, exclude_self), k, collapse)
    return ranked if threshold is None else ranked.where(F.col("score") >= threshold)


def scored(left: DataFrame, right: DataFrame, k: int, collapse: bool, exclude_self: bool) -> DataFrame:
    """query_id, camera_id, row_id, score: what each group of index rows (left) and queries (right) of equal shard and block
    sends, its k best of each query."""
    kinds = {"query_id": right.schema["query_id"].dataType.simpleString(), "row_id": left.schema["row_id"].dataType.simpleString(), "camera_id": left.schema["camera_id"].dataType.simpleString()}

    def score(part: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        return _block_best(part, block, k, collapse, exclude_self)

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(score, f"query_id {kinds['query_id']}, camera_id {kinds['camera_id']}, row_id {kinds['row_id']}, score double")


def best(found: DataFrame, k: int, collapse: bool) -> DataFrame:
    """query_id, rank, camera_id, row_id, score of the k best of each query; with collapse, one row per product."""
    if collapse:
        order = Window.partitionBy("query_id", "camera_id").orderBy(F.desc("score"), "row_id")
        found = found.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "camera_id", "row_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "camera_id", "row_id", "score")


def _block_best(part: pd.DataFrame, block: pd.DataFrame, k: int, collapse: bool, exclude_self: bool) -> pd.DataFrame:
    """The k best rows (or products) of part for each query of block, by tiles of TILE_SCORES scores: a task's memory
    depends neither on the number of queries nor on that of rows."""
    names = ["query_id", "camera_id", "row_id", "score"]
    if part.empty or block.empty:
        return pd.DataFrame(columns=names)
    part = part.sort_values(["camera_id", "row_id"], ignore_index=True)
    matrix, wanted = np.array(part["embedding"].tolist()), np.array(block["embedding"].tolist())
    if matrix.shape[1] != wanted.shape[1]:
        raise ValueError(f"query vectors have {wanted.shape[1]} dimensions, the index {matrix.shape[1]}")
    products, ids, qids = part["camera_id"].to_numpy(), part["row_id"].to_numpy(), block["query_id"].to_numpy()
    starts = np.flatnonzero(np.append(True, products[1:] != products[:-1])) if collapse else None
    tile, out = max(1, TILE_SCORES // len(part)), []
    for at in range(0, len(qids), tile):
        rows, who, scores = _tile_best(matrix, wanted[at : at + tile], starts, k, (ids, qids[at : at + tile]) if exclude_self else None)
        out.append(pd.DataFrame({"query_id": qids[at + who], "camera_id": products[rows], "row_id": ids[rows], "score": scores}))
    return pd.concat(out, ignore_index=True)[names]


def _tile_best(matrix: np.ndarray, wanted: np.ndarray, starts: np.ndarray | None, k: int, own: tuple | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, query and score of each query's k best, best first; starts: where products begin, of which only the best row
    counts. Rows are in the order in which ties rank, over all shards, so whatever ties beyond k has k better ones
    everywhere. The matrix product only tells which rows are near the k-th best: its last bits depend on a row's
    place, so these rows' scores are summed again, and equal vectors have equal scores."""
    count = len(matrix) if starts is None else len(starts)
    if k <= 0:
        return np.array([], dtype=int), np.array([], dtype=int), np.array([])
    scores = matrix @ wanted.T
    scores[~np.isfinite(scores)] = -np.inf
    if own is not None:
        scores[own[0][:, None] == own[1][None, :]] = -np.inf
    slack = 1e-12 * max(1.0, float(np.abs(scores, where=np.isfinite(scores), out=np.zeros_like(scores)).max(initial=0.0)))
    highest = scores if starts is None else np.maximum.reduceat(scores, starts, axis=0)
    least = np.partition(highest, -min(k, count), axis=0)[-min(k, count)] - slack
    rows, who = np.nonzero((scores >= least) & np.isfinite(scores))
    product = rows if starts is None else np.searchsorted(starts, rows, side="right") - 1
    near = slice(None) if starts is None else scores[rows, who] >= highest[product, who] - slack
    rows, who, product = rows[near], who[near], product[near]
    exact = np.concatenate([np.einsum("ij,ij->i", matrix[rows[i : i + CHUNK]], wanted[who[i : i + CHUNK]]) for i in range(0, len(rows), CHUNK)] or [np.array([])])
    order = np.lexsort((rows, -exact, who))
    if starts is not None:  # the first row of each query and product
        order = order[np.sort(np.unique(who[order] * count + product[order], return_index=True)[1])]
    ordered = who[order]
    place = np.arange(len(order)) - np.searchsorted(ordered, ordered, side="left")
    order = order[place < k]
    return rows[order], who[order], exact[order]


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best finite scores, best first. Places are in the order in which ties rank, over all shards, so
    whatever ties beyond k has k better ones everywhere."""
    if k <= 0:
        return np.array([], dtype=int)
    least = np.partition(scores, -k)[-k]
    at = np.flatnonzero((scores >= least) & np.isfinite(scores))
    return at[np.argsort(-scores[at], kind="stable")][:k]


def enrich(matches: DataFrame, catalog: DataFrame, key: str = "camera_id") -> DataFrame:
    """Matches with the catalog's record, null where it has none; Spark broadcasts either side only if it is small."""
    return matches.join(catalog, key, "left")


def reference_rows(index: DataFrame) -> DataFrame:
    """One row per product: its first 'orig' variant, else its first row."""
    tag = F.coalesce(F.col("variant_tag") if "variant_tag" in index.columns else F.lit("orig"), F.lit("orig"))
    order = Window.partitionBy("camera_id").orderBy((tag != "orig").cast("int"), "row_id")
    return index.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def index_stats(index: DataFrame) -> DataFrame:
    """rows, products, dimension, rows per product (two decimals)."""
    return index.agg(
        F.count("*").alias("n_rows"), F.count_distinct("camera_id").alias("n_products"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"),
        F.coalesce(F.round(F.try_divide(F.count("*"), F.count_distinct("camera_id")), 2), F.lit(0.0)).alias("rows_per_product"),
    )
