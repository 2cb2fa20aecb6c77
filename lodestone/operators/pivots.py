"""Exact cosine search that skips what a bound rules out: index rows lie in cells around pivots, and queries visit cells.

Angles are a metric, so a row of a cell is at least as far from a query as the query's angle to the pivot is outside
of the ring that the cell's rows lie in. Every query first visits the cells with the highest bounds; its k-th best
product there is what the bound of any other cell must reach for a visit. Rows are the same as vectors.search()
gives. Vectors without any structure have wide rings, and then all cells are visited.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import vectors as V
from lodestone.operators.vectors import QUERY_BLOCK, SHARD_ROWS, best, scored
from lodestone.sources.shared import written

#: Cells at most; rows that a first visit sees for each result asked for; what rounding may take from a bound.
CELLS, FIRST, SLACK = 256, 8, 1e-9


class PivotIndex:
    """A vector index (row_id, camera_id, embedding) in cells, below a path that all machines see.

    build() makes it: pivots are the rows with the smallest hashes of their ids, so that any partitioning gives the same ones;
    as many as the root of the number of rows, CELLS at most, unless cells says otherwise.
    A cell is kept in shards of a bounded size, however many rows it has. A null vector is in no cell and is never
    found; a zero vector scores zero, as elsewhere. To search centred, centre the index first, and the queries alike.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.visited: list[DataFrame] = []  # of the last search: query_id, cell, n for each visit

    @classmethod
    def build(cls, index: DataFrame, path: str, cells: int = 0) -> PivotIndex:
        spark = index.sparkSession
        cells = cells or min(CELLS, 1 + math.isqrt(index.count()))
        rows = index.where(F.col("embedding").isNotNull()).select("row_id", "camera_id", V.doubles(F.col("embedding")).alias("embedding"))
        rows = rows.withColumn("norm", V.norm(F.col("embedding")))
        chosen = rows.where("norm > 0").orderBy(F.xxhash64("row_id"), "row_id").limit(cells)  # as many as cells
        spark.createDataFrame(chosen.select("embedding").collect(), "embedding array<double>").coalesce(1).withColumn("cell", F.monotonically_increasing_id().cast("int")).write.parquet(f"{path}/pivots")
        self = cls(spark, path)
        pivots = self._pivots()

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                angles = _angles(np.array(pdf["embedding"].tolist()), pdf["norm"].to_numpy(), pivots) if len(pdf) and len(pivots) else np.zeros((len(pdf), 1))
                cell = angles.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), angle=np.where(pdf["norm"] > 0, angles[np.arange(len(pdf)), cell], np.nan))

        placed = written(rows.mapInPandas(place, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema] + [T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])), "placed")
        stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("norm").alias("shortest"), F.max("norm").alias("longest"))
        stats.coalesce(1).write.parquet(f"{path}/cells")  # a row for each cell
        shards = F.coalesce(*[F.when(F.col("cell") == c["cell"], F.lit(-(-c["n"] // SHARD_ROWS))) for c in self._cells().to_dict("records") if c["n"] > SHARD_ROWS], F.lit(1))
        dealt = placed.withColumn("shard", F.pmod(F.xxhash64("row_id"), shards.cast("long")))
        dealt.select("row_id", "camera_id", "embedding", "shard", "cell").repartition("cell", "shard").write.partitionBy("cell").parquet(f"{path}/rows")
        spark.createDataFrame([], dealt.select("row_id", "camera_id", "embedding", "shard", "cell").schema).write.parquet(f"{path}/layout")
        return self

    def _pivots(self) -> np.ndarray:
        at = [r["embedding"] for r in self.spark.read.parquet(f"{self.path}/pivots").orderBy("cell").collect()]
        matrix = np.array(at) if at else np.zeros((0, 0))
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True) if len(matrix) else matrix

    def _cells(self) -> pd.DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").toPandas()

    def search(self, queries: DataFrame, k: int = 5, threshold: float | None = None, collapse: bool = True, exclude_self: bool = False) -> DataFrame:
        """What vectors.search() gives for the same index and arguments."""
        q = queries.select("query_id", V.unit(V.doubles(F.col("embedding"))).alias("embedding"))
        first = self._visits(q.withColumn("least", F.lit(None).cast("double")), k, others=False)
        found = written(best(self._met(first, k, collapse, exclude_self), k, collapse), "found")
        least = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        second = self._visits(q.join(least, "query_id", "left"), k, others=True)
        self.visited = [d.select("query_id", "cell", "n") for d in (first, second)]
        ranked = best(found.drop("rank").unionByName(self._met(second, k, collapse, exclude_self)), k, collapse)
        return ranked if threshold is None else ranked.where(F.col("score") >= threshold)

    def products(self) -> int:
        """Products of a query and a row that the last search computed."""
        return self.visited[0].unionByName(self.visited[1]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def _visits(self, asked: DataFrame, k: int, others: bool) -> DataFrame:
        """query_id, embedding, cell, n: the cells that a query visits first, or the others whose bound reaches least."""
        pivots, cells = self._pivots(), self._cells()

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if pdf.empty or cells.empty:
                    continue
                bounds = _bounds(np.array(pdf["embedding"].tolist()), pivots, cells)
                order = np.argsort(-bounds, axis=1, kind="stable")
                n = cells["n"].to_numpy()
                early = np.zeros(bounds.shape, bool)
                np.put_along_axis(early, order, np.cumsum(n[order], axis=1) - n[order] < FIRST * k, axis=1)
                least = pdf["least"].fillna(-np.inf).to_numpy(dtype=float)
                who, where = np.nonzero(~early & (bounds >= least[:, None] - SLACK) if others else early)
                yield pd.DataFrame({"query_id": pdf["query_id"].to_numpy()[who], "embedding": pdf["embedding"].to_numpy()[who], "cell": cells["cell"].to_numpy()[where].astype("int32"), "n": n[where]})

        kind = asked.schema["query_id"].dataType.simpleString()
        return asked.mapInPandas(run, f"query_id {kind}, embedding array<double>, cell int, n long")

    def _met(self, visits: DataFrame, k: int, collapse: bool, exclude_self: bool) -> DataFrame:
        """The k best of each query and shard of the cells that it visits; rows of cells without visits aren't read."""
        visits = written(visits, "visits")
        per = visits.groupBy("cell").agg(F.count("*").alias("asked"), F.first("n").alias("n")).collect()  # a row for each cell
        rows = self.spark.read.schema(self.spark.read.parquet(f"{self.path}/layout").schema).parquet(f"{self.path}/rows").where(F.col("cell").isin([r["cell"] for r in per]) if per else F.lit(False))
        # shards and blocks of each cell, as expressions: only the few cells with more than one are named
        many = lambda column, size: F.coalesce(*[F.when(F.col("cell") == r["cell"], F.lit(-(-r[column] // size))) for r in per if r[column] > size], F.lit(1)).cast("long")
        shards, blocks = many("n", SHARD_ROWS), many("asked", QUERY_BLOCK)
        left = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        right = visits.withColumns({"block": F.pmod(F.xxhash64("query_id"), blocks), "shard": F.explode(F.sequence(F.lit(0).cast("long"), shards - 1))})
        shard = F.col("cell") * F.lit(1 << 40) + F.col("shard")  # one number for both
        return scored(left.withColumn("shard", shard), right.withColumn("shard", shard), k, collapse, exclude_self)


def _angles(vectors: np.ndarray, norms: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    if vectors.shape[1] != pivots.shape[1]:
        raise ValueError(f"vectors have {vectors.shape[1]} dimensions, the pivots {pivots.shape[1]}")
    return np.arccos(np.clip(vectors @ pivots.T / np.where(norms > 0, norms, 1.0)[:, None], -1.0, 1.0))


def _bounds(queries: np.ndarray, pivots: np.ndarray, cells: pd.DataFrame) -> np.ndarray:
    """The highest product that a row of each cell (columns) can have with each query (rows, of length one)."""
    if not len(pivots):
        return np.zeros((len(queries), len(cells)))  # zero vectors only
    angles = _angles(queries, np.ones(len(queries)), pivots)[:, cells["cell"].to_numpy()]
    low, high = (cells[c].to_numpy(dtype=float) for c in ("low", "high"))
    # Angles near zero are only as exact as the root of a double's precision.
    apart = np.clip(np.fmax(angles - high, low - angles) - 1e-7, 0.0, np.pi)
    cosine = np.cos(np.nan_to_num(apart))
    return np.where(cosine >= 0, cosine * cells["longest"].to_numpy(), cosine * cells["shortest"].to_numpy())
