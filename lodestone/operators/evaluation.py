"""How often retrieval finds the right product: a grid of degradations, or a list of labelled probes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import vectors

# The augmentation recipes in order.
RECIPES = [("perspective_warp", 1), ("blur", 1), ("lighting", 1), ("small_scale", 1), ("jpeg_compression", 1), ("background_swap", 1), ("perspective_warp", 2), ("lighting", 2)]


def recipes(k: int) -> list[tuple[str, int]]:
    if not 1 <= k <= len(RECIPES):
        raise ValueError(f"k must be between 1 and {len(RECIPES)}")
    return RECIPES[:k]


def uniform(key: Column, place: Column, which: int) -> Column:
    """A number in (0, 1) that depends on nothing but its key, place and which of the place's numbers it is: 48 bits of
    an MD5 that any engine can repeat."""
    digits = F.substring(F.md5(F.concat_ws("|", key, place.cast("string")).cast("binary")), 1 + 12 * which, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal(key: Column, place: Column) -> Column:
    """A normally distributed number of the same kind, from two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(key, place, 0))) * F.cos(2 * math.pi * uniform(key, place, 1))


def _noise(width: float) -> Degradation:
    return lambda v, severity, key: F.transform(v, lambda x, i: x + normal(key, i) * width * severity)


Degradation = Callable[[Column, Column, Column], Column]
#: Degradations of a vector, as expressions of it, the severity and a key. Images need their own, registered alike.
DEGRADATIONS: dict[str, Degradation] = {
    "noise": _noise(0.05),
    "strong_noise": _noise(0.2),
    "cut": lambda v, severity, key: F.transform(v, lambda x, i: F.when(i < 8 * severity, 0.0).otherwise(x)),
    "mask": lambda v, severity, key: F.transform(v, lambda x, i: F.when(uniform(key, i, 0) < 0.1 * severity, 0.0).otherwise(x)),
}


def degradation_grid(rows: DataFrame, names: list[str], severities: list[int]) -> DataFrame:
    """rows with degradation and severity, once for each of the (few, literal) cells."""
    cells = F.array(*[F.struct(F.lit(n).alias("degradation"), F.lit(s).alias("severity")) for n in names for s in severities])
    return rows.select("*", F.explode(cells).alias("cell")).select(*rows.columns, "cell.degradation", "cell.severity")


def degraded(grid: DataFrame, seed: int = 42) -> DataFrame:
    """grid with embedding degraded by its cell; what is random comes from the seed, the row's id, the name and the
    severity, so it doesn't depend on partitions."""
    v, severity = F.col("embedding").cast("array<double>"), F.col("severity")
    key = F.concat_ws("|", F.lit(str(seed)), F.col("row_id").cast("string"), "degradation", severity.cast("string"))
    cells = [F.when(F.col("degradation") == name, change(v, severity, key)) for name, change in DEGRADATIONS.items()]
    return grid.withColumn("embedding", F.coalesce(*cells))


def recall(asked: DataFrame, matches: DataFrame, *group: str) -> DataFrame:
    """group, n, top1_hits, top5_hits and rates (four decimals; 0 without queries).

    asked: query_id, truth, group columns; matches: query_id, rank, camera_id.
    """
    best = matches.join(asked.select("query_id", "truth"), "query_id").where(F.col("camera_id") == F.col("truth")).groupBy("query_id").agg(F.min("rank").alias("found"))
    joined = asked.join(best, "query_id", "left")
    counts = joined.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("found") == 1, F.lit(False))).alias("top1_hits"), F.count_if(F.coalesce(F.col("found") <= 5, F.lit(False))).alias("top5_hits"))
    rate = lambda c: F.bround(F.coalesce(F.try_divide(c, "n"), F.lit(0.0)), 4)
    return counts.withColumns({"top1_rate": rate("top1_hits"), "top5_rate": rate("top5_hits")})


def synthetic(index: DataFrame, names: list[str], severities: list[int], seed: int = 42, limit: int | None = None) -> DataFrame:
    """Recovery of each product from its degraded reference row, by degradation and severity."""
    rows = vectors.reference_rows(index)
    rows = rows.orderBy("row_id").limit(limit) if limit else rows
    grid = degraded(degradation_grid(rows.select("row_id", "camera_id", "embedding"), names, severities), seed)
    asked = grid.withColumn("query_id", F.concat_ws("|", F.col("row_id").cast("string"), "degradation", F.col("severity").cast("string")))
    matches = vectors.search(asked.select("query_id", "embedding"), index.withColumn("row_id", F.col("row_id").cast("string")), 5)
    return recall(asked.select("query_id", F.col("camera_id").alias("truth"), F.col("degradation").alias("group"), "severity"), matches, "group", "severity").orderBy("group", "severity")  # one row of each cell


def probe(probes: DataFrame, index: DataFrame) -> tuple[DataFrame, int]:
    """Recall by vendor of labelled probes (image, camera_id, vendor, embedding), and how many had no embedding."""
    usable = probes.where(F.col("embedding").isNotNull()).withColumn("query_id", F.col("image"))
    matches = vectors.search(usable.select("query_id", "embedding"), index.withColumn("row_id", F.col("row_id").cast("string")), 5)
    asked = usable.select("query_id", F.col("camera_id").alias("truth"), F.coalesce("vendor", F.lit("unknown")).alias("group"), F.lit(0).alias("severity"))
    return recall(asked, matches, "group", "severity"), probes.where(F.col("embedding").isNull()).count()


def format_summary(rows: list, title: str) -> str:
    lines = [title, f"{'group':24}{'severity':>9}{'n':>8}{'top-1':>9}{'top-5':>9}"]
    return "\n".join(lines + [f"{r['group']:24}{r['severity']:>9}{r['n']:>8}{r['top1_rate']:>9.4f}{r['top5_rate']:>9.4f}" for r in rows])
