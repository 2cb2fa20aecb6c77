"""Keyed merge of a new batch into a table: update, skip, error, or a registered strategy.

Rows carry an order column; within either side later rows of a key win in update and earlier ones in skip,
as in a concatenation of existing and new rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Strategy = Callable[[DataFrame, DataFrame, str, str], DataFrame]


class MergeConflict(ValueError):
    """New rows have keys of existing ones; keys: the first ten."""

    def __init__(self, key: str, keys: list):
        super().__init__(f"{key} in both tables, for one: {keys}")
        self.key, self.keys = key, keys


def stacked(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)), allowMissingColumns=True)


def _one_each(existing: DataFrame, new: DataFrame, key: str, order: str, last: bool) -> DataFrame:
    by = [F.desc(c) if last else F.asc(c) for c in ("__side", order)]
    ranked = stacked(existing, new).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*by)))
    return ranked.where("__n = 1").drop("__side", "__n")


def update(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    return _one_each(existing, new, key, order, last=True)


def skip(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    return _one_each(existing, new, key, order, last=False)


def conflicts(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The keys that both tables have, each once."""
    return new.select(key).distinct().join(existing.select(key), key, "left_semi")


def error(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """All rows of both sides; raises if a key is in both, with the first ten."""
    both = conflicts(existing, new, key).orderBy(key).limit(10).collect()
    if both:
        raise MergeConflict(key, [r[0] for r in both])
    return stacked(existing, new).drop("__side")


STRATEGIES: dict[str, Strategy] = {"update": update, "skip": skip, "error": error}


def register(name: str, strategy: Strategy) -> None:
    STRATEGIES[name] = strategy


def stats(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """added, common, existing_keys: distinct keys new alone, in both, and existing, in one shuffle of the keys."""
    keys = stacked(existing.select(key), new.select(key)).groupBy(key).agg(F.min("__side").alias("lo"), F.max("__side").alias("hi"))
    return keys.agg(
        F.count_if(F.col("lo") == 1).alias("added"),
        F.count_if((F.col("lo") == 0) & (F.col("hi") == 1)).alias("common"),
        F.count_if(F.col("lo") == 0).alias("existing_keys"),
    )


def merge(existing: DataFrame | None, new: DataFrame, key: str, order: str, strategy: str = "update") -> tuple[DataFrame, dict[str, int]]:
    """The merged table and its counts; without an existing table all new rows are added."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {sorted(STRATEGIES)}")
    if existing is None:
        return new, {"added": new.count(), "updated": 0, "skipped": 0}
    merged = STRATEGIES[strategy](existing, new, key, order)
    if strategy == "error":
        return merged, {"added": new.count(), "updated": 0, "skipped": 0}
    n = stats(existing, new, key).first()
    return merged, {"added": n["added"], "updated": n["common"] if strategy == "update" else 0, "skipped": n["common"] if strategy == "skip" else 0}
