"""Gradient-boosted trees fitted by DataFrame aggregates alone.

Rows are pre-aggregated to distinct feature vectors with counts, so a round costs two small aggregations
whatever the input's size. Every tree has two levels: the best split of all rows, then the best split of
each side. The driver sees one row per feature, value and side (bounded by the features' domains), picks
the splits, and the model stays a Column expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Tree:
    """feature <= at: the left leaf pair, else the right one; a pair is (feature, at, low, high) or (None, 0, w, w)."""

    feature: str
    at: int
    left: tuple
    right: tuple

    def column(self) -> Column:
        return F.when(F.col(self.feature) <= self.at, _leaf(self.left)).otherwise(_leaf(self.right))


def _leaf(pair: tuple) -> Column:
    feature, at, low, high = pair
    return F.when(F.col(feature) <= at, F.lit(low)).otherwise(F.lit(high)) if feature else F.lit(low)


def raw_score(base: float, trees: list[Tree]) -> Column:
    return reduce(lambda a, t: a + t.column(), trees, F.lit(base))


def probability(base: float, trees: list[Tree]) -> Column:
    return 1 / (1 + F.exp(-raw_score(base, trees)))


def _best_split(sums: list[tuple[str, int, float, float]], reg: float) -> tuple:
    """The best (feature, at, low weight, high weight) by gain; sums: feature, value, gradient, hessian."""
    by_feature: dict[str, list[tuple[int, float, float]]] = {}
    for feature, value, g, h in sums:
        by_feature.setdefault(feature, []).append((value, g, h))
    best, best_gain = None, 1e-6
    whole_g = whole_h = 0.0
    for feature, values in sorted(by_feature.items()):
        values.sort()
        whole_g, whole_h = sum(v[1] for v in values), sum(v[2] for v in values)
        g = h = 0.0
        for value, dg, dh in values[:-1]:
            g, h = g + dg, h + dh
            gain = g * g / (h + reg) + (whole_g - g) ** 2 / (whole_h - h + reg) - whole_g**2 / (whole_h + reg)
            if gain > best_gain:
                best, best_gain = (feature, value, g / (h + reg), (whole_g - g) / (whole_h - h + reg)), gain
    return best or (None, 0, whole_g / (whole_h + reg), whole_g / (whole_h + reg))


def fit(vectors: DataFrame, features: list[str], rounds: int = 8, rate: float = 0.5, reg: float = 1.0) -> tuple[float, list[Tree]]:
    """vectors: the features (int, ordered), label (0 or 1) and n (weight), one row per distinct vector.

    Returns the base score and the trees. Without rows of both labels there are no trees, and the base
    score says no.
    """
    both = vectors.agg(F.sum(F.col("n") * F.col("label")).alias("y"), F.sum("n").alias("n")).first()
    if not both["n"] or not 0 < both["y"] < both["n"]:
        return -10.0, []
    base, trees = 0.0, []
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in features]))
    for _ in range(rounds):
        p = probability(base, trees)
        graded = vectors.withColumns({"g": F.col("n") * (F.col("label") - p), "h": F.col("n") * p * (1 - p)})

        def sums(side: Column) -> dict[bool, list]:
            each = graded.select(side.alias("side"), "g", "h", pairs.alias("x"))
            out: dict[bool, list] = {True: [], False: []}
            for r in each.groupBy("side", "x.f", "x.v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                out[r["side"]].append((r["f"], r["v"], r["g"], r["h"]))
            return out

        feature, at, *_ = _best_split(sums(F.lit(True))[True], reg)
        if feature is None:
            break
        sides = sums(F.col(feature) <= at)
        shrunk = lambda s: (*s[:2], rate * s[2], rate * s[3])
        trees.append(Tree(feature, at, shrunk(_best_split(sides[True], reg)), shrunk(_best_split(sides[False], reg))))
    return base, trees
