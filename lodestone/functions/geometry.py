"""Boxes: expand, clamp, check. A box is struct<x_min, y_min, x_max, y_max>, its maxima exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    """Corners rounded half to even."""
    whole = lambda c: F.bround(c.cast("double"), 0).cast("int")
    return F.struct(whole(x_min).alias("x_min"), whole(y_min).alias("y_min"), whole(x_max).alias("x_max"), whole(y_max).alias("y_max"))


def expand(b: Column, margin: float) -> Column:
    """Each side moves out by margin times the box's extent on its axis, rounded half to even."""
    dx = F.bround((b["x_max"] - b["x_min"]) * F.lit(margin), 0).cast("int")
    dy = F.bround((b["y_max"] - b["y_min"]) * F.lit(margin), 0).cast("int")
    return F.struct((b["x_min"] - dx).alias("x_min"), (b["y_min"] - dy).alias("y_min"), (b["x_max"] + dx).alias("x_max"), (b["y_max"] + dy).alias("y_max"))


def clamp(b: Column, width: Column, height: Column) -> Column:
    within = lambda c, most: F.greatest(F.lit(0), F.least(c, most))
    return F.struct(within(b["x_min"], width).alias("x_min"), within(b["y_min"], height).alias("y_min"), within(b["x_max"], width).alias("x_max"), within(b["y_max"], height).alias("y_max"))


def annotation_scale(height: Column, reference: float = 480.0) -> Column:
    """How much larger lines and letters are drawn on a frame of this height; never smaller."""
    return F.greatest(F.lit(1.0), height / F.lit(reference))


def jpeg_quality(quality: Column) -> Column:
    """Within 1 and 100."""
    return F.greatest(F.lit(1), F.least(F.lit(100), quality))


def valid(b: Column) -> Column:
    return (b["x_max"] > b["x_min"]) & (b["y_max"] > b["y_min"])
