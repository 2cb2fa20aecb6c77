"""Detections to catalog entries: crop boxes, an injected embedder, search, threshold, records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import geometry
from lodestone.operators import vectors

MARGIN, CONFIDENCE, SIMILARITY = 0.1, 0.25, 0.3


def crop_boxes(detections: DataFrame, margin: float = MARGIN, confidence: float = CONFIDENCE, keep_degenerate: bool = False) -> DataFrame:
    """detections (detection_id, x_min, y_min, x_max, y_max, confidence, width, height, ...) of enough confidence,
    with box: rounded, expanded, clamped to the image. Boxes without an area go, or stay with degenerate set."""
    raw = geometry.box(*(F.col(c) for c in ("x_min", "y_min", "x_max", "y_max")))
    kept = detections.where(F.col("confidence") >= confidence).withColumn("box", geometry.clamp(geometry.expand(raw, margin), F.col("width"), F.col("height")))
    kept = kept.withColumn("degenerate", ~geometry.valid(F.col("box")))
    return kept if keep_degenerate else kept.where(~F.col("degenerate")).drop("degenerate")


def detected(images: DataFrame, detect: Callable[[pd.Series], list]) -> DataFrame:
    """detection_id (image_id#n), image_id, content, the box, confidence, width and height of every detection.

    images: image_id, content (bytes, or whatever the detector takes). detect(contents), once per batch, gives for
    each image its width, height and a list of (x_min, y_min, x_max, y_max, confidence); None for an image that
    can't be read, which then has no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in images.schema}
    names = ["x_min", "y_min", "x_max", "y_max", "confidence"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, content, found in zip(pdf["image_id"], pdf["content"], detect(pdf["content"])):
                if found is not None:
                    width, height, boxes = found
                    rows += [(f"{key}#{n}", key, content, *map(float, box), width, height) for n, box in enumerate(boxes)]
            yield pd.DataFrame(rows, columns=["detection_id", "image_id", "content", *names, "width", "height"])

    return images.select("image_id", "content").mapInPandas(run, f"detection_id string, image_id {kinds['image_id']}, content {kinds['content']}, " + ", ".join(f"{n} double" for n in names) + ", width int, height int")


def embedded(boxes: DataFrame, embed: Callable[[pd.Series, pd.Series], list]) -> DataFrame:
    """detection_id and embedding of each box, by embed(contents, boxes) once per batch; None is left out."""
    kind = boxes.schema["detection_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame({"detection_id": pdf["detection_id"], "embedding": list(embed(pdf["content"], pdf["box"]))})
            yield out[out["embedding"].notna()]

    return boxes.select("detection_id", "content", "box").mapInPandas(run, f"detection_id {kind}, embedding array<double>")


def identify(detections: DataFrame, embed: Callable, index: DataFrame, catalog: DataFrame, k: int = 5, similarity: float = SIMILARITY, keep_degenerate: bool = False, **boxes) -> DataFrame:
    """One row per detection kept: its columns (but content), box, and matches, an array of struct(rank,
    camera_id, score, record) by rank; empty where nothing is similar enough, or the box has no area."""
    cropped = crop_boxes(detections, keep_degenerate=keep_degenerate, **boxes)
    usable = cropped.where(~F.col("degenerate")) if keep_degenerate else cropped
    asked = embedded(usable, embed).withColumnRenamed("detection_id", "query_id")
    records = catalog.select("camera_id", F.struct(*[c for c in catalog.columns if c != "camera_id"]).alias("record"))
    matches = vectors.enrich(vectors.search(asked, index, k, threshold=similarity), records)
    one = F.struct("rank", "camera_id", "score", "record")
    per = matches.groupBy(F.col("query_id").alias("detection_id")).agg(F.sort_array(F.collect_list(one)).alias("matches"))  # at most k
    joined = cropped.drop("content").join(per, "detection_id", "left")
    return joined.withColumn("matches", F.coalesce("matches", F.array().cast(per.schema["matches"].dataType)))


def metadata(identified: DataFrame) -> DataFrame:
    """detection_id and metadata, JSON for a client: confidence and scores at two decimals."""
    box = F.array(*[F.col(f"box.{c}") for c in ("x_min", "y_min", "x_max", "y_max")])
    matches = F.transform("matches", lambda m: F.struct(m["camera_id"].alias("camera_id"), F.round(m["score"], 2).alias("score")))
    return identified.select("detection_id", F.to_json(F.struct(box.alias("bbox"), F.round("confidence", 2).alias("confidence"), matches.alias("matches"))).alias("metadata"))
