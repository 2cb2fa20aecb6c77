"""Document quality: kernel ridge by random Fourier features, then isotonic calibration.

One pass turns each text into statistics of its shape (lengths, letter case, symbols, repetition, lines).
Random Fourier features of the standardised statistics approximate a Gaussian kernel. Every partition of
labelled rows sums its part of the normal equations, the parts are added by a shuffle, and the driver
solves one system of FEATURES unknowns. A further fold calibrates: scores in fixed bins, pooled to a
monotone step function, joined by straight lines.

Defined results: null and empty texts have the statistics of an empty text and are scored like any other;
without usable labels of both classes all scores are the share of good labels (1 if there are none, so
nothing is rejected); a null doc_id is not held out and has no label; rows are scored row by row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stage, without
from lodestone.llm.tokens import slices
from lodestone.llm.toxicity import fold

FEATURES, RIDGE, SCALE = 160, 1e-3, 3.0
FOLDS, HELD_OUT, CALIBRATE, THRESHOLD = 5, 0, 1, 0.3
#: Bins of the raw score on [-0.5, 1.5].
BINS = 400

STATS = 18
SENTENCE = re.compile(r"[.!?]+(?:\s|$)")
SYMBOLS = str.maketrans("", "", "#$%&*@^~|<>=+\\/_{}[]")


def statistics(text: str | None) -> list[float]:
    text = text or ""
    n = max(len(text), 1)
    words = text.split()
    k = max(len(words), 1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    once = len(set(lines))
    letters = sum(map(len, words))
    plain = len(text.translate(SYMBOLS))
    upper = sum(map(str.isupper, words))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [
        np.log1p(len(text)), np.log1p(len(words)), letters / k, upper / k, (len(text) - plain) / n, text.count("!") / k, text.count("|") / k,
        text.count(",") / k, text.count(".") / k, sum(map(text.count, "0123456789")) / n, len(counts) / k, max(counts.values(), default=0) / k,
        repeats / k, np.log1p(len(lines)), 1 - once / max(len(lines), 1), len(words) / max(len(lines), 1) / 50, len(SENTENCE.findall(text)) / k, sum(map(str.istitle, words)) / k,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, fold, stats (array of doubles) of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            stats = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(stats, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "stats"])

    own = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), fold(FOLDS).cast("int").alias("fold"), F.col("text").cast("string"))
    return own.mapInArrow(measure, "doc_id long, text_hash long, fold int, stats array<double>")


class Fourier:
    """Random Fourier features of standardised statistics, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(11)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(0, 1 / SCALE, (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -5, 5)
        return np.hstack([np.cos(x @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, STATS)


def normal_equations(rows: DataFrame, fourier: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over rows (label, stats): summed in each partition, then by a shuffle; FEATURES squared numbers in all."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                z = fourier(_matrix(batch.column("stats")))
                total += z.T @ np.hstack([z, np.asarray(batch.column("label"), dtype=np.float64)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    parts = rows.select("label", "stats").mapInArrow(partial, "i int, row array<double>")
    summed = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    total[summed["i"], summed["j"]] = summed["x"]
    return total[:, :-1], total[:, -1]


def pooled(bins: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (centre, count, sum of labels) by centre; returns knots x and monotone y."""
    blocks: list[list[float]] = []
    for centre, n, total in sorted(bins):
        blocks.append([centre * n, n, total])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    # a pinch of each class keeps small blocks from certainty
    return np.array([b[0] / b[1] for b in blocks]), np.array([(b[2] + 0.02) / (b[1] + 0.04) for b in blocks])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_hash, held_out, score, predicted of every row of docs."""
    stats = stage(with_statistics(docs), "quality-stats")
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1))
    labelled = stats.where(F.col("fold") != HELD_OUT).join(known, "doc_id").select("fold", "label", "stats")
    fit, calibrate = labelled.where(F.col("fold") != CALIBRATE), labelled.where(F.col("fold") == CALIBRATE)
    moments = fit.select("label", F.posexplode("stats").alias("j", "x")).groupBy("j").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.avg("label").alias("y")).collect()
    share = moments[0]["y"] if moments else 1.0
    fourier = beta = None
    knots = (np.array([0.0]), np.array([share]))
    if 0 < share < 1:
        moments.sort(key=lambda r: r["j"])
        fourier = Fourier(np.array([r["m"] for r in moments]), np.array([r["s"] for r in moments]))
        a, b = normal_equations(fit, fourier)
        beta = np.linalg.solve(a + RIDGE * np.eye(len(a)) * a[-1, -1], b)
    raw_of = lambda matrix: fourier(matrix) @ beta if beta is not None else np.zeros(len(matrix))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(raw_of(_matrix(batch.column("stats"))), pa.float64())], names=["label", "raw"])

    if beta is not None:
        bin_of = F.floor((F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.4999)) + 0.5) / 2 * BINS)
        binned = calibrate.select("label", "stats").mapInArrow(raw, "label int, raw double").groupBy(bin_of.alias("bin")).agg(F.avg("raw").alias("x"), F.count("*").alias("n"), F.sum("label").alias("y")).collect()
        if binned:
            knots = pooled([(r["x"], r["n"], r["y"]) for r in binned])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = np.clip(np.interp(raw_of(_matrix(batch.column("stats"))), *knots), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), batch.column("fold"), pa.array(value, pa.float64())], names=["doc_id", "text_hash", "fold", "score"])

    scored = stats.mapInArrow(score, "doc_id long, text_hash long, fold int, score double")
    return scored.select("doc_id", "text_hash", (F.col("fold") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the classifier rejects."""
    return without(docs, quality_scores(docs, labels).where(F.col("predicted") == 0))
