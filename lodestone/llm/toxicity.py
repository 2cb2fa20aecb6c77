"""Toxicity by a factorization machine over hashed terms.

A document is the set of hashed buckets of its words and of their five-letter beginnings. On a bounded
sample of labelled rows, buckets are counted by class on the cluster. Those whose log-odds between the classes
stand out most are kept, and beside them the most frequent ones of toxic documents: these may tell nothing
alone, but where a pair of terms is toxic, both are in many toxic documents. A logistic factorization machine
learns a weight for each and a factor vector whose inner products are the pairwise interactions. Every whole
text is scored in its own partition with the small model.

How many terms of either sort the machine gets and how long it learns is chosen on folds of the sample: for each
fold terms are chosen and machines fitted without it, and what errs least on the folds is fitted to all of it. With few
labels few terms are right; with all buckets the machine learns by heart (figures in the README).

The driver sees at most POSITIVES + NEGATIVES rows, the sample's bound after the join with the documents, each
with no more numbers than the model has terms.

Defined results: null, empty and wordless texts get the model's intercept as score; without any usable
label of either class the score of all is the share of toxic labels (0 if none); a null doc_id is not
held out and has no label; labels of repeated doc_ids all count; repeated rows are scored row by row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stage
from lodestone.llm.tokens import slices

BUCKETS, PREFIX = 1 << 20, 5
#: Bounds of the training sample (rows of each class), and factors. LEAST: rows of the sample that a term must be in.
POSITIVES, NEGATIVES, FACTORS, LEAST = 2500, 5000, 4, 4
#: What is chosen from: how many terms that stand out, how many that are frequent in toxic documents; steps of
#: learning. PARTS: folds of the sample on which it is chosen.
SIZES, STEPS, PARTS = ((128, 128), (512, 128), (2048, 1024)), (40, 120), 3
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Words whose buckets a worker remembers; beyond, it starts anew.
REMEMBERED = 400_000

WORD = re.compile(r"[^\W\d_]+")
_buckets: dict[str, tuple[int, int]] = {}


def word_buckets(word: str) -> tuple[int, int]:
    found = _buckets.get(word)
    if found is None:
        if len(_buckets) >= REMEMBERED:
            _buckets.clear()
        found = _buckets[word] = (zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS, zlib.crc32(f"{word[:PREFIX]}*".encode("utf-8", "surrogatepass")) % BUCKETS)
    return found


def buckets_of(text: str | None) -> set[int]:
    out: set[int] = set()
    for word in set(WORD.findall((text or "").lower())):
        out.update(word_buckets(word))
    return out


def fold(folds: int) -> Column:
    """crc32 of the doc_id as text, modulo folds; -1 without a doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, bounds: dict[int, int], usable: Column) -> DataFrame:
    """doc_id, label, text of at most bounds[label] usable rows of each label, the first by a hash of doc_id.
    Repeated doc_ids, on either side, don't lift the bounds: of the joined rows the first ones stay, again."""
    pool = labels.select(F.col("doc_id").cast("long"), F.col(column).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & usable)
    first = lambda df, n, *ties: df.orderBy(F.xxhash64("doc_id"), "doc_id", *ties).limit(n)
    parts = [first(pool.where(F.col("label") == y), n) for y, n in bounds.items()]
    picked = F.broadcast(parts[0].unionByName(parts[1]))  # bounded by the limits
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    met = stage(own.join(picked, "doc_id").select("doc_id", "label", "text"), "labelled")
    kept = [first(met.where(F.col("label") == y), n, F.xxhash64("text")) for y, n in bounds.items()]
    if all(r["count"] <= bounds[r["label"]] for r in met.groupBy("label").count().collect()):  # one row for each label
        return met
    return kept[0].unionByName(kept[1])


@dataclass
class Machine:
    terms: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, buckets: set[int]) -> float:
        at = [self.terms[b] for b in self.terms.keys() & buckets]
        z = self.bias
        if at:
            v = self.factors[at]
            z += self.weights[at].sum() + 0.5 * float((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def intercept_only(share: float) -> Machine:
    p = min(max(share, 1e-9), 1 - 1e-9)
    return Machine({}, float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, FACTORS)))


def standing_out(positive: Column, negative: Column, n1: float, n0: float) -> Column:
    """How far a term's log-odds between the classes stand out, by its rows in each and all rows of each."""
    a, b = positive + 0.5, negative + 0.5
    odds = F.log(a / (n1 + 1.5 - a)) - F.log(b / (n0 + 1.5 - b))
    return F.abs(odds) / F.sqrt(1 / a + 1 / b)


def fit_machines(rows: list[tuple[int, list[int]]], prior: float, steps: tuple[int, ...], rate: float = 0.05, l2: float = 1e-5) -> list[Machine]:
    """The machine after each of these (ascending) numbers of steps. rows: (label, buckets). prior: the share of label 1
    among all labels, to which the sample is weighted."""
    y = np.array([label for label, _ in rows], dtype=np.float32)
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return [intercept_only(prior)] * len(steps)
    flat = np.concatenate([np.asarray(b, dtype=np.int64) for _, b in rows])
    owner = np.repeat(np.arange(len(rows)), [len(b) for _, b in rows])
    buckets, at = np.unique(flat, return_inverse=True)
    x = np.zeros((len(rows), len(buckets)), dtype=np.float32)
    x[owner, at] = 1
    rng = np.random.default_rng(7)
    prior = min(max(prior, 1e-4), 1 - 1e-4)
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share)).astype(np.float32) / len(y)
    params = [np.float32(np.log(prior / (1 - prior))).reshape(1), np.zeros(len(buckets), np.float32), rng.normal(0, 0.05, (len(buckets), FACTORS)).astype(np.float32)]
    found, terms = [], {int(b): i for i, b in enumerate(buckets)}
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps[-1] + 1):
        bias, w, v = params
        xv = x @ v
        z = bias + x @ w + 0.5 * ((xv**2).sum(axis=1) - x @ (v**2).sum(axis=1))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grads = [g.sum().reshape(1), x.T @ g + l2 * w, x.T @ (g[:, None] * xv) - v * (x.T @ g)[:, None] + l2 * v]
        for i, grad in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * grad
            s[i] = 0.99 * s[i] + 0.01 * grad**2
            params[i] = params[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-7)
        if step in steps:
            found.append(Machine(terms, float(params[0][0]), params[1].astype(np.float64), params[2].astype(np.float64)))
    return found


def fit_machine(rows: list[tuple[int, list[int]]], prior: float, steps: int = 120) -> Machine:
    return fit_machines(rows, prior, (steps,))[0]


def loss(machine: Machine, rows: list[tuple[int, list[int]]], prior: float) -> float:
    """The mean logarithmic loss, with both classes weighted to the prior."""
    each = {1: [], 0: []}
    for label, buckets in rows:
        p = min(max(machine.score(set(buckets)), 1e-6), 1 - 1e-6)
        each[label].append(-np.log(p if label else 1 - p))
    return float(prior * np.mean(each[1]) + (1 - prior) * np.mean(each[0]))


def choose(rows: list[tuple[int, int, set[int]]], terms: list[list[set[int]]], prior: float) -> tuple[int, int]:
    """Which of SIZES and which of STEPS errs least over the parts. rows: (part, label, buckets); terms[part][size]."""
    total = np.zeros((len(SIZES), len(STEPS)))
    for part in range(PARTS):
        other, own = [r[1:] for r in rows if r[0] != part], [r[1:] for r in rows if r[0] == part]
        if len({y for y, _ in own}) == 2 == len({y for y, _ in other}):
            for i, kept in enumerate(terms[part]):
                machines = fit_machines([(y, sorted(b & kept)) for y, b in other], prior, STEPS)
                total[i] += [loss(m, own, prior) for m in machines]
    return divmod(int(total.argmin()), len(STEPS))


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> Machine:
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sorted(buckets_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "label", "buckets"])

    sample = labelled_sample(docs, labels, "toxic", {1: POSITIVES, 0: NEGATIVES}, usable)
    rows = stage(sample.mapInArrow(terms, "doc_id long, label int, buckets array<int>"), "toxicity-sample")
    prior = float(labels.where(usable & F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0] or 0.0)
    n1, n0 = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not n1 or not n0:
        return intercept_only(prior)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    in_part = [F.count_if((F.col("label") == y) & (F.col("part") == k)).alias(f"{name}{k}") for y, name in ((1, "a"), (0, "b")) for k in range(PARTS)]
    rows = rows.withColumn("part", part)
    every = lambda name, but=-1: sum((F.col(f"{name}{k}") for k in range(PARTS) if k != but), F.lit(0))
    counts = stage(rows.select("label", "part", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(*in_part).where(every("a") + every("b") >= LEAST), "toxicity-terms")
    of_part = {r["part"]: (r["n1"], r["n0"]) for r in rows.groupBy("part").agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0")).collect()}  # PARTS rows

    def terms_of(but: int) -> list[set[int]]:
        """The terms of each of SIZES, chosen without one part."""
        m1, m0 = (sum(n[i] for k, n in of_part.items() if k != but) for i in range(2))
        known = counts.where(every("a", but) + every("b", but) >= LEAST)
        first = lambda df, n, order: [r["bucket"] for r in df.orderBy(F.desc(order), "bucket").limit(n).collect()]
        telling = first(known, max(n for n, _ in SIZES), standing_out(every("a", but), every("b", but), m1, m0))
        frequent = first(known.where(every("a", but) > 0), max(n for _, n in SIZES), every("a", but))
        return [{*telling[:n], *frequent[:k]} for n, k in SIZES]

    terms = [terms_of(k) for k in [*range(PARTS), -1]]
    chosen = set().union(*(t for sizes in terms for t in sizes))
    kept = F.array_intersect("buckets", F.expr(f"cast(array({', '.join(map(str, sorted(chosen)))}) as array<int>)"))
    fitted = rows.select("doc_id", "label", "part", kept.alias("buckets")).toPandas().sort_values("doc_id", kind="stable")
    sample = [(k, y, set(map(int, b))) for k, y, b in zip(fitted["part"], fitted["label"], fitted["buckets"])]
    size, steps = choose(sample, terms[:PARTS], prior)
    return fit_machine([(y, sorted(b & terms[PARTS][size])) for _, y, b in sample], prior, STEPS[steps])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    usable = fold(FOLDS) != HELD_OUT
    machine = train(docs, labels, usable)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [machine.score(buckets_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    own = docs.select(F.col("doc_id").cast("long"), (fold(FOLDS) == HELD_OUT).alias("held_out"), F.col("text").cast("string"))
    scored = own.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
