"""Exact top-k inner products by MaxScore over shards.

Vectors become integers; a dimension is a term, and a shard's column of it the posting list, read in blocks of
rows. For one query a term adds no more than its upper bound, known from the block's extremes. The terms of
least range are non-essential as long as their bounds together, on top of the least that the essential ones
can give, stay below the k-th best score so far: no vector can enter by them alone. Essential postings are
traversed for the whole block; the others are probed, widest first, only for vectors whose score so far plus
the bounds not yet spent is still competitive. The k-th best rises from block to block, and the split with it.

A first shard of a few hundred vectors meets every query and gives each one its first k-th best score; the other
shards start from that, and blocks are as small, so the bound rises early at every size of the table. Each shard meets each block of queries once, and the lists of all are merged by one
window. Tables are dealt so that a task holds a bounded number of vectors.

Scores are exact: products are summed as doubles where no sum can reach 2**53, as 64-bit integers where none
can reach 2**63, else as Python's integers. A score beyond 64 bits is an error, as the result is a long; so is
a component whose integer is beyond them.

Defined results: vectors that are null, or hold null or non-finite components, and rows with a null vec_id
take no part; rows that share a vec_id count once, with their smallest vector; vectors of another length
than the query's are no candidates; ties go to the smaller vec_id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stage

SCALE, TOP, EVERY = 256, 5, 50
#: Vectors of the first shard, of the others and of a block of queries, on average: bounds on what a task holds.
FIRST_ROWS, SHARD_ROWS, BLOCK_ROWS = 256, 16384, 4096
#: Rows of a shard that are traversed before the k-th best is looked at again: a few at first, while it rises, then
#: twice as many each time, up to the last; terms probed at a time.
FIRST_STRIDE, STRIDE, PROBES = 256, 4096, 8
WIDTHS = (("smallint", 15), ("int", 31), ("bigint", 63))


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id and v, the integer vector floor(256 x), of rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = embeddings.select(F.col("vec_id").cast("long"), v.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(F.exists("x", bad), F.lit(True)))
    wide = lambda x: F.when(F.abs(x * SCALE) >= 2.0**63, F.raise_error(F.lit("a component is beyond 64 bits")).cast("long")).otherwise(F.floor(x * SCALE))
    ints = whole.select("vec_id", F.transform("x", wide).alias("v"))
    return ints.groupBy("vec_id").agg(F.min("v").alias("v"))


def number_type(most: int, q: np.ndarray) -> type:
    """float (exact here), np.int64 or object: what holds every sum of products of q with numbers up to most."""
    bound = most * sum(abs(int(x)) for x in q)
    return float if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


class Shard:
    """Vectors of one length in ascending vec_id order as posting lists, a row of numbers for each term, with the
    extremes of every block of vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, rows = ids[order], rows[order]
        self.postings = np.ascontiguousarray(rows.T)
        self.most = max(abs(int(rows.min(initial=0))), int(rows.max(initial=0)))
        self.blocks, at, stride = [], 0, FIRST_STRIDE
        while at < len(ids):
            self.blocks.append((at, min(at + stride, len(ids))))
            at, stride = at + stride, min(2 * stride, STRIDE)
        self.low = [rows[a:b].min(axis=0) for a, b in self.blocks]
        self.high = [rows[a:b].max(axis=0) for a, b in self.blocks]
        self.typed: dict[type, np.ndarray] = {}

    def as_type(self, kind: type) -> np.ndarray:
        if kind not in self.typed:
            self.typed[kind] = self.postings.astype(kind)
        return self.typed[kind]

    def best(self, qid: int, q: np.ndarray, k: int, floor: int | None = None) -> tuple[list[int], list[int], int]:
        """ids and scores of the k best for one query, ties to smaller ids, and the products computed. Vectors
        below floor, a score that k others are known to reach, may be left out."""
        kind = number_type(self.most, q)
        postings, q, products = self.as_type(kind), q.astype(kind), 0
        ids, scores = np.zeros(0, np.int64), np.zeros(0, kind)
        for (a, b), least, most in zip(self.blocks, self.low, self.high):
            low, high = least.astype(kind) * q, most.astype(kind) * q
            low, high = np.minimum(low, high), np.maximum(low, high)
            order = np.argsort(-(high - low), kind="stable")  # widest first
            rest = np.append(high[order][::-1].cumsum()[::-1], [0])  # upper bounds of order[i:] together
            essential = len(order)
            if floor is not None:
                # alone, on the least that the others give, the non-essential terms stay below the floor
                alone = np.append([0], low[order].cumsum()) + rest
                essential = int(np.argmax(alone < floor)) if (alone < floor).any() else len(order)
            if essential == 0:  # nothing in this block is competitive
                continue
            at = np.arange(a, b)
            first = order[:essential]
            score = q[first] @ postings[first, a:b]
            products += (b - a) * essential
            done = essential
            while done < len(order) and len(at):
                live = np.flatnonzero(score + rest[done] >= floor)
                at, score = at[live], score[live]
                probe = order[done : done + PROBES]
                score = score + q[probe] @ postings[probe[:, None], at]
                products, done = products + len(at) * len(probe), done + len(probe)
            keep = self.ids[at] != qid
            if floor is not None:
                keep &= score >= floor
            at, score = at[keep], score[keep]
            ids, scores = np.append(ids, self.ids[at]), np.append(scores, score)
            top = np.lexsort((ids, -scores))[:k] if kind is not object else np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
            ids, scores = ids[top], scores[top]
            if len(ids) == k:
                floor = scores[-1] if floor is None else max(floor, scores[-1])
        out = [int(s) for s in scores]
        if any(not -(1 << 63) <= s < 1 << 63 for s in out):
            raise OverflowError(f"a score of query {qid} is beyond 64 bits")
        return ids.tolist(), out, products


def vectors_of(table: pa.Table, column: str) -> np.ndarray:
    """The rows of a list column of one length as a matrix."""
    lists = table.column(column).combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def search_pairs(vectors: DataFrame, queries: DataFrame, shards: int, seed: int, k: int) -> DataFrame:
    """query_id, vec_id, score of the k best of each shard for each query, and for each query and shard one row
    without vec_id whose score is the number of products computed. queries: vec_id, v, block, floor."""
    slot = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(shards)).cast("int")
    blocks = queries.agg(F.max("block")).first()[0]
    left = vectors.select("vec_id", "v", slot.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks or 0))).alias("block"))
    right = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "floor", F.col("block").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def search(shard: pa.Table, block: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        for length in pc.unique(pc.list_value_length(shard.column("v"))).to_pylist():
            same = lambda t, column: t.filter(pc.equal(pc.list_value_length(t.column(column)), length))
            own, asked = same(shard, "v"), same(block, "q")
            if not asked.num_rows:
                continue
            if length:
                part = Shard(own.column("vec_id").to_numpy(), vectors_of(own, "v"))
                each = zip(asked.column("query_id").to_pylist(), vectors_of(asked, "q"), asked.column("floor").to_pylist())
                results = ((qid, *part.best(qid, q, k, floor)) for qid, q, floor in each)
            else:  # empty vectors: every score is zero
                ids = sorted(own.column("vec_id").to_pylist())[: k + 1]
                results = ((qid, (mine := [i for i in ids if i != qid][:k]), [0] * len(mine), 0) for qid in asked.column("query_id").to_pylist())
            for qid, ids, scores, products in results:
                found["query_id"] += [qid] * (len(ids) + 1)
                found["vec_id"] += [*ids, None]
                found["score"] += [*scores, products]
        return pa.table({name: pa.array(values, pa.int64()) for name, values in found.items()})

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, "query_id long, vec_id long, score long")


def shard_results(embeddings: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """search_pairs() of every shard, the first one without a floor and the others with what it gave."""
    vectors = stage(quantised(embeddings), "topk-vectors")
    largest = lambda f: f(F.transform("v", lambda x: F.when(x < 0, -(x + 1)).otherwise(x)))
    n, asked, most = vectors.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(largest(F.array_max))).first()
    narrow = next(name for name, bits in WIDTHS if (most or 0) < 1 << bits)
    vectors = vectors.withColumn("v", F.col("v").cast(f"array<{narrow}>"))
    block = F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(max(1, -(-asked // BLOCK_ROWS)))).cast("int")
    queries = vectors.where(F.col("vec_id") % every == 0).select("vec_id", "v", block.alias("block"), F.lit(None).cast("long").alias("floor"))

    early = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(max(1, -(-n // FIRST_ROWS)))) == 0
    first = stage(search_pairs(vectors.where(early), queries, 1, 1, k), "topk-first")
    floors = first.where("vec_id IS NOT NULL").groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
    known = queries.drop("floor").join(floors, queries["vec_id"] == floors["query_id"], "left").drop("query_id")
    return first.unionByName(search_pairs(vectors.where(~early), known, max(1, -(-n // SHARD_ROWS)), 1, k))


def exact_topk(embeddings: DataFrame, k: int = TOP, every: int = EVERY) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best; queries are the ids divisible by every."""
    found = shard_results(embeddings, k, every).where("vec_id IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


# Integers of any size; of repeated ids the smallest vector; null, empty and non-finite as above.
ORACLE_SQL = f"""
WITH f AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
i AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS HUGEINT)) AS q FROM f),
v AS (SELECT vec_id, min(q) AS q FROM i GROUP BY vec_id),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % {EVERY} = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
