"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within radius 2 share at least one value within distance 1 of both. So every distinct
fingerprint emits itself and its 64 one-bit flips, and the shuffle on these variants brings each linked
pair together. All members of a variant lie within distance 2 of one another, so linking them to the
smallest member loses no link for components, and no pairs within a group are listed: a group's members
are one 64-bit mask of flipped bits, combined map-side by bit_or.

Defined results: null and empty texts, and texts without words, have fingerprint zero and are linked like
any other; rows with a null doc_id get a fingerprint and the component of their equals, whose id counts
non-null doc_ids only (null if there is none); repeated rows are one node; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import ascii_lower, split_words, stage, unused, without
from lodestone.llm.components import component_labels

SHINGLE, BITS, RADIUS = 3, 64, 2
#: Fingerprints whose variants (65 each) one task combines before the shuffle.
EMIT_ROWS = 30_000


def shingle_hashes(docs: DataFrame) -> DataFrame:
    """docs with h: the XXH64 (seed 42, as xxhash64() has it) of every 3-word shingle; fewer words: of all."""
    words = docs.withColumn("_lower", ascii_lower(F.coalesce("text", F.lit("")))).withColumn("_words", split_words(F.col("_lower"), "\\x20\\x09-\\x0D"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_words") - SHINGLE, F.lit(0)))
    # beyond the last word there is null, which concat_ws() passes over
    hashes = F.transform(starts, lambda i: F.xxhash64(F.concat_ws(" ", *[F.get("_words", i + k) for k in range(SHINGLE)])))
    return words.withColumn("h", F.when(F.size("_words") > 0, hashes).otherwise(F.array().cast("array<bigint>"))).drop("_lower", "_words")


@F.pandas_udf(T.LongType())
def majority_bits(hashes: pd.Series) -> pd.Series:
    """Bit i is 1 if it is set in over half of a row's hashes; no hashes: zero."""

    def one(h) -> int:
        n = len(h)
        if not n:
            return 0
        bits = np.unpackbits(np.ascontiguousarray(h, dtype="<i8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > n, bitorder="little").view("<i8")[0])

    return pd.Series([one(h) for h in hashes], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the 64-bit fingerprint fp, one row per row of docs."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return shingle_hashes(own).select("doc_id", F.xxhash64("text").alias("text_hash"), majority_bits("h").alias("fp"))


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints fp; their transitive closure is that of all pairs
    within the radius. Every link is verified to be within it."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.struct(F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).alias("variant"), F.call_function("shiftleft", F.lit(1).cast("long"), i).alias("flip"), F.lit(0).alias("own")))
    itself = F.array(F.struct(F.col("fp").alias("variant"), F.lit(0).cast("long").alias("flip"), F.lit(1).alias("own")))
    tasks = max(1, -(-fps.count() // EMIT_ROWS))
    groups = (
        fps.select("fp")
        .repartition(tasks, "fp")
        .select(F.explode(F.concat(itself, flips)).alias("v"))
        .groupBy("v.variant")
        .agg(F.bit_or("v.flip").alias("flips"), F.max("v.own").alias("own"))
        .where(F.bit_count("flips") + F.col("own") > 1)
    )
    flipped = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("getbit", F.col("flips"), i) == 1)
    members = F.concat(
        F.when(F.col("own") == 1, F.array("variant")).otherwise(F.array().cast("array<bigint>")),
        F.transform(flipped, lambda i: F.col("variant").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))),
    )
    return (
        groups.select(members.alias("members"))
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
        .distinct()
    )


def _components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fingerprints() of docs, and for every distinct fp: root (one fp of its component) and component_id."""
    fps = stage(fingerprints(docs), "simhash-fps")
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    labels = component_labels(stage(near_links(nodes), "simhash-links"))
    rooted = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("root"))
    least = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    return fps, stage(rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "simhash-components")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id reachable) of every row."""
    fps, of_fp = _components(docs)
    return fps.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of its smallest doc_id (a null one counts as largest), and
    among rows that share it, that of the smallest text hash."""
    fps, of_fp = _components(docs)
    key = ["doc_id", "text_hash"]
    texts = stage(fps.join(of_fp, "fp").groupBy(*key, "root").agg(F.count("*").alias("rows")), "simhash-texts")
    # written, so that the join reads two plain tables and the rows of a large component can be split
    first = stage(texts.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), *key)).alias("first")), "simhash-first")
    others = texts.join(first, "root").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))))
    kept = without(docs, others)
    if texts.where("rows > 1").isEmpty():  # no row is repeated
        return kept
    text_hash = unused(kept, "text_hash")
    return kept.withColumn(text_hash, F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", text_hash]).drop(text_hash)
