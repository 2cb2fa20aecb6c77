"""What several operators share: tables, cutting lineage, lower-casing, word arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and a lost executor costs no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """name, or name with more underscores, such that df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. lower() would change letters beyond ASCII too, so it serves pure ASCII texts."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """The maximal runs of characters outside a class such as [ \\t]; null and empty texts have none.

    separators: the inside of a regex class. Empty strings that split() leaves at either end are cut off
    by position, so no function runs once per word.
    """
    parts = F.split(F.coalesce(text, F.lit("")), f"[{separators}]+")
    head = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    tail = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, head + 1, F.size(parts) - head - tail)


#: Tables of up to so many bytes (of their rows as JSON) are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32_000_000


def fits(df: DataFrame, most: int) -> bool:
    """Whether all rows of df together, as JSON, are within a number of bytes; one pass over df."""
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= most


#: Lists of keys of up to so many rows (16 bytes each) are broadcast; longer ones are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """docs without the rows whose (doc_id, text_hash) is in drop; text_hash is xxhash64 of the text."""
    keys = stage(drop.select(F.col("doc_id").cast("long").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "drop-keys")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    same = docs["doc_id"].cast("long").eqNullSafe(keys["_id"]) & F.xxhash64(docs["text"].cast("string")).eqNullSafe(keys["_hash"])
    return docs.join(keys, same, "left_anti")
