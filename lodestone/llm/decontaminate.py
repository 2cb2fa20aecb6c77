"""Benchmark decontamination as a prefix-filtered set join, on DataFrame functions alone.

Every window of ten item words (a shorter item is one window) is a set of 3-word shingles that a document
must contain whole. One pass over the documents keeps, of all their shingles, those that occur in some
window, each with the words around it. From these the shingles' counts in the corpus order each window's
shingles by rarity. At containment 1 the necessary prefix of a window is its rarest shingle alone, so only
places of that shingle are candidates; a window with a shingle that no document has is dropped. Bounds on
length and position (the window must start and end inside the document) come before the exact comparison
of the window's words with the document's.

Defined results: null or wordless texts have zero words and hits; null and wordless items have no windows;
items with a null item_id mark words as hit but are not counted as items; repeated items count once by
item_id; rows that share doc_id and text get the same result each; rows are keyed by doc_id and text, so
null and repeated doc_ids do no harm; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import BROADCAST_BYTES, ascii_lower, fits, split_words, stage, without

WINDOW, SHINGLE = 10, 3
SEPARATORS = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"


def with_words(df: DataFrame) -> DataFrame:
    return df.withColumn("_lower", ascii_lower(F.coalesce("text", F.lit("")))).withColumn("words", split_words(F.col("_lower"), SEPARATORS)).drop("_lower", "text")


def item_windows(items: DataFrame) -> DataFrame:
    """window (an array of words), size and item_id (as a string) of every item's distinct windows."""
    words = with_words(items.select(F.col("item_id").cast("string"), F.col("text").cast("string"))).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (WINDOW - 1), F.lit(1)))
    each = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, WINDOW))).alias("window"))
    return each.distinct().select("window", F.size("window").alias("size"), "item_id")


def window_shingles(windows: DataFrame) -> DataFrame:
    """window, size, off, shingle (its words, joined), k (its number of words), h of each place in a window."""
    n = F.least("size", F.lit(SHINGLE))
    each = windows.select("window", "size", n.alias("k"), F.explode(F.sequence(F.lit(0), F.col("size") - n)).alias("off"))
    gram = F.slice("window", F.col("off") + 1, F.col("k"))
    h = F.when(F.col("k") == 1, F.xxhash64(gram[0])).when(F.col("k") == 2, F.xxhash64(gram[0], gram[1])).otherwise(F.xxhash64(gram[0], F.get(gram, 1), F.get(gram, 2)))
    return each.select("window", "size", "off", F.array_join(gram, " ").alias("shingle"), "k", h.alias("h"))


def shingle_places(docs: DataFrame, shingles: DataFrame, small: bool, size: int) -> DataFrame:
    """Of every document: its first place, and each place of a shingle of size words that some window has,
    with the words around it (context, from word number begins)."""
    n_words, words = F.size("words"), [F.get("words", F.col("pos") + k) for k in range(size)]
    each = docs.select("doc_id", "text_hash", "words", n_words.alias("n_words"), F.posexplode_outer("words").alias("pos", "word")).drop("word")
    places = each.withColumn("h", F.when(F.col("pos") + size <= F.col("n_words"), F.xxhash64(*words)))
    gram = F.array_join(F.slice("words", F.col("pos") + 1, size), " ")
    begins = F.greatest(F.col("pos") - (WINDOW - 1), F.lit(0))
    context = F.slice("words", begins + 1, 2 * WINDOW + SHINGLE)
    known = shingles.where(F.col("k") == size).select(F.col("h").alias("known_h"), "shingle")
    if not small:  # the shuffle carries a bounded context in place of all words
        places = places.withColumns({"gram": gram, "context": context}).drop("words")
        gram, context = F.col("gram"), F.col("context")
    # the words of a place are put together only where its hash is known: an equality would make them a join key
    same = F.array_contains(F.array("shingle"), gram)
    met = places.join(F.broadcast(known) if small else known, (F.col("h") == F.col("known_h")) & same, "left")
    return met.where(F.col("shingle").isNotNull() | F.col("pos").isNull() | (F.col("pos") == 0)).select(
        "doc_id", "text_hash", "n_words", "pos", "shingle", begins.alias("begins"), F.when(F.col("shingle").isNotNull(), context).alias("context")
    )


def window_hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, text_hash, n_words of every row; every occurrence of a window: doc_id, text_hash, start, size, window;
    and item_windows(). Which items have a window is joined to what occurs, and never broadcast."""
    owners = stage(item_windows(items), "windows")
    windows = owners.select("window", "size").distinct()
    grams = stage(window_shingles(windows), "window-shingles")
    distinct = stage(grams.select("shingle", "k", "h").distinct(), "shingles")
    small = fits(distinct, BROADCAST_BYTES)
    sizes = sorted(r["k"] for r in distinct.select("k").distinct().collect())  # at most 1, 2 and 3
    texts = with_words(docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string")))
    passes = {k: stage(shingle_places(texts, distinct, small, k), "places") for k in sizes or [SHINGLE]}
    every = next(iter(passes.values())).where("pos is null or pos = 0").select("doc_id", "text_hash", "n_words")
    places = reduce(DataFrame.unionByName, (p.where("shingle is not null") for p in passes.values()))

    counts = stage(places.groupBy("shingle").count(), "shingle-counts")
    rarity = grams.join(counts, "shingle", "left")
    prefix = rarity.groupBy("window", "size").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "off", "shingle")).alias("rarest")).where("rarest.n > 0")
    prefix = stage(prefix.select("window", "size", "rarest.off", "rarest.shingle"), "prefixes")
    near = places.join(F.broadcast(prefix) if fits(prefix, BROADCAST_BYTES) else prefix, "shingle").withColumn("start", F.col("pos") - F.col("off"))
    inside = near.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words")))
    hits = inside.where(F.slice("context", F.col("start") - F.col("begins") + 1, F.col("size")) == F.col("window"))
    return every, stage(hits.select("doc_id", "text_hash", "start", "size", "window"), "window-hits"), owners


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and text_hash)."""
    every, hits, owners = window_hits(docs, items)
    key = ["doc_id", "text_hash"]
    spans = hits.groupBy(*key, "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = F.max("end").over(Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0))
    n_hit = spans.select(*key, fresh.alias("fresh")).groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    occurring = hits.select(*key, "window").distinct()
    named = occurring.join(owners.select("window", "item_id"), "window").select(*key, F.col("item_id").alias("item")).distinct().groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("names"))
    found = stage(n_hit.join(named, [n_hit[k].eqNullSafe(named[k]) for k in key], "left").select(*[n_hit[k] for k in key], "n_hit", "names"), "contaminated")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return every.join(found, [every[k].eqNullSafe(found[k]) for k in key], "left").select(
        every["doc_id"],
        every["text_hash"],
        F.col("n_words").cast("long"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold a window of the benchmark."""
    return without(docs, window_hits(docs, items)[1])


# The same contract in DuckDB: every window against every document position, without prefixes.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
p AS (
  SELECT doc_id, s.size AS size, i, array_to_string(ws[i : i + s.size - 1], ' ') AS win
  FROM (SELECT d.doc_id, ws, q.size, unnest(range(1, len(ws) - q.size + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT size FROM w) q WHERE len(ws) >= q.size) s),
h AS (SELECT DISTINCT p.doc_id, p.i, p.size, w.item_id FROM p JOIN w ON p.win = w.win AND p.size = w.size),
x AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN t USING (doc_id)
"""
