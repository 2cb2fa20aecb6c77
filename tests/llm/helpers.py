"""Small documents that every operator must survive."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("spans", T.StringType()), T.StructField("score", T.StringType()),
])

LONG = "the quick brown fox jumps over the lazy dog while Éric naps " * 3000


def documents(spark, texts, ids=None):
    """A documents table with two extra columns of clashing names."""
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, None, "src", None if t is None else len(t), "x", "y") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " \t\n", "one", "one two", LONG, "repeat me please now", "repeat me please now", "ÄÖÜ Straße İstanbul   x", "\x00 nul \x1f", "9" * 3000, "A" * 3000]
ODD_IDS = [1, 2, 3, 4, 5, 6, 7, 7, None, None, 10, 11]
