"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next one's docs: documents that the quality classifier rejects go, one document of each near-duplicate
group stays, documents that hold a benchmark passage go, secrets are replaced by a mark, and what is left
is packed into sequences.

Defined results: rows without a doc_id or a text go through like any other (null and empty texts are scored
as empty, are copies of one another, hold no passage and no secret, and are packed as the end id alone);
repeated rows are copies; without labels nothing is rejected, and without a benchmark nothing is dropped;
columns beyond those of documents are kept to the last stage but one; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, packing, quality, secrets, simhash
from lodestone.llm.common import table, unused
from lodestone.sources.shared import scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, trained on sf_dir's labels, predicts to be of low quality."""
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component."""
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of sf_dir's benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; n_chars, where there is one, follows where a text has changed."""
    if "n_chars" not in docs.columns:
        return secrets.redact_secrets(docs)
    before = unused(docs, "length")
    clean = secrets.redact_secrets(docs.withColumn(before, F.length("text")))
    n_chars = F.when(F.length("text") != F.col(before), F.length("text")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).drop(before)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("best_fit_packing", packing_stage),
]

# The classifier is trained here, and SQL has neither its arithmetic nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written to the shared folder and read again."""
    base = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
