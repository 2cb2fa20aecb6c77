"""Fresh places for written tables, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}


def _base(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of this machine, if the driver is all there is. Executors
    elsewhere would not see that folder, so on a cluster the setting is required."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir is not set: on {master or 'a cluster'} it must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        base = _local.get(app) or _local.setdefault(app, tempfile.mkdtemp(prefix="lodestone-"))
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder of this run."""
    return f"{_base(spark)}/{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_folder(spark: SparkSession) -> str:
    """The folder below spark.checkpoint.dir that has all of an application's intermediate tables."""
    return f"lodestone-{spark.sparkContext.applicationId}"


def drop_run(spark: SparkSession) -> bool:
    """Delete all intermediate tables of this application, once its results are written; DataFrames that still read
    them can't be used any more. Whether there were any."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{_base(spark)}/{run_folder(spark)}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as an intermediate table: its lineage ends there, and what reads it twice reads the same rows."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
