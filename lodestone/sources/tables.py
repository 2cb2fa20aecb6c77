"""Reading and writing the engine's tables."""

from __future__ import annotations

import contextlib
import json
import sqlite3
from collections.abc import Callable, Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.utils import AnalysisException

from lodestone.schema import MANIFEST


def parquet(spark: SparkSession, path: str, schema: T.StructType | None = None, optional: bool = False) -> DataFrame | None:
    """A Parquet table; columns of schema that it lacks are null. Without a table: None if optional, else an error.
    A table that can't be read is always an error."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if optional and e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    if schema is None:
        return df
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


class CachedTable:
    """A table kept in memory until it is reloaded. What this session itself writes to its path, Spark takes in at once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._df = spark, path, None

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            self._df = self.spark.read.parquet(self.path).persist()
        return self._df

    def reload(self) -> DataFrame:
        if self._df is not None:
            self._df.unpersist()
        self._df = None
        self.spark.catalog.refreshByPath(self.path)
        return self.df


def manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A manifest: one document, or (lines) one to a line as operators.manifest.render() makes them; broken JSON
    is an error."""
    return spark.read.option("multiLine", not lines).option("mode", "FAILFAST").schema(MANIFEST).json(path)


def jsonl(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> DataFrame:
    """JSON lines; blank lines are passed over, a broken line or one without a required key is an error."""
    return strict_json(spark.read.text(path), schema, required)


def strict_json(lines: DataFrame, schema: T.StructType, required: list[str]) -> DataFrame:
    """The same for a DataFrame of a text column value."""
    whole = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", schema.add("_broken", "string") if "_broken" not in schema.names else schema, {"columnNameOfCorruptRecord": "_broken"}))
    bad = F.col("r._broken").isNotNull() | F.col("r").isNull()
    for key in required:
        bad = bad | F.col(f"r.{key}").isNull()
    checked = whole.withColumn("r", F.when(bad, F.raise_error(F.concat(F.lit("bad line: "), F.left("value", F.lit(200)))).cast(whole.schema["r"].dataType)).otherwise(F.col("r")))
    return checked.select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema if f.name != "_broken"])


def sqlite(spark: SparkSession, paths: str | list[str], table: str, partitions: int = 0) -> DataFrame:
    """A table of one or more SQLite files, read by ranges of its row numbers in as many tasks a file as asked for (by
    default, as Spark likes). The files have to be where all tasks see them. Tables without row numbers are read
    by one task each. A column is a long, a double, binary or a string, by the affinity of its declared type in
    the first file; a value of another kind is converted, or null where that can't be."""
    spark.dataSource.register(SqliteSource)
    options = {"paths": json.dumps([paths] if isinstance(paths, str) else paths), "table": table, "partitions": str(partitions or spark.sparkContext.defaultParallelism)}
    return spark.read.format("lodestone_sqlite").options(**options).load()


class SqliteSource(DataSource):
    """The standard library's sqlite3 as a batch source."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_sqlite"

    def schema(self) -> T.StructType:
        first = json.loads(self.options["paths"])[0]
        with _opened(first) as db:
            columns = db.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']!r} in {first}")
        return T.StructType([T.StructField(name, _affinity(kind)) for _, name, kind, *_ in columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options)


class Rows(InputPartition):
    def __init__(self, path: str, low: int | None = None, high: int | None = None):
        self.path, self.low, self.high = path, low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.table = schema, _quoted(options["table"])
        self.paths, self.tasks = json.loads(options["paths"]), max(1, int(options["partitions"]))

    def partitions(self) -> list[Rows]:
        found = []
        for path in self.paths:
            with _opened(path) as db:
                try:
                    low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
                except sqlite3.OperationalError:  # a table without row numbers
                    found.append(Rows(path))
                    continue
            if low is not None:
                step = -(-(high - low + 1) // self.tasks)
                found += [Rows(path, at, min(at + step - 1, high)) for at in range(low, high + 1, step)]
        return found or [Rows(self.paths[0])]  # no rows, by one task

    def read(self, partition: Rows) -> Iterator[tuple]:
        names, kinds = ", ".join(_quoted(f.name) for f in self.schema), [f.dataType for f in self.schema]
        where, values = ("", ()) if partition.low is None else (" WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))
        with _opened(partition.path) as db:
            for row in db.execute(f"SELECT {names} FROM {self.table}{where}", values):
                yield tuple(_converted(value, kind) for value, kind in zip(row, kinds))


@contextlib.contextmanager
def _opened(path: str) -> Iterator[sqlite3.Connection]:
    """A database, read only; bytes that aren't UTF-8 are replaced in texts."""
    db = sqlite3.connect(f"file:{quote(unquote(urlparse(path).path) if path.startswith('file:') else path)}?mode=ro", uri=True)
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    try:
        yield db
    finally:
        db.close()


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _affinity(declared: str) -> T.DataType:
    kind = (declared or "").upper()
    if "INT" in kind:
        return T.LongType()
    if any(word in kind for word in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if "BLOB" in kind:
        return T.BinaryType()
    return T.DoubleType() if any(word in kind for word in ("REAL", "FLOA", "DOUB")) else T.StringType()


def _converted(value, kind: T.DataType):
    try:
        if value is None:
            return None
        if isinstance(kind, T.BinaryType):
            return value if isinstance(value, bytes) else str(value).encode()
        if isinstance(kind, T.StringType):
            return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
        return int(value) if isinstance(kind, T.LongType) else float(value)
    except ValueError:
        return None


def files(spark: SparkSession, root: str, pattern: str = "*", opened: Callable[[str], BinaryIO] | None = None) -> DataFrame:
    """path (relative to root), size and head (first 4 bytes) of all files below root. Spark's listing passes over
    empty files, so checks find these missing.

    The listing reads no contents. Four bytes of each file are read through opened, which opens a listed path in a task, or by
    Arrow where it knows the file system; with neither, files are read whole by Spark, of which only the head leaves the scan.
    """
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    listed = with_heads(source.select("path", "length"), opened or arrow_opened) if opened or _scheme(spark, root) in ARROW_SCHEMES else source.select("path", "length", F.substring("content", 1, 4).alias("head"))
    base = F.regexp_replace(F.lit(root), "^[a-z]+:/*|/+$", "")
    relative = F.ltrim(F.element_at(F.split("path", F.concat(F.lit("\\Q"), base, F.lit("\\E")), 2), -1), F.lit("/"))
    return listed.select(relative.alias("path"), F.col("length").alias("size"), "head")


#: File systems that Arrow opens by itself.
ARROW_SCHEMES = {"file", "s3", "gs"}


def _scheme(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()


def arrow_opened(path: str) -> BinaryIO:
    local = path.startswith("file:")
    fs, name = (pafs.LocalFileSystem(), unquote(urlparse(path).path)) if local else pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def with_heads(listed: DataFrame, opened: Callable[[str], BinaryIO] = arrow_opened) -> DataFrame:
    """path, length and head, the first four bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for path in batch.column("path").to_pylist():
                with opened(path) as data:
                    heads.append(data.read(4))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary())], names=["path", "length", "head"])

    return listed.mapInArrow(read, "path string, length long, head binary")


def write_parquet(df: DataFrame, path: str, force: bool = False) -> None:
    """A new table; an existing one is replaced only by force."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """An evaluation report, a few rows, as one JSON and one CSV file."""
    one = report.coalesce(1)
    one.write.mode("overwrite").json(f"{path}/json")
    one.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def write_documents(df: DataFrame, path: str, column: str = "json") -> None:
    """Documents, one to a line."""
    df.select(column).write.mode("overwrite").text(path)
