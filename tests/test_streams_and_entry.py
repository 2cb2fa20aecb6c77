import ast
import pathlib
import time
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import __spark_entry__
from lodestone.plans import stream_queries
from lodestone.sources import shared
from lodestone.streaming import frames as streams

ROOT = pathlib.Path(__spark_entry__.__file__).parent


def events(spark, tmp_path, parts=3):
    rows = spark.range(60).selectExpr("id event_id", "id % 4 user_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 7 as int)) ts")
    for i in range(parts):
        rows.where(F.floor(F.col("event_id") / 20) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return rows, streams.event_stream(spark, str(tmp_path / "in"), "part-*.parquet", rows.schema)


def test_streams_give_the_batch_rows(spark, tmp_path):
    rows, stream = events(spark, tmp_path)
    counts = streams.run_to_end(streams.running_counters(stream, "user_id"), str(tmp_path / "a"), "update", ("user_id",))
    assert {r.user_id: r.received for r in counts.collect()} == {i: 15 for i in range(4)}
    tumbling = streams.run_to_end(streams.tumbling_counts(stream, "ts", "1 hour"), str(tmp_path / "b"), "complete")
    assert sum(r.n for r in tumbling.collect()) == 60 and tumbling.count() == 7
    assert streams.run_to_end(streams.first_seen(stream.select("user_id", "ts"), "user_id", "ts"), str(tmp_path / "c")).count() == 4
    held = streams.run_to_end(streams.bounded_buffer(stream, "user_id", "event_id", 3), str(tmp_path / "d"), "update", ("user_id",)).collect()
    assert {r.user_id: (r.received, r.dropped, list(r.held)) for r in held}[1] == (15, 12, [49, 53, 57])


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.registry.FLAGSHIP in __spark_entry__.queries()


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "lodestone").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            names = [n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Import) for a in n.names]
            assert not any("llm" in n or "corpus_pipeline" in n for n in names), path


def stamped(spark, folder, name, rows):
    """A file of events: (key, seconds after the start)."""
    table = spark.createDataFrame([(k, datetime(2024, 1, 1) + timedelta(seconds=s)) for k, s in rows], "key string, ts timestamp")
    table.coalesce(1).write.parquet(f"{folder}/{name}")


@pytest.mark.parametrize("mode, keys", [("append", ()), ("update", ("key",)), ("complete", ())])
def test_a_stream_over_an_empty_folder_is_empty(spark, tmp_path, mode, keys):
    (tmp_path / "in").mkdir()
    events = streams.event_stream(spark, str(tmp_path / "in"), "*.parquet", StructType.fromDDL("key string, ts timestamp"))
    df = events if mode == "append" else streams.running_counters(events, "key")
    out = streams.run_to_end(df, str(tmp_path / "out"), mode, keys)
    assert out.columns == df.columns and out.count() == 0


def test_first_seen_forgets_what_can_come_no_more(spark, tmp_path):
    """Files out of order: what comes too late is dropped, what comes late but in time is a duplicate. A batch drops
    what was late before the batch ahead of it, so the watermark of the second file counts from the fourth on."""
    folder, day = str(tmp_path / "in"), 86_400
    files = [[("a", 10), ("b", 20)], [("c", 5 * day)], [("g", 5 * day + 5)], [("a", 30), ("d", 40), ("c", 5 * day + 9), ("e", 4 * day + 100)], [("f", 5 * day)]]
    for i, rows in enumerate(files):
        stamped(spark, folder, f"f{i}", rows)
        time.sleep(1.1)  # files are taken by their time
    events = streams.event_stream(spark, folder, "*.parquet", StructType.fromDDL("key string, ts timestamp"))
    out = streams.run_to_end(streams.first_seen(events, "key", "ts"), str(tmp_path / "out"))
    found = sorted((r.key, r.period.day) for r in out.collect())
    # d comes four days late: the watermark is at day 4; a's second row is late too
    assert found == [("a", 1), ("b", 1), ("c", 6), ("e", 5), ("f", 6), ("g", 6)]


def test_timely_drops_slow_frames(spark):
    rows = spark.createDataFrame([(1, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 5)), (2, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 6)), (3, datetime(2024, 1, 1), None)], "id int, sent timestamp, arrived timestamp")
    assert [r.id for r in streams.timely(rows, "sent", "arrived").collect()] == [1]


def test_task_states_follow_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    steps = [["create", "update"], ["start", "start", "update"], ["complete", "fail"], ["delete", "update"], ["create"]]
    for i, actions in enumerate(steps):
        spark.createDataFrame([("t", a, 10 * i + j) for j, a in enumerate(actions)], "task string, action string, at long").coalesce(1).write.parquet(f"{folder}/f{i}")
        time.sleep(1.1)
    events = streams.event_stream(spark, folder, "*.parquet", StructType.fromDDL("task string, action string, at long"))
    seen = streams.run_to_end(streams.task_states(events, "task", "action", "at"), str(tmp_path / "out"), "update", ("task",)).collect()
    assert [tuple(r) for r in seen] == [("t", "pending", 4)]
    every = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out")).orderBy("_batch").collect()
    assert [(r.status, r.refused) for r in every] == [("pending", 1), ("processing", 2), ("completed", 3), ("deleted", 4), ("pending", 4)]


def reversed_events(spark, folder, files):
    """events.parquet of six tasks and 1,000 hours, its files and their rows written last first."""
    rows = spark.range(1000).selectExpr("(id * 7 + id % 13) event_id", "id % 6 user_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int)) ts", "id")
    for i in reversed(range(files)):
        part = rows.where(F.floor(F.col("id") * files / 1000) == i).drop("id")
        part.coalesce(1).sortWithinPartitions(F.desc("event_id")).write.mode("append").parquet(f"{folder}/events.parquet")
        time.sleep(1.1 if files > 1 else 0)
    every = duckdb.connect()
    every.execute("SET timezone = 'UTC'")
    every.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/part-*.parquet'")
    return every


@pytest.mark.parametrize("files", [1, 3])
def test_task_states_in_any_order_of_rows_pieces_and_files(spark, tmp_path, files):
    every = reversed_events(spark, str(tmp_path), files)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # so that a task's events come in pieces
    try:
        got = stream_queries.stream_task_states(spark, str(tmp_path)).orderBy("user_id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [tuple(r) for r in got] == every.execute(stream_queries.SQL["stream_task_states"] + " ORDER BY user_id").fetchall()


def progress_of(df, tmp_path):
    """Rows of state after each batch, and what was written."""
    out = []
    query = df.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "kept")).foreachBatch(lambda batch, _: out.extend(map(tuple, batch.collect()))).trigger(availableNow=True).start()
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress], out


def test_finished_tasks_are_forgotten_and_running_ones_never(spark, tmp_path):
    folder = str(tmp_path / "in")
    steps = [[(f"t{i}", a, 0) for i in range(20) for a in ("create", "start")], [(f"t{i}", "complete" if i % 2 else "delete", 60) for i in range(15)], [("new", "create", 5 * 3600)], [("new", "start", 9 * 3600)]]
    for i, rows in enumerate(steps):
        table = spark.createDataFrame([(k, a, 100 * i + j, datetime(2024, 1, 1) + timedelta(seconds=s)) for j, (k, a, s) in enumerate(rows)], "task string, action string, at long, ts timestamp")
        table.coalesce(1).write.parquet(f"{folder}/f{i}")
        time.sleep(1.1)
    events = streams.event_stream(spark, folder, "*.parquet", StructType.fromDDL("task string, action string, at long, ts timestamp"))
    rows, out = progress_of(streams.task_states(events, "task", "action", "at", "ts", late="10 minutes"), tmp_path)
    assert max(rows) >= 20 and rows[-1] == 6  # t15 to t19 still run, and the new one
    assert sorted(r[0] for r in out if r[1] == "expired") == sorted(f"t{i}" for i in range(15))


@pytest.mark.parametrize("kind", ["buffer", "counters"])
def test_idle_keys_are_forgotten(spark, tmp_path, kind):
    folder = str(tmp_path / "in")
    for i, rows in enumerate([[(f"k{j}", j) for j in range(30)], [("k1", 7200)], [("k1", 14400)], [("k2", 21600)]]):
        stamped(spark, folder, f"f{i}", rows)
        time.sleep(1.1)
    events = streams.event_stream(spark, folder, "*.parquet", StructType.fromDDL("key string, ts timestamp"))
    df = streams.bounded_buffer(events.withColumn("n", F.unix_seconds("ts")), "key", "n", 2, time="ts", late="1 minute") if kind == "buffer" else streams.running_counters(events, "key", 300, "1 minute")
    rows, out = progress_of(df, tmp_path)
    assert max(rows) >= 30 and rows[-1] == 1
    assert [r[1] for r in out if r[0] == "k1"] == [1, 1, 1]  # each time from one again


def test_tables_of_a_run_can_be_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "_base", lambda _: str(tmp_path))
    assert shared.written(spark.range(5), "five").count() == 5
    assert list(tmp_path.iterdir()) and shared.drop_run(spark)
    assert not list(tmp_path.iterdir()) and not shared.drop_run(spark)


def test_a_cluster_needs_a_shared_folder():
    class Session:
        def __init__(self, master, folder=None):
            self.settings = {"spark.master": master, "spark.checkpoint.dir": folder}
            self.conf, self.sparkContext, self.applicationId = self, self, "app-of-a-test"

        def get(self, name, default=None):
            return self.settings.get(name) or default

    assert shared.scratch(Session("yarn", "hdfs://x/y/"), "a").startswith("hdfs://x/y/lodestone-app-of-a-test/a-")
    assert shared.scratch(Session("local[2]"), "a").rsplit("/", 2)[0] == shared.scratch(Session("local[2]"), "b").rsplit("/", 2)[0]
    with pytest.raises(ValueError, match="share"):
        shared.scratch(Session("yarn"), "a")


@pytest.mark.parametrize("files", [1, 3])
def test_tasks_kept_in_any_order_of_rows_pieces_and_files(spark, tmp_path, files):
    every = reversed_events(spark, str(tmp_path), files)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = stream_queries.stream_tasks_kept(spark, str(tmp_path)).orderBy("user_id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [tuple(r) for r in got] == every.execute(stream_queries.SQL["stream_tasks_kept"] + " ORDER BY user_id").fetchall()


@pytest.mark.parametrize("query", ["stream_tasks_kept", "stream_task_states", "stream_dedup", "stream_first_seen_daily", "stream_running_counters"])
def test_streams_take_their_own_files_only_and_in_any_order(spark, tmp_path, query):
    """Other tables are folders too, whose files have like names; and the newest events come first, a file each time."""
    every = reversed_events(spark, str(tmp_path), 3)
    spark.range(40).selectExpr("id doc_id", "id user_id", "'x' text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = getattr(stream_queries, query)(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(every.execute(stream_queries.SQL[query]).fetchall())
