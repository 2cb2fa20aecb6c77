"""Structured Streaming twins of the frame and task operators.

Stateful ones forget by event time: with a time column they have a watermark, and a key whose time has come gets
one last call, in which its state is removed. Without one, their state is kept for ever, as complete results need.
"""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int | None = 1) -> DataFrame:
    """A stream of Parquet files of a folder; naive times become UTC instants, which watermarks need. Batches take files
    by their time of change; with None, one batch has all that there are, so that no order of files matters."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    raw = (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(folder)
    return raw.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def run_to_end(df: DataFrame, path: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Run a stream over what there is and return its result, written under path.

    complete replaces the result in every batch; update and append write each batch, and update reads the
    last version of each of keys.
    """
    def write(batch: DataFrame, number: int) -> None:
        numbers.append(number)
        if mode == "complete":
            batch.write.mode("overwrite").parquet(f"{path}/{number}")
        else:
            batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/{number}")

    numbers: list[int] = []
    spark = df.sparkSession
    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    if not numbers:  # no file has come yet
        return spark.createDataFrame([], df.schema)
    if mode == "complete":
        return spark.read.schema(df.schema).parquet(f"{path}/{numbers[-1]}")
    schema = df.withColumn("_batch", F.lit(0)).schema
    every = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    if mode == "update":
        newest = every.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), "_batch").alias("v"))
        return newest.select(*keys, "v.*").select(*df.columns)
    return every.drop("_batch")


def tumbling_counts(events: DataFrame, ts: str, width: str, *keys: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def running_counters(events: DataFrame, key: str, idle_seconds: int | None = None, late: str = "1 day") -> DataFrame:
    """Per key: received and last_activity (of column ts). With idle_seconds a key that has been idle for longer, as the
    watermark tells, is forgotten, and what it sends later counts from one again."""
    if idle_seconds is None:
        return events.groupBy(key).agg(F.count("*").alias("received"), F.max("ts").alias("last_activity"))

    def step(group, pdf, state: GroupState):
        received, last = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            return
        pdf, again = _since_idle(pdf, last if received else None, idle_seconds)
        received, last = len(pdf) + (0 if again else received), max(last, int(pdf["__ms"].max()))
        state.update((received, last))
        _until(state, last + idle_seconds * 1000)
        yield pd.DataFrame({key: [group[0]], "received": [received], "last_ms": [last]})

    done = _stepped(events, key, [], "ts", late, step, "received long, last_ms long", "received long, last_ms long")
    return done.select(key, "received", F.timestamp_millis("last_ms").alias("last_activity"))


def _since_idle(pdf: pd.DataFrame, last: int | None, idle_seconds: int) -> tuple[pd.DataFrame, bool]:
    """The events of a batch after its last gap longer than allowed, the one before its first event included, and
    whether there was such a gap. So a key starts again whether or not its state was removed in the meantime."""
    pdf = pdf.sort_values("__ms", kind="stable")
    gaps = pdf["__ms"].diff().fillna(0 if last is None else pdf["__ms"].iloc[0] - last)
    long = (gaps > idle_seconds * 1000).to_numpy().nonzero()[0]
    return (pdf.iloc[long[-1] :], True) if len(long) else (pdf, False)


def _until(state: GroupState, ms: int) -> None:
    state.setTimeoutTimestamp(max(ms, state.getCurrentWatermarkMs() + 1))


def _stepped(events: DataFrame, key: str, columns: list[str], time: str | None, late: str, step, out: str, kept: str) -> DataFrame:
    """step over each key's new events, with __ms, their time in milliseconds, and timeouts by it if there is a time column.

    A batch's events of a key come in any number of Arrow pieces and, after a shuffle, in any order, so step gets them
    all at once, but for the key: some tens of bytes for each event of one key in one batch.
    """
    kind = events.schema[key].dataType.simpleString()
    wanted = list(dict.fromkeys([key, *columns, *([time] if time else [])]))
    timed = events.withWatermark(time, late).select(*wanted, F.unix_millis(time).alias("__ms")) if time else events.select(*wanted)
    needed = [*dict.fromkeys(columns), *(["__ms"] if time else [])]

    def whole(group, pieces, state: GroupState):
        pdf = None if state.hasTimedOut else pd.concat([p[needed] for p in pieces], ignore_index=True)
        yield from step(group, pdf, state)

    return timed.groupBy(key).applyInPandasWithState(whole, f"{key} {kind}, {out}", kept, "update", GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout)


def first_seen(events: DataFrame, key: str, ts: str, every_seconds: int = 86_400, late: str = "1 day") -> DataFrame:
    """A row for each key and interval of event time that it is seen in, with period, the interval's start.

    Intervals are no longer than late. A key's state is forgotten once the watermark, the latest time seen less
    late, has passed its first row by late; what might still come for the interval is then late itself, and late
    rows are dropped. So the state holds the keys of about two intervals, however long the stream.
    """
    width = every_seconds * 1_000_000
    period = F.timestamp_micros(F.floor(F.unix_micros(ts) / F.lit(width)).cast("long") * width)
    return events.withWatermark(ts, late).withColumn("period", period).dropDuplicatesWithinWatermark([key, "period"])


def timely(frames: DataFrame, sent: str, arrived: str, limit: str = "5 seconds") -> DataFrame:
    """Frames that arrived within limit of being sent; the others are dropped, by the frames' own times."""
    return frames.where(F.col(arrived) <= F.col(sent) + F.expr(f"INTERVAL {limit}"))


def task_states(events: DataFrame, key: str, action: str, order: str, time: str | None = None, keep_minutes: int = 15, late: str = "1 day") -> DataFrame:
    """Per task after each batch: status, and how many events were refused. The state of a task is its status; the
    events of a batch are taken in order, whatever order they come in, and those that the status doesn't allow are refused, as in
    operators.frames.task_transitions(). The state is three values, whatever a task has been through.

    With a time column a task that is completed, failed or deleted is forgotten keep_minutes after that, and its last
    status is 'expired', so that its files can be removed; tasks that wait or run are never forgotten.
    """
    allowed = {"start": ("pending", "processing"), "update": ("processing", "processing"), "complete": ("processing", "completed"), "fail": ("processing", "failed")}

    def step(group, pdf, state: GroupState):
        status, refused, since = state.get if state.exists else (None, 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [group[0]], "status": ["expired"], "refused": [refused]})
            return
        pdf = pdf.sort_values(order, kind="stable")
        for what, ms in zip(pdf[action], pdf["__ms"] if time else itertools.repeat(0)):
            before = status
            if what == "create":
                status = "pending"
            elif what == "delete" and status not in (None, "deleted"):
                status = "deleted"
            elif what in allowed and status == allowed[what][0]:
                status = allowed[what][1]
            else:
                refused += 1
            since = int(ms) if status != before else since
        state.update((status, refused, since))
        if time and status in ("completed", "failed", "deleted"):
            _until(state, since + keep_minutes * 60_000)
        yield pd.DataFrame({key: [group[0]], "status": [status], "refused": [refused]})

    return _stepped(events, key, [action, order], time, late, step, "status string, refused long", "status string, refused long, since long")


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n_frames")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "n_frames")


def bounded_buffer(frames: DataFrame, key: str, order: str, capacity: int = 10, time: str | None = None, idle_seconds: int = 300, late: str = "1 day") -> DataFrame:
    """Per key after each batch: received, dropped, and the order values that a buffer of this capacity, which
    drops its oldest, holds. The state is never more than the capacity; frames of a batch come sorted. With a
    time column the buffer of a key that has been idle for longer than idle_seconds is forgotten."""

    def step(group, pdf, state: GroupState):
        received, kept, last = state.get if state.exists else (0, [], 0)
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(kept)
        if time:
            pdf, again = _since_idle(pdf, last if received else None, idle_seconds)
            received, kept, last = (0, [], int(pdf["__ms"].max())) if again else (received, kept, max(last, int(pdf["__ms"].max())))
        received += len(pdf)
        kept = sorted([*kept, *pdf[order].tolist()])[-capacity:]
        state.update((received, kept, last))
        if time:
            _until(state, last + idle_seconds * 1000)
        yield pd.DataFrame({key: [group[0]], "received": [received], "dropped": [max(0, received - capacity)], "held": [kept]})

    kind = frames.schema[order].dataType.simpleString()
    return _stepped(frames, key, [order], time, late, step, f"received long, dropped long, held array<{kind}>", f"received long, held array<{kind}>, last long")
