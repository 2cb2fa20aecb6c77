"""Frames, sessions and tasks as event tables: rolling measures, bounded buffers, expiry."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from lodestone.sources.shared import written

# Limits of uploaded videos.
UPLOAD_TYPES, UPLOAD_EXTENSIONS = ["video/mp4", "video/quicktime", "video/x-msvideo"], ["mp4", "mov", "avi"]
STATUSES = ["pending", "processing", "completed", "failed"]


#: A key's history is numbered in intervals of the first order column, of so many seconds or whole numbers, and
#: rolling measures see it in runs of so many rows.
INTERVAL_SECONDS, INTERVAL_NUMBERS, RUN_ROWS = 3600, 100_000, 20_000


def _interval(df: DataFrame, order: str) -> Column:
    """Which interval of the first order column a row is in."""
    kind, first = df.schema[order].dataType, F.col(order)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_micros(first.cast("timestamp")) / (INTERVAL_SECONDS * 1_000_000))
    return F.floor(first / INTERVAL_NUMBERS) if isinstance(kind, T.NumericType) else F.lit(0)


def numbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df with __key, __pos: each row's number (from 1) in the order of its key, found without gathering the
    history of a key in one task: rows are numbered within intervals, and the intervals' counts added up."""
    # a struct equals another one with the same field, null or not
    dealt = df.withColumns({"__key": F.struct(key), "__interval": F.struct(_interval(df, order[0]).cast("long").alias("i"))})
    within = dealt.withColumn("__in", F.row_number().over(Window.partitionBy("__key", "__interval").orderBy(*order)))
    counts = dealt.groupBy("__key", "__interval").agg(F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy("__key").orderBy("__interval").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__rows")
    placed = within.join(counts.withColumn("__before", before).drop("__rows"), ["__key", "__interval"])
    return placed.withColumn("__pos", F.col("__before") + F.col("__in")).drop("__interval", "__in", "__before")


def running(df: DataFrame, key: str, sums: dict[str, Column], *order: str) -> DataFrame:
    """df with __key and, for each of sums, its sum over the key's rows up to this one, found as in numbered(): within
    intervals, whose own sums are then added up. Columns of sums are whole numbers; order must tell all rows apart."""
    dealt = df.withColumns({"__key": F.struct(key), "__interval": F.struct(_interval(df, order[0]).cast("long").alias("i"))})
    upto = Window.partitionBy("__key", "__interval").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("__key").orderBy("__interval").rowsBetween(Window.unboundedPreceding, -1)
    within = dealt.withColumns({f"__in_{name}": F.sum(c).over(upto) for name, c in sums.items()})
    totals = dealt.groupBy("__key", "__interval").agg(*[F.sum(c).alias(f"__all_{name}") for name, c in sums.items()])
    before = totals.select("__key", "__interval", *[F.coalesce(F.sum(f"__all_{name}").over(earlier), F.lit(0).cast("long")).alias(f"__before_{name}") for name in sums])
    met = within.join(before, ["__key", "__interval"])
    return met.select("__key", *df.columns, *[(F.col(f"__in_{name}") + F.col(f"__before_{name}")).alias(name) for name in sums])


def _previous(df: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """df with __previous: value in the key's row before, found within intervals and from one interval to the next."""
    dealt = df.withColumns({"__key": F.struct(key), "__interval": F.struct(_interval(df, order[0]).cast("long").alias("i"))})
    within = dealt.withColumn("__in", F.lag(value).over(Window.partitionBy("__key", "__interval").orderBy(*order)))
    lasts = dealt.groupBy("__key", "__interval").agg(F.max_by(value, F.struct(*order)).alias("__last"))
    before = lasts.select("__key", "__interval", F.lag("__last").over(Window.partitionBy("__key").orderBy("__interval")).alias("__before"))
    return within.join(before, ["__key", "__interval"]).select(*df.columns, F.coalesce("__in", "__before").alias("__previous"))


def _rolling(df: DataFrame, key: str, n: int, name: str, measure: Callable[[WindowSpec], Column], *order: str) -> DataFrame:
    """df with a measure of the last n rows of each key, in runs: a run's last n - 1 rows go to the next run too, as
    what came before, and count only there."""
    if n > RUN_ROWS:
        raise ValueError(f"at most {RUN_ROWS} rows are seen at a time")
    placed = numbered(df, key, *order).withColumn("__run", F.floor((F.col("__pos") - 1) / RUN_ROWS))
    ahead = F.pmod(F.col("__pos") - 1, F.lit(RUN_ROWS)) > RUN_ROWS - n
    seen = placed.withColumn("__in_run", F.explode(F.when(ahead, F.array("__run", F.col("__run") + 1)).otherwise(F.array("__run"))))
    last = Window.partitionBy("__key", "__in_run").orderBy("__pos").rowsBetween(-(n - 1), 0)
    return seen.withColumn(name, measure(last)).where("__run = __in_run").select(*df.columns, name)


def rolling_mean(df: DataFrame, key: str, value: str, *order: str, n: int = 100) -> DataFrame:
    """df with rolling_mean of the last n samples of each key."""
    return _rolling(df, key, n, "rolling_mean", lambda w: F.avg(value).over(w), *order)


def seconds(ts: Column) -> Column:
    """Seconds since the epoch, with fractions."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def rolling_fps(df: DataFrame, key: str, ts: str, *order: str, n: int = 30) -> DataFrame:
    """df with fps over the last n stamps of each key: intervals by span; 0 with one stamp or no span."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))

    def fps(w: WindowSpec) -> Column:
        span = F.max(micros).over(w) - F.min(micros).over(w)
        return F.coalesce(F.try_divide((F.count("*").over(w) - 1) * F.lit(1e6), span.cast("double")), F.lit(0.0))

    return _rolling(df, key, n, "fps", fps, *order)


def tumbling_counts(df: DataFrame, ts: str, width: str, *keys: str) -> DataFrame:
    return df.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sampled(df: DataFrame, key: str, source_fps: float, target_fps: float, *order: str) -> DataFrame:
    """Every k-th frame of each key, k = source by target, at least 1; numbers from 1."""
    k = max(1, int(source_fps / target_fps))
    placed = numbered(df, key, *order).withColumnRenamed("__pos", "frame_number").drop("__key")
    return placed.where(F.pmod(F.col("frame_number") - 1, F.lit(k)) == 0)


def should_skip(fps: Column, target: Column, utilisation: Column) -> Column:
    """Whether a frame is skipped: never before there is a rate or at the target; below 0.7 of it, or over 0.8 full."""
    return F.when(fps == 0, False).when(fps >= target, False).when(fps / target < 0.7, True).otherwise(utilisation > 0.8)


def bounded_buffer(df: DataFrame, key: str, *order: str, capacity: int = 10) -> DataFrame:
    """What a buffer that drops its oldest holds in the end: the last rows of each key, with received and dropped."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    counts = df.groupBy(key).agg(F.count("*").alias("received"))
    kept = df.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= capacity).drop("__n")
    return kept.join(counts, key).withColumn("dropped", F.greatest(F.col("received") - capacity, F.lit(0)))


def idle_sessions(df: DataFrame, key: str, ts: str, *order: str, gap_seconds: int = 30) -> DataFrame:
    """key, session (from 1), started, ended, n_frames: a session ends when the gap to the next frame is longer.

    Sessions are found within intervals of time first; what is left of them, one row each, is then joined where
    the gap between two is no longer, so a key's frames never lie in one task.
    """
    gap = gap_seconds * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    interval = F.floor(micros(ts) / (INTERVAL_SECONDS * 1_000_000))

    def parts(rows: DataFrame, begin: str, end: str, *keys: str) -> DataFrame:
        """rows with part: how many gaps before a row, in the order of begin, among the rows of the same keys."""
        w = Window.partitionBy(*keys).orderBy(begin, end)
        new = F.when(micros(begin) - F.lag(micros(end)).over(w) <= gap, 0).otherwise(1)
        return rows.withColumn("__new", new).withColumn("part", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    dealt = df.select(key, ts, interval.alias("__interval"))
    first = parts(dealt, ts, ts, key, "__interval").groupBy(key, "__interval", "part").agg(F.min(ts).alias("__from"), F.max(ts).alias("__to"), F.count("*").alias("__rows"))
    whole = parts(first.drop("part"), "__from", "__to", key).groupBy(key, F.col("part").alias("session"))
    return whole.agg(F.min("__from").alias("started"), F.max("__to").alias("ended"), F.sum("__rows").alias("n_frames"))


def session_windows(df: DataFrame, key: str, ts: str, gap: str = "30 seconds") -> DataFrame:
    return df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n_frames")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("expires"), "n_frames")


def admissions(events: DataFrame, pool: str, key: str, action: str, *order: str, capacity: int = 5) -> DataFrame:
    """events (connect and disconnect; others take no part) with outcome: admitted, full (refused, as the pool has its
    capacity), duplicate (refused, as the key is connected), closed (its place is free again) or absent. A full pool
    refuses before a duplicate is looked for.

    What is admitted depends on all that came before, so events are taken one after the other, as a stream with at
    most capacity keys in mind. But wherever every key's last event is a disconnect, the pool is empty whatever
    was admitted; a pool's history is cut there, and its pieces go to different tasks. A piece without such a place
    is read by one task. order must tell all events of a pool apart; its first column deals them over intervals.
    """
    mine = events.where(F.col(action).isin("connect", "disconnect"))
    pair = mine.withColumn("__pair", F.struct(pool, key))
    known = _previous(pair, "__pair", action, *order)
    connected = F.coalesce(F.col("__previous") == "connect", F.lit(False))
    opened = F.when((F.col(action) == "connect") & ~connected, 1).when((F.col(action) == "disconnect") & connected, -1).otherwise(0)
    marked = written(running(known, pool, {"__open": opened}, *order).drop("__key", "__pair", "__previous"), "admissions")
    empty = F.when(F.col("__open") == 0, 1).otherwise(0)
    cut = running(marked, pool, {"__piece": empty}, *order).withColumn("__piece", F.col("__piece") - empty)
    columns = list(events.columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, set()
        for batch in batches:
            outcomes = []
            for *piece, what, who in zip(*(batch.column(c).to_pylist() for c in ("__key", "__piece", "__action", "__who"))):
                if piece != at:
                    at, held = piece, set()
                if what == "connect":
                    outcomes.append("full" if len(held) >= capacity else "duplicate" if who in held else "admitted")
                    if outcomes[-1] == "admitted":
                        held.add(who)
                else:
                    outcomes.append("closed" if who in held else "absent")
                    held.discard(who)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(outcomes, pa.string())], names=[*columns, "outcome"])

    sorted_ = cut.withColumns({"__action": F.col(action), "__who": F.col(key).cast("string")}).repartition("__key", "__piece").sortWithinPartitions("__key", "__piece", *order)
    return sorted_.select("__key", "__piece", "__action", "__who", *columns).mapInArrow(fold, T.StructType([*events.schema.fields, T.StructField("outcome", T.StringType())]))


def connection_stats(df: DataFrame, key: str, ts: str, processed: Column, took_ms: Column) -> DataFrame:
    """Per key: received, processed, mean fps over its life, mean processing time; two decimals."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    span = ((F.max(micros) - F.min(micros)) / F.lit(1e6)).cast("double")
    return df.groupBy(key).agg(
        F.count("*").alias("received"), F.count_if(processed).alias("processed"), F.count_if(~processed).alias("dropped"),
        F.round(F.coalesce(F.try_divide(F.count_if(processed).cast("double"), span), F.lit(0.0)), 6).alias("fps"),
        F.round(F.coalesce(F.try_divide(F.sum(F.when(processed, took_ms)), F.count_if(processed).cast("double")), F.lit(0.0)), 2).alias("mean_ms"),
    )


def connection_totals(per_key: DataFrame) -> DataFrame:
    return per_key.agg(F.count("*").alias("connections"), F.sum("received").cast("long").alias("received"), F.sum("processed").cast("long").alias("processed"), F.sum("dropped").cast("long").alias("dropped"))


def timed_out(took_ms: Column, limit_ms: float = 5000.0) -> Column:
    """Whether a frame's processing took longer than allowed, so that it is dropped; unknown times are in time."""
    return F.coalesce(took_ms > limit_ms, F.lit(False))


def frame_timeouts(df: DataFrame, key: str, took_ms: Column, limit_ms: float = 5000.0) -> DataFrame:
    """key, received, delivered, timeouts: what is left of each key's frames once those past their time are dropped."""
    late = timed_out(took_ms, limit_ms)
    return df.groupBy(key).agg(F.count("*").alias("received"), F.count_if(~late).alias("delivered"), F.count_if(late).alias("timeouts"))


def rate_per_check(df: DataFrame, key: str, ts: str, every: str = "1 second") -> DataFrame:
    """key, check_time, fps: the frames of each interval by its seconds, known at its end; without frames there is no row."""
    counts = df.groupBy(key, F.window(ts, every).alias("w")).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("w.end").alias("check_time"), (F.col("n") / (seconds(F.col("w.end")) - seconds(F.col("w.start")))).alias("fps"))


def buffer_metrics(df: DataFrame, key: str, depth: Column, took_ms: Column, *order: str, capacity: int = 10, samples: int = 100) -> DataFrame:
    """One row per key: received, processed (those with a time), dropped (beyond the capacity), the means of the
    last samples' queue depth and processing time, the size of the queue and its share of the capacity.
    Which samples are a key's last is found by their numbers, so that no key's history meets in one task."""
    placed = numbered(df.withColumns({"__depth": depth, "__took": took_ms}), key, *order)
    sizes = placed.groupBy("__key").agg(F.count("*").alias("__size"))
    recent = placed.join(sizes, "__key").withColumn("__recent", F.col("__pos") > F.col("__size") - samples)
    last = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("__recent"), F.col(c))), F.lit(0.0)), 2)
    counts = recent.groupBy("__key").agg(F.count("*").alias("received"), F.count("__took").alias("processed"), last("__depth").alias("mean_depth"), last("__took").alias("mean_ms"))
    size = F.least(F.col("received"), F.lit(capacity))
    return counts.select(F.col(f"__key.{key}").alias(key), "received", "processed", "mean_depth", "mean_ms").withColumns({"dropped": F.greatest(F.col("received") - capacity, F.lit(0)), "queue_size": size, "utilisation": F.round(size / F.lit(capacity), 2)})


def task_transitions(events: DataFrame, key: str, action: str, *order: str) -> DataFrame:
    """events (actions create, start, update, complete, fail, delete) with life (from 1: each create begins a new
    one, and replaces what there was), accepted, and the status after the event; events of tasks that don't exist, and those that their state doesn't allow, are
    refused and change nothing.

    In one life the states only go forward, so the first start, the first end after it and the first delete
    decide, and each event is judged by its place among them: no event waits for the one before it. Places are found by
    running sums over intervals and the deciding ones by aggregates, so a task that has a third of all events
    is dealt over many tasks. order must tell all events of a task apart.
    """
    is_ = lambda *names: F.col(action).isin(*names)
    columns = events.columns
    placed = written(running(events, key, {"__at": F.lit(1), "life": F.when(is_("create"), 1).otherwise(0)}, *order), "tasks")
    at = lambda condition: F.min(F.when(condition, F.col("__at")))
    lives = placed.groupBy("__key", "life").agg(at(is_("delete")).alias("__deleted"), at(is_("start")).alias("__start"))
    before = lambda c: F.coalesce(F.col("__at") < F.col(c), F.lit(True))
    started = F.when(F.coalesce(F.col("__start") < F.col("__deleted"), F.lit(True)), F.col("__start"))
    begun = placed.join(lives.withColumn("__started", started), ["__key", "life"])
    ends = begun.where(is_("complete", "fail") & (F.col("__at") > F.col("__started")) & before("__deleted")).groupBy("__key", "life").agg(F.min(F.struct("__at", action)).alias("__end"))
    marked = begun.join(ends.select("__key", "life", F.col("__end.__at").alias("__ended"), F.col(f"__end.{action}").alias("__how")), ["__key", "life"], "left")
    is_now = F.coalesce(F.col("__at") > F.col("__started"), F.lit(False)) & before("__ended") & before("__deleted")
    own = lambda c: F.coalesce(F.col("__at") == F.col(c), F.lit(False))
    accepted = F.when(is_("create"), True).when(F.col("life") == 0, False).when(is_("delete"), own("__deleted")).when(is_("start"), own("__started")).when(is_("update"), is_now).when(is_("complete", "fail"), own("__ended")).otherwise(False)
    reached = lambda c: F.coalesce(F.col("__at") >= F.col(c), F.lit(False))
    status = F.when(F.col("life") == 0, None).when(reached("__deleted"), "deleted").when(reached("__ended"), F.when(F.col("__how") == "complete", "completed").otherwise("failed")).when(reached("__started"), "processing").otherwise("pending")
    return marked.select(*columns, "life", accepted.alias("accepted"), status.alias("status"))


def task_table(transitions: DataFrame, key: str, action: str, ts: str, done: str, total: str) -> DataFrame:
    """The tasks that exist after all events of task_transitions(): key, status, created_at, started_at,
    completed_at, frames (done; all of them once completed), frames_total and percent. Deleted ones are not listed.
    Each life is summed up by itself, then the newest of a task's lives taken."""
    at = lambda *names: F.max(F.when(F.col(action).isin(*names), F.col(ts)))
    counted = F.max_by(F.when(F.col(action) == "update", F.struct(F.col(done).alias("done"), F.col(total).alias("total"))), F.when(F.col(action) == "update", F.col(ts)))
    lives = transitions.where("accepted").groupBy(key, "life").agg(F.max(F.col(action) == "delete").alias("__gone"), F.max(F.col(action) == "complete").alias("__complete"), F.max(F.col(action) == "fail").alias("__failed"), at("create").alias("created_at"), at("start").alias("started_at"), at("complete", "fail").alias("completed_at"), counted.alias("__count"))
    newest = F.max_by(F.struct(*[c for c in lives.columns if c not in (key, "life")]), "life")
    tasks = lives.groupBy(key).agg(newest.alias("__newest")).select(key, "__newest.*")
    frames = F.when(F.col("__complete"), F.col("__count.total")).otherwise(F.col("__count.done"))
    status = F.when(F.col("__complete"), "completed").when(F.col("__failed"), "failed").when(F.col("started_at").isNotNull(), "processing").otherwise("pending")
    shown = tasks.where(~F.col("__gone")).withColumns({"status": status, "frames": F.coalesce(frames, F.lit(0)).cast("long"), "frames_total": F.coalesce("__count.total", F.lit(0)).cast("long")})
    return shown.select(key, "status", "created_at", "started_at", "completed_at", "frames", "frames_total", progress(F.col("frames"), F.col("frames_total")).alias("percent"))


def latest_state(updates: DataFrame, key: str, *order: str) -> DataFrame:
    """The last update of each key."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return updates.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def status_counts(tasks: DataFrame, column: str, statuses: list[str] = STATUSES) -> DataFrame:
    """One row: tasks of each status, 0 where there are none, and total."""
    return tasks.agg(*[F.count_if(F.col(column) == s).alias(s) for s in statuses], F.count("*").alias("total"))


def expires_at(completed: Column, minutes: int = 15) -> Column:
    return completed + F.make_dt_interval(mins=F.lit(minutes))


def expired(tasks: DataFrame, completed: str, now: Column, minutes: int = 15) -> DataFrame:
    """Finished tasks past their time; unfinished ones (no completion) never expire."""
    return tasks.where(F.col(completed).isNotNull() & (expires_at(F.col(completed), minutes) <= now))


def progress(done: Column, total: Column) -> Column:
    """Percent, two decimals; 0 without a total."""
    return F.round(F.coalesce(F.try_divide(done * F.lit(100.0), total), F.lit(0.0)), 2)


def upload_errors(size: Column, name: Column, mime: Column, duration: Column, max_mb: int = 500, max_seconds: int = 300) -> Column:
    """Everything that is wrong with an upload, in order."""
    extension = F.lower(F.element_at(F.split(name, "\\."), -1))
    return F.array_compact(F.array(
        F.when(size > max_mb * 1048576, "too_large"), F.when(~F.coalesce(extension.isin(UPLOAD_EXTENSIONS), F.lit(False)), "bad_extension"),
        F.when(mime.isNotNull() & ~mime.isin(UPLOAD_TYPES), "bad_type"), F.when(duration > max_seconds, "too_long"),
    ))
