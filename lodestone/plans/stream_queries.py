"""Queries of the vector, evaluation, frame and streaming operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import evaluation, frames, identify, vectors
from lodestone.sources.shared import scratch
from lodestone.streaming import frames as streams

EVERY = 50  # queries are the vectors whose id is divisible by it


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _index(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("camera_id"), "embedding")


def _asked(index):
    return index.where(F.col("row_id") % EVERY == 0).select(F.col("row_id").alias("query_id"), "embedding")


def _scores(df):
    return df.withColumn("score", F.round("score", 6))


def vec_norm(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(V.doubles(F.col("embedding"))), 6).alias("norm"))


def vec_mean(spark, sf_dir):
    mean = vectors.mean_vector(_t(spark, sf_dir, "embeddings"))
    return mean.select(F.posexplode("mean").alias("pos", "m")).select(F.col("pos").cast("long").alias("pos"), F.round("m", 6).alias("m"))


def vec_topk_raw(spark, sf_dir):
    index = _index(spark, sf_dir)
    return _scores(vectors.search(_asked(index), index, 5, collapse=False))


def vec_topk_collapsed(spark, sf_dir):
    """Best products of each query over all their variants, those at 0.1 and above, with their names."""
    index = _index(spark, sf_dir)
    matches = vectors.search(_asked(index), index, 3, threshold=0.1)
    names = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("camera_id"), F.col("n_name").alias("name"))
    return _scores(vectors.enrich(matches, names)).select("query_id", "rank", "camera_id", "row_id", "score", "name")


def vec_topk_centred(spark, sf_dir):
    index = _index(spark, sf_dir)
    return _scores(vectors.search(_asked(index), index, 5, mean=vectors.mean_vector(index)))


def vec_orig_reference(spark, sf_dir):
    index = _index(spark, sf_dir).withColumn("variant_tag", F.when(F.col("row_id") % 2 == 0, "warp1").otherwise("orig"))
    return vectors.reference_rows(index).select("camera_id", "row_id", "variant_tag")


def vec_index_stats(spark, sf_dir):
    return vectors.index_stats(_index(spark, sf_dir))


def eval_recall(spark, sf_dir):
    """Leave one out: whether a row's product is first, or among five, of the other rows' products."""
    index = _index(spark, sf_dir)
    asked = index.where(F.col("row_id") % EVERY == 0)
    matches = vectors.search(_asked(index), index, 5, exclude_self=True)
    truth = asked.select(F.col("row_id").alias("query_id"), F.col("camera_id").alias("truth"), F.col("camera_id").cast("string").alias("group"), F.lit(1).alias("severity"))
    return evaluation.recall(truth, matches, "group", "severity")


def eval_synthetic(spark, sf_dir):
    return evaluation.synthetic(_index(spark, sf_dir), ["noise", "mask"], [1, 2])


def _events(spark, sf_dir):
    return _t(spark, sf_dir, "events")


def frame_sampling(spark, sf_dir):
    return frames.sampled(_events(spark, sf_dir), "user_id", 30.0, 10.0, "ts", "event_id").select("event_id", "user_id", F.col("frame_number").cast("long").alias("frame_number"))


def rolling_mean_100(spark, sf_dir):
    return frames.rolling_mean(_events(spark, sf_dir), "user_id", "value", "ts", "event_id").select("event_id", F.round("rolling_mean", 9).alias("rolling_mean"))


def rolling_fps_30(spark, sf_dir):
    return frames.rolling_fps(_events(spark, sf_dir), "user_id", "ts", "ts", "event_id").select("event_id", F.round("fps", 8).alias("fps"))


def idle_sessions(spark, sf_dir):
    return frames.idle_sessions(_events(spark, sf_dir), "user_id", "ts", "event_id", gap_seconds=3600).select("user_id", "session", "started", "ended", "n_frames")


def session_window_batch(spark, sf_dir):
    return frames.session_windows(_events(spark, sf_dir), "user_id", "ts", "1 hour")


def tumbling_counts(spark, sf_dir):
    return frames.tumbling_counts(_events(spark, sf_dir), "ts", "1 day", "event_type")


def bounded_buffer_drop_oldest(spark, sf_dir):
    return frames.bounded_buffer(_events(spark, sf_dir), "user_id", "ts", "event_id").select("user_id", "event_id", "received", "dropped")


def skip_policy(spark, sf_dir):
    skip = frames.should_skip(F.col("value"), F.lit(100.0), (F.col("event_id") % 10) / 10)
    return _events(spark, sf_dir).select("event_id", skip.alias("skip"))


def _connections(spark, sf_dir):
    return frames.connection_stats(_events(spark, sf_dir), "user_id", "ts", F.col("event_type") != "click", F.col("value"))


def connection_stats(spark, sf_dir):
    return _connections(spark, sf_dir)


def connection_totals(spark, sf_dir):
    return frames.connection_totals(_connections(spark, sf_dir))


def connections_admitted(spark, sf_dir):
    """Clients of 64 servers, five at a time on each; every third event is a disconnect."""
    action = F.when(F.col("event_id") % 3 == 0, "disconnect").otherwise("connect")
    events = _events(spark, sf_dir).select("event_id", "user_id", "ts", (F.col("user_id") % 64).alias("server"), action.alias("action"))
    return frames.admissions(events, "server", "user_id", "action", "ts", "event_id").select("event_id", "server", "outcome")


def task_state_latest(spark, sf_dir):
    return frames.latest_state(_events(spark, sf_dir), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


def task_status_pivot(spark, sf_dir):
    return frames.status_counts(_t(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P", "X"])


def ttl_expired(spark, sf_dir):
    done = F.when(F.col("event_type") != "click", F.col("ts"))
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return frames.expired(_events(spark, sf_dir).withColumn("done", done), "done", now).select("event_id", "user_id")


def upload_checks(spark, sf_dir):
    name = F.concat(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, ".mp4").otherwise(".txt"))
    wrong = frames.upload_errors(F.col("value") * 10_000_000, name, F.lit("video/mp4"), F.col("event_id") % 400)
    return _events(spark, sf_dir).select("event_id", F.array_join(wrong, ",").alias("wrong"))


def task_progress(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", frames.progress(F.col("event_id") % 7, F.col("event_id") % 3).alias("percent"))


def eval_degraded(spark, sf_dir):
    """Products found again from reference rows with their first eight or sixteen components set to zero."""
    return evaluation.synthetic(_index(spark, sf_dir), ["cut"], [1, 2])


def identify_fixed(spark, sf_dir):
    """Detections of images whose bytes are vectors: the detector finds two boxes in each, one of them unsure."""
    packed = _t(spark, sf_dir, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("image_id"), F.array_join(F.transform(V.doubles(F.col("embedding")), lambda x: x.cast("string")), " ").cast("binary").alias("content"))
    found = identify.detected(packed, lambda contents: [(100, 80, [(10, 10, 50, 50, 0.9), (0, 0, 5, 5, 0.1)]) for _ in contents])
    index = _index(spark, sf_dir)
    catalog = index.select("camera_id").distinct().withColumn("name", F.col("camera_id").cast("string"))
    out = identify.identify(found, lambda contents, boxes: [[float(x) for x in bytes(c).decode().split(" ")] for c in contents], index, catalog)
    each = out.select("detection_id", "box.x_min", "box.y_min", "box.x_max", "box.y_max", F.explode("matches").alias("m"))
    return each.select("detection_id", "x_min", "y_min", "x_max", "y_max", "m.rank", "m.camera_id", F.round("m.score", 6).alias("score"), "m.record.name")


_ACTION = "element_at(array('create', 'start', 'start', 'update', 'update', 'complete', 'fail', 'delete'), cast(event_id % 8 as int) + 1)"


def _transitions(spark, sf_dir):
    events = _events(spark, sf_dir).select("user_id", "event_id", "ts", F.expr(_ACTION).alias("action"), (F.col("event_id") % 50).alias("done"), F.lit(60).cast("long").alias("total"))
    return frames.task_transitions(events, "user_id", "action", "event_id")


def task_lifecycle(spark, sf_dir):
    return _transitions(spark, sf_dir).select("event_id", "life", "accepted", F.coalesce("status", F.lit("")).alias("status"))


def task_table(spark, sf_dir):
    """Tasks with the numbers of their deciding events in place of times."""
    found = frames.task_table(_transitions(spark, sf_dir), "user_id", "action", "event_id", "done", "total")
    return found.select("user_id", "status", "created_at", F.coalesce("started_at", F.lit(-1)).alias("started_at"), F.coalesce("completed_at", F.lit(-1)).alias("completed_at"), "frames", "frames_total", "percent")


def frame_timeouts(spark, sf_dir):
    return frames.frame_timeouts(_events(spark, sf_dir), "user_id", F.col("value") * 100)


def rate_per_check(spark, sf_dir):
    return frames.rate_per_check(_events(spark, sf_dir), "event_type", "ts", "10 seconds")


def buffer_metrics(spark, sf_dir):
    took = F.when(F.col("event_type") != "click", F.col("event_id") % 997)
    return frames.buffer_metrics(_events(spark, sf_dir), "user_id", F.col("event_id") % 11, took, "event_id")


def _stream(spark, sf_dir, files_per_batch=1):
    """The events as a stream: of the one file, or of a folder's own files, as other tables beside it may be folders too."""
    folder, pattern = (sf_dir, "events.parquet") if _one_file(spark, sf_dir) else (f"{sf_dir}/events.parquet", "*.parquet")
    return streams.event_stream(spark, folder, pattern, _events(spark, sf_dir).schema, files_per_batch)


def _one_file(spark, sf_dir) -> bool:
    return all(f.endswith("/events.parquet") for f in _events(spark, sf_dir).inputFiles())


def stream_tumbling_counts(spark, sf_dir):
    done = streams.run_to_end(streams.tumbling_counts(_stream(spark, sf_dir), "ts", "1 day", "event_type"), scratch(spark, "stream"), "complete")
    return done.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_running_counters(spark, sf_dir):
    done = streams.run_to_end(streams.running_counters(_stream(spark, sf_dir), "user_id"), scratch(spark, "stream"), "update", ("user_id",))
    return done.withColumn("last_activity", F.col("last_activity").cast("timestamp_ntz"))


def stream_dedup(spark, sf_dir):
    """All files are one batch here and in the next query: days overlap between files, and late rows would be dropped."""
    return streams.run_to_end(streams.first_seen(_stream(spark, sf_dir, None).select("user_id", "ts"), "user_id", "ts"), scratch(spark, "stream")).select("user_id").distinct()


def stream_first_seen_daily(spark, sf_dir):
    done = streams.run_to_end(streams.first_seen(_stream(spark, sf_dir, None).select("user_id", "ts"), "user_id", "ts"), scratch(spark, "stream"))
    return done.select("user_id", F.col("period").cast("timestamp_ntz").alias("day"))


def stream_task_states(spark, sf_dir):
    """Statuses after all events, in the order of their numbers, which need not be that of their files."""
    events = _stream(spark, sf_dir, None).select("user_id", "event_id", F.expr(_ACTION).alias("action"))
    done = streams.run_to_end(streams.task_states(events, "user_id", "action", "event_id"), scratch(spark, "stream"), "update", ("user_id",))
    return done.select("user_id", F.coalesce("status", F.lit("")).alias("status"), "refused")


def stream_tasks_kept(spark, sf_dir):
    """Statuses when all events are in, in the order of their numbers, and the tasks that ended long enough ago are forgotten."""
    events = _stream(spark, sf_dir, None).select("user_id", "event_id", "ts", F.expr(_ACTION).alias("action"))
    done = streams.run_to_end(streams.task_states(events, "user_id", "action", "event_id", "ts"), scratch(spark, "stream"), "update", ("user_id",))
    return done.select("user_id", F.coalesce("status", F.lit("")).alias("status"))


def stream_timely(spark, sf_dir):
    arrived = F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 9)
    frames_in = _stream(spark, sf_dir).select("event_id", "ts", arrived.alias("arrived"))
    return streams.run_to_end(streams.timely(frames_in, "ts", "arrived"), scratch(spark, "stream")).select("event_id")


def stream_sessions(spark, sf_dir):
    done = streams.run_to_end(streams.sessions(_stream(spark, sf_dir), "user_id", "ts", "1 hour"), scratch(spark, "stream"), "complete")
    return done.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started", "expires")})


def stream_bounded_buffer(spark, sf_dir):
    done = streams.run_to_end(streams.bounded_buffer(_stream(spark, sf_dir), "user_id", "event_id"), scratch(spark, "stream"), "update", ("user_id",))
    return done.select("user_id", "received", "dropped", F.explode("held").alias("event_id"))


QUERIES = [
    vec_norm, vec_mean, vec_topk_raw, vec_topk_collapsed, vec_topk_centred, vec_orig_reference, vec_index_stats, eval_recall, eval_synthetic, frame_sampling, rolling_mean_100, rolling_fps_30, idle_sessions,
    session_window_batch, tumbling_counts, bounded_buffer_drop_oldest, skip_policy, connection_stats, connection_totals, connections_admitted, task_state_latest, task_status_pivot, ttl_expired,
    upload_checks, task_progress, eval_degraded, identify_fixed, task_lifecycle, task_table, frame_timeouts, rate_per_check, buffer_metrics, stream_first_seen_daily, stream_task_states, stream_tasks_kept, stream_timely, stream_tumbling_counts, stream_running_counters, stream_dedup, stream_sessions, stream_bounded_buffer,
]

_Q = f"""v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
n AS (SELECT vec_id, e, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v WHERE vec_id % {EVERY} = 0),
s AS (SELECT n.vec_id AS query_id, v.label AS camera_id, v.vec_id AS row_id, list_dot_product(n.u, v.e) AS score FROM n CROSS JOIN v)"""
_BEST = "b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, camera_id ORDER BY score DESC, row_id) = 1)"
_RANK = "r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, camera_id, row_id) AS INTEGER) AS rank FROM {})"
_SESSIONS = """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w {} 3600000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)"""
_WINDOWS = _SESSIONS.format("<") + " SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 1 HOUR AS expires, count(*) AS n_frames FROM n GROUP BY user_id, session"
_DAYS = "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"
_BUFFER = "SELECT user_id, event_id, received, greatest(received - 10, 0) AS dropped FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS received, row_number() OVER (PARTITION BY user_id ORDER BY {} DESC) AS n FROM events) WHERE n <= 10"
_PER_USER = "SELECT user_id, count(*) AS received, count(*) FILTER (event_type <> 'click') AS processed, count(*) FILTER (event_type = 'click') AS dropped, round(coalesce(count(*) FILTER (event_type <> 'click') / nullif((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 0), 0.0), 6) AS fps, round(coalesce(sum(value) FILTER (event_type <> 'click') / nullif(count(*) FILTER (event_type <> 'click'), 0), 0.0), 2) AS mean_ms FROM events GROUP BY user_id"

_LIVES = """e AS (SELECT user_id, event_id, ['create', 'start', 'start', 'update', 'update', 'complete', 'fail', 'delete'][event_id % 8 + 1] AS action FROM events),
l AS (SELECT *, sum(CASE WHEN action = 'create' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS life FROM e),
d AS (SELECT *, min(event_id) FILTER (action = 'delete') OVER (PARTITION BY user_id, life) AS gone FROM l),
s AS (SELECT *, min(event_id) FILTER (action = 'start' AND (gone IS NULL OR event_id < gone)) OVER (PARTITION BY user_id, life) AS begun FROM d),
f AS (SELECT *, min(event_id) FILTER (action IN ('complete', 'fail') AND event_id > begun AND (gone IS NULL OR event_id < gone)) OVER (PARTITION BY user_id, life) AS ended FROM s),
j AS (SELECT *, max(action) FILTER (event_id = ended) OVER (PARTITION BY user_id, life) AS how,
  CASE WHEN action = 'create' THEN true WHEN life = 0 THEN false WHEN action = 'delete' THEN event_id = gone WHEN action = 'start' THEN coalesce(event_id = begun, false) WHEN action = 'update' THEN coalesce(event_id > begun, false) AND (ended IS NULL OR event_id < ended) AND (gone IS NULL OR event_id < gone) ELSE coalesce(event_id = ended, false) END AS accepted FROM f),
t AS (SELECT *, CASE WHEN life = 0 THEN '' WHEN event_id >= gone THEN 'deleted' WHEN event_id >= ended THEN CASE how WHEN 'complete' THEN 'completed' ELSE 'failed' END WHEN event_id >= begun THEN 'processing' ELSE 'pending' END AS status FROM j)"""

SQL = {
    "eval_synthetic": f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      o AS (SELECT vec_id, label, e FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
      c AS (SELECT *, '42|' || vec_id || '|' || g || '|' || sev AS k FROM o, (VALUES ('noise', 1), ('noise', 2), ('mask', 1), ('mask', 2)) AS x(g, sev)),
      m AS (SELECT *, list_transform(e, lambda x, i: md5(k || '|' || (i - 1))) AS h FROM c),
      u AS (SELECT *, list_transform(h, lambda d: (CAST('0x' || substr(d, 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656) AS a, list_transform(h, lambda d: (CAST('0x' || substr(d, 13, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656) AS b FROM m),
      d AS (SELECT vec_id, label, g, sev, list_transform(e, lambda x, i: CASE WHEN g = 'noise' THEN x + sqrt(-2 * ln(a[i])) * cos(2 * pi() * b[i]) * 0.05 * sev WHEN a[i] < 0.1 * sev THEN 0.0 ELSE x END) AS e FROM u),
      n AS (SELECT vec_id, label, g, sev, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM d),
      s AS (SELECT n.vec_id AS q, n.label AS truth, g, sev, v.label AS camera_id, v.vec_id AS row_id, list_dot_product(n.u, v.e) AS score FROM n CROSS JOIN v),
      b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q, g, sev, camera_id ORDER BY score DESC, row_id) = 1),
      r AS (SELECT *, row_number() OVER (PARTITION BY q, g, sev ORDER BY score DESC, camera_id, row_id) AS rank FROM b),
      f AS (SELECT q, g, sev, min(rank) FILTER (camera_id = truth AND rank <= 5) AS found FROM r GROUP BY q, g, sev)
      SELECT g AS "group", sev AS severity, count(*) AS n, count(*) FILTER (found = 1) AS top1_hits, count(*) FILTER (found <= 5) AS top5_hits, round_even(count(*) FILTER (found = 1) / count(*), 4) AS top1_rate, round_even(count(*) FILTER (found <= 5) / count(*), 4) AS top5_rate FROM f GROUP BY g, sev""",
    "eval_degraded": f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
      o AS (SELECT vec_id, label, e FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
      c AS (SELECT vec_id, label, sev, list_transform(e, lambda x, i: CASE WHEN i <= 8 * sev THEN 0.0 ELSE x END) AS e FROM o, (VALUES (1), (2)) AS g(sev)),
      n AS (SELECT vec_id, label, sev, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM c),
      s AS (SELECT n.vec_id AS q, n.label AS truth, sev, v.label AS camera_id, v.vec_id AS row_id, list_dot_product(n.u, v.e) AS score FROM n CROSS JOIN v),
      b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY q, sev, camera_id ORDER BY score DESC, row_id) = 1),
      r AS (SELECT *, row_number() OVER (PARTITION BY q, sev ORDER BY score DESC, camera_id, row_id) AS rank FROM b),
      f AS (SELECT q, sev, min(rank) FILTER (camera_id = truth AND rank <= 5) AS found FROM r GROUP BY q, sev)
      SELECT 'cut' AS "group", sev AS severity, count(*) AS n, count(*) FILTER (found = 1) AS top1_hits, count(*) FILTER (found <= 5) AS top5_hits, round_even(count(*) FILTER (found = 1) / count(*), 4) AS top1_rate, round_even(count(*) FILTER (found <= 5) / count(*), 4) AS top5_rate FROM f GROUP BY sev""",
    "identify_fixed": f"WITH {_Q}, {_BEST}, {_RANK.format('b')} SELECT query_id || '#0' AS detection_id, 6 AS x_min, 6 AS y_min, 54 AS x_max, 54 AS y_max, rank, camera_id, round(score, 6) AS score, CAST(camera_id AS VARCHAR) AS name FROM r WHERE rank <= 5 AND score >= 0.3",
    "task_lifecycle": f"WITH {_LIVES} SELECT event_id, CAST(life AS BIGINT) AS life, accepted, status FROM t",
    "task_table": f"""WITH {_LIVES}, m AS (SELECT *, max(life) OVER (PARTITION BY user_id) AS newest FROM t),
      a AS (SELECT user_id, bool_or(gone IS NOT NULL) AS away, max(how) AS how, min(event_id) FILTER (action = 'create') AS created_at, max(begun) AS begun, max(ended) AS ended, max(event_id) FILTER (action = 'update' AND accepted) AS told FROM m WHERE life = newest AND life > 0 GROUP BY user_id),
      b AS (SELECT *, CASE WHEN told IS NULL THEN 0 WHEN how = 'complete' THEN 60 ELSE told % 50 END AS frames, CASE WHEN told IS NULL THEN 0 ELSE 60 END AS frames_total FROM a WHERE NOT away)
      SELECT user_id, CASE WHEN how = 'complete' THEN 'completed' WHEN how = 'fail' THEN 'failed' WHEN begun IS NOT NULL THEN 'processing' ELSE 'pending' END AS status, created_at, coalesce(begun, -1) AS started_at, coalesce(ended, -1) AS completed_at,
        CAST(frames AS BIGINT) AS frames, CAST(frames_total AS BIGINT) AS frames_total, round(coalesce(frames * 100.0::DOUBLE / nullif(frames_total, 0), 0), 2) AS percent FROM b""",
    "frame_timeouts": "SELECT user_id, count(*) AS received, count(*) FILTER (coalesce(value * 100 <= 5000, true)) AS delivered, count(*) FILTER (value * 100 > 5000) AS timeouts FROM events GROUP BY user_id",
    "rate_per_check": "SELECT event_type, time_bucket(INTERVAL 10 SECOND, ts) + INTERVAL 10 SECOND AS check_time, count(*) / 10.0::DOUBLE AS fps FROM events GROUP BY ALL",
    "buffer_metrics": """WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events)
      SELECT user_id, count(*) AS received, count(*) FILTER (event_type <> 'click') AS processed, CAST(round(CAST(coalesce(avg(event_id % 11) FILTER (n <= 100), 0) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS mean_depth, CAST(round(CAST(coalesce(avg(event_id % 997) FILTER (n <= 100 AND event_type <> 'click'), 0) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS mean_ms,
        greatest(count(*) - 10, 0) AS dropped, least(count(*), 10) AS queue_size, round(least(count(*), 10) / 10, 2) AS utilisation FROM n GROUP BY user_id""",
    "stream_first_seen_daily": "SELECT DISTINCT user_id, date_trunc('day', ts) AS day FROM events",
    "stream_task_states": f"WITH {_LIVES} SELECT user_id, arg_max(status, event_id) AS status, count(*) FILTER (NOT accepted) AS refused FROM t GROUP BY user_id",
    "stream_tasks_kept": f"""WITH {_LIVES}, c AS (SELECT user_id, event_id, status, lag(status) OVER (PARTITION BY user_id ORDER BY event_id) AS earlier FROM t),
      b AS (SELECT user_id, event_id FROM c WHERE status IS DISTINCT FROM earlier),
      a AS (SELECT user_id, arg_max(status, event_id) AS status FROM t GROUP BY user_id),
      w AS (SELECT b.user_id, arg_max(epoch_ms(ts), b.event_id) AS since FROM b JOIN events USING (event_id) GROUP BY b.user_id)
      SELECT user_id, CASE WHEN status IN ('completed', 'failed', 'deleted') AND since + 900000 < (SELECT max(epoch_ms(ts)) FROM events) - 86400000 THEN 'expired' ELSE status END AS status FROM a JOIN w USING (user_id)""",
    "stream_timely": "SELECT event_id FROM events WHERE event_id % 9 <= 5",
    "vec_norm": "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings",
    "vec_mean": "SELECT pos, round(avg(x), 6) AS m FROM (SELECT unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY pos",
    "vec_topk_raw": f"WITH {_Q}, {_RANK.format('s')} SELECT query_id, rank, camera_id, row_id, round(score, 6) AS score FROM r WHERE rank <= 5",
    "vec_topk_collapsed": f"WITH {_Q}, {_BEST}, {_RANK.format('b')} SELECT query_id, rank, camera_id, row_id, round(score, 6) AS score, n_name AS name FROM r LEFT JOIN nation ON camera_id = n_nationkey WHERE rank <= 3 AND score >= 0.1",
    "vec_topk_centred": f"""WITH m AS (SELECT list(m ORDER BY pos) AS mean FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY pos)),
      d AS (SELECT vec_id, label, list_transform(list_zip(CAST(embedding AS DOUBLE[]), mean), lambda z: z[1] - z[2]) AS d FROM embeddings CROSS JOIN m),
      v AS (SELECT vec_id, label, list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) AS e FROM d),
      s AS (SELECT n.vec_id AS query_id, v.label AS camera_id, v.vec_id AS row_id, list_dot_product(n.e, v.e) AS score FROM v n CROSS JOIN v WHERE n.vec_id % {EVERY} = 0),
      {_BEST}, {_RANK.format('b')} SELECT query_id, rank, camera_id, row_id, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "vec_orig_reference": "SELECT label AS camera_id, vec_id AS row_id, CASE WHEN vec_id % 2 = 0 THEN 'warp1' ELSE 'orig' END AS variant_tag FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id % 2 = 0, vec_id) = 1",
    "vec_index_stats": "SELECT count(*) AS n_rows, count(DISTINCT label) AS n_products, CAST(max(len(embedding)) AS INTEGER) AS dimension, round(count(*) / count(DISTINCT label), 2) AS rows_per_product FROM embeddings",
    "eval_recall": f"""WITH {_Q}, o AS (SELECT * FROM s WHERE query_id <> row_id), b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id, camera_id ORDER BY score DESC, row_id) = 1), {_RANK.format('b')},
      f AS (SELECT query_id, min(rank) AS found FROM r JOIN embeddings ON query_id = vec_id WHERE camera_id = label AND rank <= 5 GROUP BY 1),
      c AS (SELECT CAST(label AS VARCHAR) AS g, count(*) AS n, count(*) FILTER (found = 1) AS top1_hits, count(*) FILTER (found <= 5) AS top5_hits FROM embeddings LEFT JOIN f ON query_id = vec_id WHERE vec_id % {EVERY} = 0 GROUP BY 1)
      SELECT g AS "group", 1 AS severity, n, top1_hits, top5_hits, round_even(top1_hits / n, 4) AS top1_rate, round_even(top5_hits / n, 4) AS top5_rate FROM c""",
    "frame_sampling": "SELECT event_id, user_id, n AS frame_number FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE (n - 1) % 3 = 0",
    "rolling_mean_100": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 99 PRECEDING), 9) AS rolling_mean FROM events",
    "rolling_fps_30": "SELECT event_id, round(coalesce((count(*) OVER w - 1) * 1e6 / nullif(max(epoch_us(ts)) OVER w - min(epoch_us(ts)) OVER w, 0), 0.0), 8) AS fps FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 29 PRECEDING)",
    "idle_sessions": _SESSIONS.format("<=") + " SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n_frames FROM n GROUP BY user_id, session",
    "session_window_batch": _WINDOWS,
    "tumbling_counts": _DAYS,
    "bounded_buffer_drop_oldest": _BUFFER.format("ts DESC, event_id"),
    "skip_policy": "SELECT event_id, CASE WHEN value = 0 THEN false WHEN value >= 100 THEN false WHEN value / 100 < 0.7 THEN true ELSE (event_id % 10) / 10 > 0.8 END AS skip FROM events",
    "connection_stats": _PER_USER,
    "connection_totals": "SELECT count(DISTINCT user_id) AS connections, count(*) AS received, count(*) FILTER (event_type <> 'click') AS processed, count(*) FILTER (event_type = 'click') AS dropped FROM events",
    "connections_admitted": """WITH RECURSIVE e AS (SELECT event_id, user_id, user_id % 64 AS server, event_id % 3 = 0 AS leaves, row_number() OVER (PARTITION BY user_id % 64 ORDER BY ts, event_id) AS n FROM events),
      f AS (SELECT DISTINCT server, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS outcome, CAST([] AS BIGINT[]) AS held FROM e
        UNION ALL SELECT e.server, e.n, e.event_id,
          CASE WHEN leaves THEN CASE WHEN list_contains(held, user_id) THEN 'closed' ELSE 'absent' END WHEN len(held) >= 5 THEN 'full' WHEN list_contains(held, user_id) THEN 'duplicate' ELSE 'admitted' END,
          CASE WHEN leaves THEN list_filter(held, lambda x: x <> user_id) WHEN len(held) >= 5 OR list_contains(held, user_id) THEN held ELSE list_append(held, user_id) END
        FROM f JOIN e ON e.server = f.server AND e.n = f.n + 1)
      SELECT event_id, server, outcome FROM f WHERE n > 0""",
    "task_state_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "task_status_pivot": " ".join(["SELECT", ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS {s}" for s in "FOPX"), ", count(*) AS total FROM orders"]),
    "ttl_expired": "SELECT event_id, user_id FROM events WHERE event_type <> 'click' AND ts + INTERVAL 15 MINUTE <= TIMESTAMP '2024-01-15'",
    "upload_checks": "SELECT event_id, array_to_string(list_filter([CASE WHEN value * 10000000 > 524288000 THEN 'too_large' END, CASE WHEN event_id % 2 <> 0 THEN 'bad_extension' END, CASE WHEN event_id % 400 > 300 THEN 'too_long' END], lambda x: x IS NOT NULL), ',') AS wrong FROM events",
    "task_progress": "SELECT event_id, round(coalesce((event_id % 7) * 100.0 / nullif(event_id % 3, 0), 0), 2)::DOUBLE AS percent FROM events",
    "stream_tumbling_counts": _DAYS,
    "stream_running_counters": "SELECT user_id, count(*) AS received, max(ts) AS last_activity FROM events GROUP BY user_id",
    "stream_dedup": "SELECT DISTINCT user_id FROM events",
    "stream_sessions": _WINDOWS,
    "stream_bounded_buffer": _BUFFER.format("event_id"),
}
