import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import geometry
from lodestone.functions import vectors as V
from lodestone.operators import evaluation, frames, vectors

INDEX = "row_id long, camera_id string, image_path string, embedding array<float>"


def unit(v):
    return (v / np.linalg.norm(v, axis=-1, keepdims=True)).astype(float)


def index(spark, matrix, ids):
    return spark.createDataFrame([(i, c, f"/{i}.jpg", [float(x) for x in v]) for i, (c, v) in enumerate(zip(ids, matrix))], INDEX)


def asked(spark, v):
    return spark.createDataFrame([(0, [float(x) for x in v])], "query_id long, embedding array<float>")


def test_best_variant_of_each_product(spark):
    rows = index(spark, [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]], ["cam-a", "cam-a", "cam-b"])
    got = vectors.search(asked(spark, [0, 1, 0, 0]), rows, 5).orderBy("rank").collect()
    assert [(r.camera_id, r.row_id, r.score) for r in got][0] == ("cam-a", 1, 1.0) and len(got) == 2
    assert vectors.search(asked(spark, [0, 1, 0, 0]), rows, 0).count() == 0
    assert vectors.search(asked(spark, [0, 1, 0, 0]), rows, 5, threshold=0.5).count() == 1
    joined = vectors.enrich(vectors.search(asked(spark, [0, 1, 0, 0]), rows, 5), spark.createDataFrame([("cam-a", "A")], "camera_id string, name string"))
    assert {r.camera_id: r.name for r in joined.collect()} == {"cam-a": "A", "cam-b": None}


def test_ties_go_to_the_first_row_and_product(spark):
    rows = index(spark, [[1, 0]] * 6, ["b", "b", "a", "a", "c", "c"])
    got = vectors.search(asked(spark, [1, 0]), rows, 2).orderBy("rank").collect()
    assert [(r.camera_id, r.row_id) for r in got] == [("a", 2), ("b", 0)]


def test_against_numpy_in_several_shards_and_centred(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 7)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(3)
    m, q = unit(rng.normal(size=(30, 16))), rng.normal(size=(5, 16))
    rows = index(spark, m, [f"c{i // 3:02d}" for i in range(30)])
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    stored = np.array([r.embedding for r in rows.orderBy("row_id").collect()])
    for mean in (None, stored.mean(axis=0)):
        a = stored if mean is None else unit(stored - mean)
        b = unit(q) if mean is None else unit(q - mean)
        best = (b @ a.T).reshape(5, 10, 3).max(axis=2)
        got = vectors.search(queries, rows, 4, mean=None if mean is None else vectors.mean_vector(rows)).orderBy("query_id", "rank").collect()
        for i in range(5):
            order = np.argsort(-best[i])[:4]
            mine = [r for r in got if r.query_id == i]
            assert [r.camera_id for r in mine] == [f"c{j:02d}" for j in order]
            assert np.allclose([r.score for r in mine], best[i][order], atol=1e-6)


def test_bad_queries_and_indexes_raise(spark):
    rows = index(spark, [[1, 0]], ["a"])
    with pytest.raises(PySparkException, match="zero norm"):
        vectors.search(asked(spark, [0, 0]), rows).collect()
    with pytest.raises(PySparkException, match="dimensions"):
        vectors.search(asked(spark, [1, 0, 0]), rows).collect()
    assert vectors.check_index(rows) == 2
    with pytest.raises(ValueError):
        vectors.check_index(rows.limit(0))
    with pytest.raises(ValueError):
        vectors.check_index(rows.drop("camera_id"))
    with pytest.warns(UserWarning):
        assert vectors.centred(rows, None) is rows


def test_build_and_reference(spark):
    images = spark.createDataFrame([("a", "p", "s", b"\x01\x02"), ("b", "q", "s", b"")], "camera_id string, image_path string, source string, content binary")
    embed = lambda contents, tag="orig": [[float(x) for x in c] + [len(tag)] if c else None for c in contents]
    built = vectors.build_index(images, embed, ["warp1"])
    assert {(r.camera_id, r.variant_tag) for r in built.collect()} == {("a", "orig"), ("a", "warp1")}
    assert vectors.reference_rows(built).first().variant_tag == "orig"
    assert vectors.index_stats(built).first().rows_per_product == 2.0


def test_synthetic_recall_is_repeatable(spark):
    rng = np.random.default_rng(1)
    rows = index(spark, unit(rng.normal(size=(12, 16))), [f"c{i}" for i in range(12)])
    once = sorted(map(tuple, evaluation.synthetic(rows, ["noise", "mask"], [1, 2]).collect()))
    again = sorted(map(tuple, evaluation.synthetic(rows.repartition(5), ["noise", "mask"], [1, 2]).collect()))
    assert once == again and len(once) == 4 and all(r[2] == 12 for r in once)
    assert evaluation.recipes(2)[0][0] == "perspective_warp"
    probes = rows.selectExpr("image_path image", "camera_id", "'v' vendor", "embedding").unionByName(spark.createDataFrame([("x", "c0", "v", None)], "image string, camera_id string, vendor string, embedding array<float>"))
    report, skipped = evaluation.probe(probes, rows)
    assert skipped == 1 and report.first().top1_rate == 1.0
    assert "top-1" in evaluation.format_summary(report.collect(), "t")


def frames_of(spark, stamps, client="c"):
    return spark.createDataFrame([(client, float(t), i) for i, t in enumerate(stamps)], "client string, t double, n long").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))


def test_fps_and_buffer(spark):
    fps = [r.fps for r in frames.rolling_fps(frames_of(spark, [0, 0, 0.1, 0.2]), "client", "ts", "n").orderBy("n").collect()]
    assert fps[:2] == [0.0, 0.0] and math.isclose(fps[3], 15.0)
    kept = frames.bounded_buffer(frames_of(spark, range(10)), "client", "n", capacity=3).collect()
    assert sorted(r.n for r in kept) == [7, 8, 9] and kept[0].dropped == 7
    assert [r.frame_number for r in frames.sampled(frames_of(spark, range(7)), "client", 30, 10, "n").orderBy("n").collect()] == [1, 4, 7]


def test_skip_sessions_expiry(spark):
    skip = lambda a, b, u: spark.range(1).select(frames.should_skip(F.lit(a), F.lit(b), F.lit(u))).first()[0]
    assert [skip(0.0, 10.0, 1.0), skip(10.0, 10.0, 1.0), skip(6.9, 10.0, 0.0), skip(8.0, 10.0, 0.9), skip(8.0, 10.0, 0.8)] == [False, False, True, True, False]
    sessions = frames.idle_sessions(frames_of(spark, [0, 10, 40, 71]), "client", "ts", "n").orderBy("session").collect()
    assert [r.n_frames for r in sessions] == [3, 1]
    tasks = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00'), (2, timestamp'2024-01-01 00:10:00'), (3, null) t(id, done)")
    assert [r.id for r in frames.expired(tasks, "done", F.lit("2024-01-01 00:15:00").cast("timestamp")).collect()] == [1]
    wrong = spark.range(1).select(frames.upload_errors(F.lit(10**9), F.lit("a.txt"), F.lit("text/plain"), F.lit(301))).first()[0]
    assert wrong == ["too_large", "bad_extension", "bad_type", "too_long"]


def test_boxes(spark):
    b = geometry.box(F.lit(0.5), F.lit(1.5), F.lit(10), F.lit(20))
    got = spark.range(1).select(geometry.expand(b, 0.25).alias("e"), geometry.clamp(geometry.expand(b, 0.25), F.lit(8), F.lit(8)).alias("c"), geometry.valid(b).alias("v")).first()
    assert tuple(got.e) == (-2, -2, 12, 24) and tuple(got.c) == (0, 0, 8, 8) and got.v


def simulate(actions):
    """A task's events one after the other."""
    status, life, out = None, 0, []
    for a in actions:
        ok = a == "create" or status is not None and status != "deleted" and (a == "delete" or a == "start" and status == "pending" or a in ("update", "complete", "fail") and status == "processing")
        if ok:
            life += a == "create"
            status = {"create": "pending", "start": "processing", "update": status, "complete": "completed", "fail": "failed", "delete": "deleted"}[a]
        out.append((life, ok, status))
    return out


def test_task_transitions_match_a_simulation(spark):
    rng = random.Random(4)
    logs = {t: [rng.choice(["create", "start", "start", "update", "complete", "fail", "delete", "odd"]) for _ in range(rng.randrange(1, 25))] for t in range(120)}
    rows = [(t, i, a, i, 30) for t, log in logs.items() for i, a in enumerate(log)]
    moves = frames.task_transitions(spark.createDataFrame(rows, "task long, at long, action string, done long, total long"), "task", "action", "at")
    got = {(r.task, r.at): (r.life, r.accepted, r.status) for r in moves.collect()}
    want = {(t, i): x for t, log in logs.items() for i, x in enumerate(simulate(log))}
    assert got == want
    tasks = {r.task: r for r in frames.task_table(moves, "task", "action", "at", "done", "total").collect()}
    assert {t: r.status for t, r in tasks.items()} == {t: s for t, log in logs.items() if (s := simulate(log)[-1][2]) not in (None, "deleted")}
    assert all(r.frames == r.frames_total for r in tasks.values() if r.status == "completed")


def test_timeouts_and_metrics(spark):
    rows = spark.createDataFrame([("a", i, 4000.0 + 1000 * (i % 3)) for i in range(12)] + [("b", 0, None)], "k string, at long, ms double")
    got = {r.k: (r.received, r.delivered, r.timeouts) for r in frames.frame_timeouts(rows, "k", F.col("ms")).collect()}
    assert got == {"a": (12, 8, 4), "b": (1, 1, 0)}
    m = {r.k: r for r in frames.buffer_metrics(rows, "k", F.col("at"), F.col("ms"), "at", samples=3).collect()}
    assert (m["a"].received, m["a"].processed, m["a"].dropped, m["a"].mean_depth, m["a"].mean_ms, m["a"].queue_size, m["a"].utilisation) == (12, 12, 2, 10.0, 5000.0, 10, 1.0)
    assert (m["b"].processed, m["b"].mean_ms, m["b"].utilisation) == (0, 0.0, 0.1)


def test_long_histories_are_dealt_over_runs(spark, monkeypatch):
    """Runs and intervals much shorter than a history give what one window over all of it gives; null is a key too."""
    monkeypatch.setattr(frames, "RUN_ROWS", 7)
    monkeypatch.setattr(frames, "INTERVAL_SECONDS", 20)
    rng = random.Random(3)
    rows = [(k, i, 1_700_000_000 + rng.randrange(0, 400), float(rng.randrange(100))) for k in ("hot", "cold", None) for i in range({"hot": 150, "cold": 3, None: 40}[k])]
    df = spark.createDataFrame(rows, "k string, id long, s long, value double").selectExpr("k", "id", "timestamp_seconds(s) ts", "value")
    w = Window.partitionBy("k").orderBy("ts", "id")
    last = lambda n: w.rowsBetween(-(n - 1), 0)
    micros = F.unix_micros("ts")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))
    for n in (1, 5, 7):
        assert same(frames.rolling_mean(df, "k", "value", "ts", "id", n=n), df.withColumn("rolling_mean", F.avg("value").over(last(n))))
    span = (F.max(micros).over(last(6)) - F.min(micros).over(last(6))).cast("double")
    assert same(frames.rolling_fps(df, "k", "ts", "ts", "id", n=6), df.withColumn("fps", F.coalesce(F.try_divide((F.count("*").over(last(6)) - 1) * 1e6, span), F.lit(0.0))))
    assert same(frames.sampled(df, "k", 30.0, 10.0, "ts", "id"), df.withColumn("frame_number", F.row_number().over(w).cast("long")).where("frame_number % 3 = 1"))
    new = F.when(micros - F.lag(micros).over(w) <= 5_000_000, 0).otherwise(1)
    one = df.withColumn("n", new).withColumn("session", F.sum("n").over(last(1 << 30))).groupBy("k", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n_frames"))
    assert same(frames.idle_sessions(df, "k", "ts", "id", gap_seconds=5), one)


def admitted_one_by_one(rows, capacity):
    """rows: (pool, order, key, action), in any order."""
    held, out = {}, {}
    for pool, at, key, action in sorted(rows, key=lambda r: r[:2]):
        mine = held.setdefault(pool, set())
        if action == "connect":
            out[pool, at] = "full" if len(mine) >= capacity else "duplicate" if key in mine else "admitted"
            if out[pool, at] == "admitted":
                mine.add(key)
        elif action == "disconnect":
            out[pool, at] = "closed" if key in mine else "absent"
            mine.discard(key)
    return out


@pytest.mark.parametrize("leaving", [0.2, 0.5, 0.8])
def test_admission_frees_places(spark, monkeypatch, leaving):
    """Pools that are often empty and pools that never are; one pool and one client hold a third of all events."""
    monkeypatch.setattr(frames, "INTERVAL_NUMBERS", 9)
    rng = random.Random(int(10 * leaving))
    rows = [(0 if i % 3 == 0 else rng.randrange(4), i, "a" if i % 3 == 0 and rng.random() < 0.7 else rng.choice("abcdefgh"), rng.choices(["disconnect", "connect", "other"], [leaving, 1 - leaving, 0.05])[0]) for i in range(400)]
    df = spark.createDataFrame(rows, "pool long, at long, who string, what string")
    got = {(r.pool, r.at): r.outcome for r in frames.admissions(df, "pool", "who", "what", "at", capacity=3).collect()}
    assert got == admitted_one_by_one(rows, 3)
    assert leaving < 0.5 or {"admitted", "duplicate", "closed", "absent"} <= set(got.values())


def test_one_task_with_all_events_is_dealt(spark, monkeypatch):
    """No window over a whole task: intervals of ten events give the rows of one event after the other."""
    monkeypatch.setattr(frames, "INTERVAL_NUMBERS", 10)
    rng = random.Random(9)
    log = [rng.choice(["create", "start", "start", "update", "complete", "fail", "delete"]) for _ in range(500)]
    rows = spark.createDataFrame([("hot", i, a, i % 50, 60) for i, a in enumerate(log)], "task string, at long, action string, done long, total long")
    moves = frames.task_transitions(rows, "task", "action", "at")
    assert [(r.life, r.accepted, r.status) for r in moves.orderBy("at").collect()] == simulate(log)
    assert "partitionBy" not in moves._jdf.queryExecution().toString() and "Window" not in moves._jdf.queryExecution().executedPlan().toString()
    m = frames.buffer_metrics(rows, "task", F.col("done"), F.col("total"), "at", samples=7).first()
    assert (m.received, m.mean_depth, m.mean_ms, m.dropped) == (500, round(sum(i % 50 for i in range(493, 500)) / 7, 2), 60.0, 490)


def test_equal_vectors_send_k_rows(spark):
    """Ties beyond k don't leave a shard, and rank as over one list of all rows."""
    assert len(vectors._top(np.ones(3000), 5)) == 5 and vectors._top(np.ones(3000), 5).tolist() == [0, 1, 2, 3, 4]
    rows = index(spark, [[1.0, 0.0]] * 300, [f"c{i % 40:02d}" for i in range(300)])
    got = vectors.search(asked(spark, [1, 0]), rows, k=5).orderBy("rank").collect()
    assert [r.camera_id for r in got] == [f"c0{i}" for i in range(5)]
    raw = vectors.search(asked(spark, [1, 0]), rows, k=5, collapse=False).collect()
    assert {r.camera_id for r in raw} == {"c00"} and len(raw) == 5


@pytest.mark.parametrize("collapse", [False, True])
def test_a_block_of_queries_needs_bounded_memory(collapse):
    rng = np.random.default_rng(5)
    part = pd.DataFrame({"row_id": np.arange(16384), "camera_id": np.arange(16384) % 9, "embedding": list(unit(rng.normal(size=(16384, 8))))})
    block = pd.DataFrame({"query_id": np.arange(1024), "embedding": list(rng.normal(size=(1024, 8)))})
    part.at[900, "embedding"] = part.at[9, "embedding"]  # of the same product
    block.at[3, "embedding"] = part.at[9, "embedding"] * 100
    tracemalloc.start()
    got = vectors._block_best(part, block, 5, collapse, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6  # all scores would be 134 MB, more than once
    scores = np.array(block["embedding"].tolist()) @ np.array(part["embedding"].tolist()).T
    for j in (0, 511, 1023):
        best = np.argsort(-scores[j], kind="stable")
        best = list(dict.fromkeys(i % 9 for i in best))[:5] if collapse else best[:5]
        mine = got[got["query_id"] == j]
        assert (mine["camera_id"] if collapse else mine["row_id"]).tolist() == list(best)
    assert got[got["query_id"] == 3]["row_id"].tolist()[0] == 9


def test_equal_vectors_have_equal_scores_wherever_they_are():
    v = np.random.default_rng(8).normal(size=61)
    part = pd.DataFrame({"row_id": np.arange(5003), "camera_id": "c", "embedding": [v] * 5003})
    block = pd.DataFrame({"query_id": np.arange(7), "embedding": list(np.random.default_rng(9).normal(size=(7, 61)))})
    got = vectors._block_best(part, block, 4, False, True)
    assert [got[got["query_id"] == j]["row_id"].tolist() for j in (0, 2, 6)] == [[1, 2, 3, 4], [0, 1, 3, 4], [0, 1, 2, 3]]


@pytest.mark.parametrize("scaled", [V.unit, V.unit_or_zero])
def test_a_vector_is_measured_once_and_not_for_each_component(spark, scaled):
    """Within a lambda, lengths and differences would be computed for each component: 64 times as long for 64 of them."""
    rows = spark.createDataFrame([(1, [3.0, 0.0, 4.0]), (2, None)], "id long, v array<double>")
    found = rows.withColumn("u", scaled(V.minus(F.col("v"), F.array(*[F.lit(0.0)] * 3))))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.count("zip_with(") == 1
    assert [r.u for r in found.orderBy("id").collect()] == [[0.6, 0.0, 0.8], None]
    zero = rows.select(scaled(F.array(F.lit(0.0), F.lit(0.0))).alias("u"))
    if scaled is V.unit:
        with pytest.raises(PySparkException, match="zero norm"):
            zero.collect()
    else:
        assert zero.first().u == [0.0, 0.0]


@pytest.mark.parametrize("query", ["identify_fixed", "vec_topk_collapsed", "eval_probe"])
def test_searches_of_products_need_bounded_memory_with_any_ids(query):
    """Ids as each query has them: text for boxes, numbers, text for probes and rows."""
    rng = np.random.default_rng(6)
    text = lambda ids: ids.astype(str).astype(object)
    rows, asks = np.arange(16384), np.arange(1024)
    part = pd.DataFrame({"row_id": text(rows) if query == "eval_probe" else rows, "camera_id": text(rows % 9) if query == "eval_probe" else rows % 9, "embedding": list(unit(rng.normal(size=(16384, 8))))})
    block = pd.DataFrame({"query_id": asks if query == "vec_topk_collapsed" else text(asks), "embedding": list(rng.normal(size=(1024, 8)))})
    tracemalloc.start()
    got = vectors._block_best(part, block, 3, True, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6 and len(got) == 3 * 1024
    best = pd.Series(np.array(part["embedding"].tolist()) @ block["embedding"][7]).groupby(part["camera_id"]).max().nlargest(3)
    mine = got[got["query_id"].astype(str) == "7"]
    assert mine["camera_id"].tolist() == best.index.tolist() and np.allclose(mine["score"], best)
