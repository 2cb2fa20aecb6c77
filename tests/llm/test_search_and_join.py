import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from helpers import ODD, ODD_IDS, documents

from lodestone.llm import decontaminate, topk

UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute_topk(rows, k=5, every=50):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * x) for x in v]
            whole[i] = min(q, whole.get(i, q))
    out = []
    for i in sorted(whole):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[i], v)), j) for j, v in whole.items() if j != i and len(v) == len(whole[i]))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return out


def test_topk_is_exact_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 3)
    monkeypatch.setattr(topk, "FIRST_ROWS", 30)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in base[i % 6] + rng.normal(0, 0.2, 8)]) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(60)] + [(50, rows[51][1]), (7, None), (None, rows[3][1]), (400, [1.0, None] + [0.0] * 6), (450, [float("nan")] * 8), (500, [float("inf")] * 8), (550, [1.0, 2.0]), (600, [])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = sorted(map(tuple, topk.exact_topk(table).collect()))
    assert got == brute_topk([(i, v) for i, v in rows])
    assert topk.exact_topk(table.limit(0)).count() == 0


def test_bounds_lose_nothing(monkeypatch):
    monkeypatch.setattr(topk, "FIRST_STRIDE", 32)
    monkeypatch.setattr(topk, "STRIDE", 64)
    rng = np.random.default_rng(5)
    for dims in (1, 2, 16, 64):
        rows = rng.integers(-128, 128, (500, dims))
        rows[::7] = rows[0]
        shard = topk.Shard(np.arange(500), rows)
        for q in rows[:20]:
            want = sorted((-int(r @ q), i) for i, r in enumerate(rows) if i != 3)[:5]
            for floor in (None, -want[-1][0], -want[-1][0] - 1):
                ids, scores, _ = shard.best(3, q, 5, floor)
                assert [(-s, i) for i, s in zip(ids, scores)] == want
            ids, scores, _ = shard.best(3, q, 5, 1 - want[-1][0])  # others reach more than the fifth
            assert [(-s, i) for i, s in zip(ids, scores)] == [w for w in want if w[0] < want[-1][0]]


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_bounds_save_products_on_the_given_tables(spark, sf):
    """With the registered query's own parameters: fewer products than all, in the first bound's other shards above all."""
    table = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    found = topk.shard_results(table).collect()
    computed = sum(r.score for r in found if r.vec_id is None)
    n, dims = table.count(), len(table.first().embedding)
    queries = len({r.query_id for r in found})
    assert computed < 0.95 * n * dims * queries
    print(f"sf{sf}: {computed / (n * dims * queries):.3f} of all products")


def test_threshold_saves_probes():
    """Vectors of falling scale: most lie below what the first ones reach."""
    rng = np.random.default_rng(1)
    rows = np.round(rng.normal(0, 1, (8192, 64)) * 256 / np.arange(1, 65)).astype(np.int64)
    _, _, products = topk.Shard(np.arange(8192), rows).best(-1, rows[17], 5)
    assert products < 0.7 * rows.size


def test_scores_are_exact_up_to_64_bits(spark):
    base = [10_000_000.25, -123.75, 9.5, 7.0]
    rows = [(i, [x + i for x in base]) for i in range(120)]
    big = [(200, [2.0**22, 2.0**22]), (250, [2.0**22, 2.0**22 - 1]), (251, [-(2.0**22), -(2.0**22)])]
    for part in (rows, big):
        table = spark.createDataFrame(part, "vec_id long, embedding array<double>")
        got = sorted(map(tuple, topk.exact_topk(table).collect()))
        assert got == brute_topk(part) and max(abs(s) for *_, s in got) > 1 << 53
    over = spark.createDataFrame([(0, [2.0**24] * 2), (1, [2.0**24] * 2)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.exact_topk(over).collect()


def test_topk_equals_its_sql_on_odd_rows(spark, tmp_path):
    rows = [(i, [float((i * 7 + j) % 5) for j in range(4)]) for i in range(101)] + [(100, [0.0] * 4), (None, [1.0] * 4), (102, None), (103, [1.0, None, 0.0, 0.0]), (104, [float("inf")] * 4), (150, [1.0]), (151, [2.0]), (200, []), (201, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    table.write.parquet(str(tmp_path / "e"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
        want = sorted(db.execute(topk.ORACLE_SQL).fetchall())
    assert sorted(map(tuple, topk.exact_topk(table).collect())) == want


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute_hits(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        for i in range(max(len(w) - 9, 1)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        names = sorted(str(x) for x in found if x is not None)
        out.append(str([doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)]))
    return sorted(out)


def case(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "the"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.choice([1, 2, 3, 9, 10, 11, 25]))) for i in range(12)] + [(50, None), (51, " ,. "), (None, make(12)), (3, make(14))]
    texts = [make(30) for _ in range(25)] + [f"{make(5)}, {t} {make(5)} {t}" for _, t in items if t] + [items[4][1]] * 3
    return list(enumerate(texts, 100)) + list(zip(ODD_IDS, ODD)), items


def test_windows_match_brute_force(spark, monkeypatch):
    for seed, bound in ((1, 1_000_000), (2, 0)):  # 0: the way without broadcasts
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", bound)
        docs, items = case(seed)
        table = documents(spark, [t for _, t in docs], [d for d, _ in docs])
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = decontaminate.decontaminate(table, bench).drop("text_hash").collect()
        assert sorted(str(list(r)) for r in got) == brute_hits(docs, items)
        kept = decontaminate.drop_contaminated(table, bench)
        assert kept.columns == table.columns and kept.count() == sum(not r.contaminated for r in got)


def test_a_window_of_very_many_items(spark):
    """A sentence that all items share: their ids are joined to the documents that have it, not sent along."""
    shared = " ".join(f"common{i}" for i in range(10))
    bench = spark.createDataFrame([(i, shared) for i in range(5000)], "item_id long, text string")
    texts = [f"before {shared} after", "nothing of it", shared]
    got = decontaminate.decontaminate(documents(spark, texts), bench).drop("text_hash").collect()
    assert sorted(str(list(r)) for r in got) == brute_hits(list(enumerate(texts)), [(i, shared) for i in range(5000)])


def test_empty_tables(spark):
    docs, bench = documents(spark, ["a b c", None]), spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in decontaminate.decontaminate(docs, bench).collect()] == [False, False]
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
