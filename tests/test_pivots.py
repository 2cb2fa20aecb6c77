import numpy as np
import pytest
from pyspark.errors import PySparkException

from lodestone.operators import pivots, vectors
from lodestone.operators.pivots import PivotIndex

ROWS = "row_id long, camera_id string, embedding array<double>"


def frame(spark, matrix, per=3):
    return spark.createDataFrame([(i, f"c{i // per:04d}", None if v is None else [float(x) for x in v]) for i, v in enumerate(matrix)], ROWS)


def asked(spark, matrix):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "query_id long, embedding array<double>")


def plain(df):
    return sorted((r.query_id, r["rank"], r.camera_id, r.row_id, round(r.score, 9)) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(40, 16))
    m = middles[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 16)) * 0.05
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.mark.parametrize("collapse,exclude_self,threshold", [(True, False, None), (False, True, None), (True, True, 0.98)])
def test_same_rows_as_the_search_of_everything(spark, clustered, tmp_path, monkeypatch, collapse, exclude_self, threshold):
    for module in (vectors, pivots):
        monkeypatch.setattr(module, "SHARD_ROWS", 64)
        monkeypatch.setattr(module, "QUERY_BLOCK", 7)
    rows, queries = frame(spark, clustered), asked(spark, clustered[:60])
    index = PivotIndex.build(rows, str(tmp_path / "i"), cells=160)
    want = vectors.search(queries, rows, 4, threshold, collapse, exclude_self=exclude_self)
    assert plain(index.search(queries, 4, threshold, collapse, exclude_self)) == plain(want)
    assert index.products() < 0.3 * 60 * 2000, index.products()


def test_without_structure_nothing_is_lost(spark, tmp_path):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(300, 24)) * rng.uniform(0.1, 3, size=(300, 1))  # of any length
    m[5] = m[77] = 0
    rows, queries = frame(spark, m), asked(spark, rng.normal(size=(9, 24)))
    index = PivotIndex.build(rows, str(tmp_path / "i"), cells=16)
    assert plain(index.search(queries, 120)) == plain(vectors.search(queries, rows, 120))
    assert index.products() == 9 * 300


def test_odd_indexes(spark, tmp_path):
    same = PivotIndex.build(frame(spark, [[1.0, 0.0]] * 200 + [None]), str(tmp_path / "s"))  # one vector, and a row without
    assert [r[1:4] for r in plain(same.search(asked(spark, [[2.0, 0.0]]), 3))] == [(1, "c0000", 0), (2, "c0001", 3), (3, "c0002", 6)]
    zeros = PivotIndex.build(frame(spark, [[0.0, 0.0]] * 4), str(tmp_path / "z"))
    assert [r[1:] for r in plain(zeros.search(asked(spark, [[1.0, 0.0]]), 2))] == [(1, "c0000", 0, 0.0), (2, "c0001", 3, 0.0)]
    empty = PivotIndex.build(frame(spark, [None]), str(tmp_path / "e"))
    assert empty.search(asked(spark, [[1.0, 0.0]]), 2).count() == 0 and empty.products() == 0
    assert same.search(asked(spark, [[1.0, 0.0]]).limit(0), 2).count() == 0
    with pytest.raises(PySparkException, match="dimensions"):
        same.search(asked(spark, [[1.0, 0.0, 0.0]]), 2).collect()
