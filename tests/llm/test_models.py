import math
import random
import zlib

import numpy as np
import pytest
from helpers import ODD, ODD_IDS, documents

from lodestone.llm import quality, toxicity

INSULTS = ["zark", "blorp", "quell"]


def corpus(n=1200):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    texts, toxic, good = [], [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        bad, poor = i % 5 == 0, i % 7 == 0
        if bad:
            body[rng.randrange(len(body))] = rng.choice(INSULTS)
        texts.append(" ".join(w.upper() + "!!" for w in body) if poor else " ".join(body).capitalize() + ".")
        toxic.append(int(bad))
        good.append(int(not poor))
    return texts, toxic, good


def tables(spark, n=1200):
    texts, toxic, good = corpus(n)
    docs = documents(spark, texts + ODD, list(range(100, 100 + n)) + ODD_IDS)
    return docs, spark.createDataFrame([(100 + i, q, t) for i, (q, t) in enumerate(zip(good, toxic))] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")


def accuracy(rows, truth):
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    return sum(a == b for a, b in held) / len(held)


def test_toxicity_holds_out_and_generalises(spark):
    docs, labels = tables(spark)
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert accuracy(rows, {100 + i: t for i, t in enumerate(corpus()[1])}) > 0.97


def test_toxicity_needs_both_classes(spark):
    docs, labels = tables(spark, 40)
    assert {r.score < 1e-6 for r in toxicity.score_toxicity(docs, labels.where("toxic = 0")).collect()} == {True}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.score_toxicity(docs, labels.limit(0)).count() == docs.count()


@pytest.mark.parametrize(("sf", "auc", "recall", "precision"), [("0.1", 0.97, 0.88, 0.95), ("0.01", 0.9, 0.5, 0.7)])
def test_toxicity_on_the_given_tables(spark, sf, auc, recall, precision):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    held = [(r.score, r.predicted, truth[r.doc_id]) for r in toxicity.score_toxicity(docs, labels).collect() if r.held_out and r.doc_id in truth]
    bad, good = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    found = sum(p for _, p, y in held if y) / len(bad)
    right = sum(p for _, p, y in held if y) / max(1, sum(p for _, p, _ in held))
    ranked = np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good])
    print(f"sf{sf}: AUC {ranked:.4f}, recall {found:.3f}, precision {right:.3f}")
    assert ranked >= auc and found >= recall and right >= precision


def test_pairs_beyond_single_terms():
    """Two terms that are harmless alone and toxic together: weights alone can't tell."""
    rng = random.Random(1)
    rows = []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append((int(a and b), [1] * a + [2] * b + [rng.randrange(10, 40)]))
    machine = toxicity.fit_machine(rows, 0.25, steps=400)
    scores = [machine.score(set(x)) for x in ([1, 2], [1], [2], [])]
    assert scores[0] > 0.9 and max(scores[1:]) < 0.2


def test_pairs_of_terms_that_tell_nothing_alone(spark, monkeypatch):
    """Toxic where alpha and beta come together or are both absent: each alone says nothing, and many random
    words stand out more by chance than the model has places for. Frequent terms of toxic documents stay."""
    monkeypatch.setattr(toxicity, "SIZES", ((20, 0), (40, 40)))
    rng = random.Random(8)
    texts, toxic = [], []
    for _ in range(2400):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(["alpha"] * a + ["beta"] * b + [f"{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}{chr(97 + n // 676)}word" for n in (rng.randrange(900) for _ in range(6))]))
        toxic.append(int(a == b))
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, labels, toxicity.fold(4) != 2)
    assert {*toxicity.word_buckets("alpha"), *toxicity.word_buckets("beta")} <= machine.terms.keys() and len(machine.terms) <= 80
    scores = [machine.score(toxicity.buckets_of(t)) for t in ("alpha beta", "alpha", "beta", "")]
    assert min(scores[0], scores[3]) > max(scores[1], scores[2]) + 0.2, scores


def test_repeated_ids_do_not_lift_the_sample_bound(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "POSITIVES", 7)
    docs = documents(spark, [f"text number {i}" for i in range(90)], [i % 3 for i in range(90)])
    labels = spark.createDataFrame([(i % 3, 0, int(i % 3 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample(docs, labels, "toxic", {1: 7, 0: 11}, toxicity.fold(4) != 99)
    assert sorted((r.label, r["count"]) for r in sample.groupBy("label").count().collect()) == [(0, 11), (1, 7)]


def test_scores_equal_the_plain_formula(spark):
    """Bias, weights and the inner product of every pair, one by one."""
    docs, labels = tables(spark, 400)
    machine = toxicity.train(docs, labels, toxicity.fold(4) != 2)
    by_id = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None and r.doc_id >= 100}
    for r in toxicity.score_toxicity(docs, labels).where("doc_id % 20 = 0 and doc_id >= 100").collect():
        at = [machine.terms[b] for b in toxicity.buckets_of(by_id[r.doc_id]) if b in machine.terms]
        z = machine.bias + sum(machine.weights[i] for i in at) + sum(float(machine.factors[i] @ machine.factors[j]) for i in at for j in at if i < j)
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_quality_scores_equal_a_plain_fit(spark):
    """All rows at once in NumPy: moments, ridge by least squares on stacked rows, PAV by trying every block."""
    docs, labels = tables(spark, 600)
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    stats = {i: np.array(quality.statistics(t)) for i, t in rows}
    fold = {i: zlib.crc32(str(i).encode()) % quality.FOLDS for i in stats}
    mine = [i for i in stats if i in known and fold[i] not in (quality.HELD_OUT, quality.CALIBRATE)]
    x, y = np.stack([stats[i] for i in mine]), np.array([known[i] for i in mine], float)
    fourier = quality.Fourier(x.mean(axis=0), x.std(axis=0))
    z = fourier(x)
    beta = np.linalg.lstsq(np.vstack([z, np.sqrt(quality.RIDGE * len(z)) * np.eye(z.shape[1])]), np.append(y, np.zeros(z.shape[1])), rcond=None)[0]
    raw = {i: float((fourier(s[None]) @ beta)[0]) for i, s in stats.items()}
    bins = {}
    for i in stats:
        if i in known and fold[i] == quality.CALIBRATE:
            bins.setdefault(math.floor((min(max(raw[i], -0.5), 1.4999) + 0.5) / 2 * quality.BINS), []).append((raw[i], known[i]))
    blocks = [(np.mean([r for r, _ in b]), len(b), sum(q for _, q in b)) for _, b in sorted(bins.items())]
    # isotonic values by the max-min formula
    n, total = np.array([b[1] for b in blocks], float), np.array([b[2] for b in blocks], float)
    iso = [max(min(total[s : e + 1].sum() / n[s : e + 1].sum() for e in range(k, len(n))) for s in range(k + 1)) for k in range(len(n))]
    groups = {}
    for k, v in enumerate(iso):
        groups.setdefault(round(v, 12), []).append(k)
    knots = [(sum(blocks[k][0] * n[k] for k in g) / n[g].sum(), (total[g].sum() + 0.02) / (n[g].sum() + 0.04)) for g in groups.values()]
    want = {i: min(max(float(np.interp(r, *zip(*knots))), 0), 1) for i, r in raw.items()}
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect() if r.doc_id is not None}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-5


def test_quality_holds_out_and_generalises(spark):
    docs, labels = tables(spark)
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert accuracy(rows, {100 + i: q for i, q in enumerate(corpus()[2])}) > 0.97
    kept = quality.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)


def test_quality_without_labels_rejects_nothing(spark):
    docs, labels = tables(spark, 30)
    assert quality.drop_low_quality(docs, labels.limit(0)).count() == docs.count()
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_normal_equations_equal_the_plain_ones(spark):
    rng = np.random.default_rng(0)
    stats, y = rng.normal(size=(50, quality.STATS)), rng.integers(0, 2, 50)
    rows = spark.createDataFrame([(int(a), [float(v) for v in s]) for a, s in zip(y, stats)], "label int, stats array<double>").repartition(3)
    fourier = quality.Fourier(stats.mean(axis=0), stats.std(axis=0))
    a, b = quality.normal_equations(rows, fourier)
    z = fourier(stats)
    assert np.allclose(a, z.T @ z) and np.allclose(b, z.T @ y)


def test_pooled_is_monotone_and_keeps_the_sum():
    rng = random.Random(2)
    bins = [(i / 50, rng.randrange(1, 30), 0.0) for i in range(50)]
    bins = [(c, n, float(rng.randrange(n + 1))) for c, n, _ in bins]
    x, y = quality.pooled(bins)
    assert (np.diff(x) > 0).all() and (np.diff(y) > -0.02).all() and len(x) <= 50


@pytest.mark.parametrize("text", ODD)
def test_statistics_are_finite(text):
    assert len(quality.statistics(text)) == quality.STATS and np.isfinite(quality.statistics(text)).all()
