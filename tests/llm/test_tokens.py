import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, ODD_IDS, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import test_simhash
from lodestone.llm import common, packing, quality, simhash, store
from lodestone.sources.shared import scratch
from lodestone.llm.tokens import Encoder, default_vocabulary, encoder, slices

TRICKY = ["", " ", "\n", "a  b", " lead", "trail ", "x\n\ny", "\n\n a", "tab\t here", "\t\n b", "don't  you're", "a b 　c", "²½ Ⅷ 12ab_x", "Ünïcode’s", "<|endoftext|> x", "a \n b", "a\r\nb", "\x1c x \x1f", "日本語 テキスト", "😀 😀!", "..., ,x", "A" * 3000, " " * 50 + "z"]


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = True
    return t


def ids_of(whole, text):
    return whole.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def test_pieces_encode_as_the_whole(whole):
    rng = random.Random(1)
    parts = ["a", "B", "é", "ß", " ", "  ", "\n", "\t", ".", "!", "'s", "1", "23", "_", "-", " ", " ", "日", "²", "\r"]
    texts = TRICKY + [t or "" for t in ODD] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(2000)]
    enc = Encoder(default_vocabulary())
    for rows in (100, 3000, 1):
        got = [x.tolist() for i in range(0, len(texts), rows) for x in enc.encode_many(pa.array(texts[i : i + rows]))]
        assert got == [ids_of(whole, t)[:-1] for t in texts]
    assert [len(x) for x in enc.encode_many(pa.array([None, "a"], pa.string()))] == [0, 1] and enc.encode_many(pa.array([], pa.string())) == []


def test_added_tokens_are_read_as_the_library_does():
    plain = Tokenizer.from_file(default_vocabulary())
    texts = [*TRICKY, "<|endoftext|>", "a <|endoftext|>\n b<|endoftext|><|endoftext|> c", "<|endoftext>", "x <|endoftext|>"]
    enc = encoder(default_vocabulary())
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.encode_many(pa.array(texts))] == want
    assert [x.tolist() for x in enc.encode_many(pa.array([None, *texts]).slice(1))] == want
    assert 50256 in want[-1] and len(want[-3]) > 3


def test_batches_are_cut_by_characters(monkeypatch):
    monkeypatch.setattr("lodestone.llm.tokens.BATCH_CHARS", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["aaaa", None, "bbbbbb", "c" * 50, "", "d"]})
    assert [b.num_rows for b in slices([batch, batch.slice(0, 0)])] == [3, 1, 2]


def corpus():
    rng = random.Random(9)
    words = [f"word{i} " for i in range(200)]
    texts = ["".join(rng.choice(words) for _ in range(rng.choice([5, 50, 300, 900, 2000]))) for _ in range(120)] + ["same text again " * 200] * 40
    return list(range(1000, 1160)) + ODD_IDS, texts + ODD


@pytest.mark.parametrize("rows", [50_000, 12])
def test_packing_is_whole_and_certified(spark, whole, rows, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", rows)
    ids, texts = corpus()
    rows = packing.pack_documents(documents(spark, texts, ids), with_ids=True).toPandas()
    want = sorted((str(d), len(ids_of(whole, t)), crc(ids_of(whole, t))) for d, t in zip(ids, texts))
    lengths = sorted(n for _, n, _ in want)
    assert sorted(rows.groupby(["doc_id", "piece"], dropna=False).size().index.get_level_values(1).tolist()).count(0) == rows[rows.piece == 0].doc_id.nunique(dropna=False)
    assert rows.length.sum() == sum(lengths) and rows.length.max() <= 2048
    for d, t in zip(ids[:160], texts[:160]):
        mine = rows[rows.doc_id == d].sort_values("piece")
        whole_ids = ids_of(whole, t)
        assert np.frombuffer(b"".join(mine.ids), "<u4").tolist() == whole_ids and (mine.length[1:] == 2048).all()
        assert [crc(whole_ids[s : s + n]) for s, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    short = rows[rows.length < 2048].length.to_numpy()
    n = packing.best_fit_decreasing(short, 2048)[2] + (rows.length == 2048).sum()
    assert rows.sequence_id.nunique() <= n + (2 if len(short) > packing.GROUP_ROWS else 0)


def test_exchange_goes_on_until_one_group(spark, monkeypatch):
    """Sixteen groups, then four, then one; the whole table comes near its certified bound."""
    monkeypatch.setattr(packing, "GROUP_ROWS", 150)
    rng = random.Random(12)
    docs = documents(spark, ["word " * rng.randrange(20, 1500) for _ in range(2400)])
    packed = packing.pack_documents(docs).cache()
    sequences, bound = packing.certificate(packed)
    assert packed.groupBy("doc_id").count().count() == 2400 and packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").isEmpty()
    assert bound <= sequences <= 1.02 * bound, (sequences, bound)
    one = packing.least_bins(np.array([r.length for r in packed.select("length").collect()]), 2048)
    assert one == bound


def test_bounds_hold_and_reach_known_optima():
    assert packing.least_bins(np.array([1025] * 7), 2048) == 7
    assert packing.least_bins(np.array([1024] * 7), 2048) == 4
    assert packing.least_bins(np.array([683] * 6), 2048) == 3
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 2048, rng.integers(1, 200))
        bins, offsets, n = packing.best_fit_decreasing(lengths, 2048)
        assert packing.least_bins(lengths, 2048) <= n == len(set(bins)) and np.bincount(bins, lengths).max() <= 2048


def test_store_gives_back_every_document(spark, whole, tmp_path):
    ids, texts = corpus()
    docs, path = documents(spark, texts, ids), str(tmp_path / "store")
    store.write_store(docs, path)
    got = store.read_digests(spark, path).toPandas().sort_values("start")
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]]
    order = [None if np.isnan(d) else int(d) for d in got.doc_id.astype(float)]
    assert order == sorted(ids, key=lambda d: (d is not None, d or 0))
    want = sorted((str(d), len(ids_of(whole, t)), crc(ids_of(whole, t))) for d, t in zip(ids, texts))
    assert sorted(zip(map(str, order), got.n_tokens, got.ids_crc32)) == want
    rebuilt = sorted((str(r.doc_id), crc(r.ids)) for r in store.read_ids(spark, path).collect())
    assert rebuilt == sorted((d, c) for d, _, c in want)
    chunks = store.read_chunks(spark, path)
    assert chunks.count() == chunks.select("name").distinct().count()
    assert chunks.count() < store.read_recipes(spark, path).selectExpr("sum(size(chunks))").first()[0]
    assert store.verify_manifest(spark, path).count() == 0


def test_many_files_and_files_of_many_blocks(spark, whole, tmp_path, monkeypatch):
    """A file larger than a block, and more files than shuffle partitions: the same documents either way."""
    ids, texts = corpus()
    docs = documents(spark, texts * 2, [*ids, *ids])
    results = []
    for rows, block in ((7, 4), (10_000, 8), (10_000, 1 << 20)):
        monkeypatch.setattr(store, "FILE_ROWS", rows)
        monkeypatch.setattr(store, "BLOCK_ROWS", block)
        path = str(tmp_path / f"store-{rows}-{block}")
        store.write_store(docs, path)
        manifest = spark.read.parquet(f"{path}/manifest").collect()
        assert sum(r.n_docs for r in manifest) == 2 * len(texts) and store.verify_manifest(spark, path).count() == 0
        results.append((sorted(map(str, store.read_digests(spark, path).drop("start").collect())), len(manifest), {r.root for r in manifest}))
    assert results[0][0] == results[1][0] == results[2][0]
    assert results[0][1] > 4 and results[1][1] == 1 and results[1][2] == results[2][2]  # blocks change no root
    recipes = store.read_recipes(spark, path)
    recipes.withColumn("root", F.expr("case when leaf = 3 then unhex('00') else root end")).write.parquet(f"{path}-2/recipes")
    spark.read.parquet(f"{path}/manifest").write.parquet(f"{path}-2/manifest")
    assert store.verify_manifest(spark, f"{path}-2").count() == 1


def test_cut_points_follow_the_content():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50_000, 20_000).astype("<u2")
    streams = [ids, ids[500:], ids[:0], ids[:1], ids[:70], np.zeros(5000, "<u2")]
    many = store.cut_points(streams)
    assert many == [store.cut_points([x])[0] for x in streams]
    for x, ends in zip(streams, many):
        sizes = np.diff([0, *ends])
        assert sum(sizes) == len(x) and all(store.LEAST <= n <= store.MOST for n in sizes[:-1]) and (sizes <= store.MOST).all()
    assert len({e - 500 for e in many[0]} & set(many[1])) > 0.9 * len(many[1])


def test_a_changed_chunk_is_noticed(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_store(documents(spark, ["some text to keep", "another"]), path)
    chunks = store.read_chunks(spark, path).selectExpr("name", "cast(concat(data, data) as binary) data").toPandas()
    spark.createDataFrame([(bytes(n), bytes(d)) for n, d in zip(chunks["name"], chunks["data"])], "name binary, data binary").write.mode("overwrite").parquet(f"{path}/parts/kind=chunk")
    with pytest.raises(Exception, match="does not hold"):
        store.read_digests(spark, path).collect()


def test_crc_and_merkle():
    rng = random.Random(3)
    parts = [rng.randbytes(4 * rng.randrange(1, 300)) for _ in range(20)]
    assert store.Crc32().joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))
    leaves = [store.digest(bytes([i])) for i in range(5)]
    assert store.merkle_root(leaves) != store.merkle_root(leaves[::-1]) and store.merkle_root(leaves[:1]) == leaves[0]


def test_empty_tables(spark):
    none = documents(spark, []).limit(0)
    assert packing.pack_documents(none).count() == 0 and store.stored_digests(none).count() == 0


def test_pipeline_on_a_small_table(spark, tmp_path):
    """Every stage's decisions show in the next: rejected, copied, contaminated documents go, secrets are masked."""
    good = [f"A quiet sentence number{i} about river{i} and hill{i * 7}, written with some care indeed. It goes on{i} a while." for i in range(60)]
    item = " ".join(f"bench{i}" for i in range(14))
    texts = good + [good[0], f"Well then {item} was quoted here.", "My password=abcdefgh1234 is written down here in full."] + ["!!! ### BAD BAD " * 5] * 30
    documents(spark, texts).drop("spans", "score").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 63), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(range(63)) <= set(seen["quality_classifier"]) and not set(range(63, 93)) & set(seen["quality_classifier"])
    assert 60 not in seen["simhash_near_dedup"] and 0 in seen["simhash_near_dedup"]
    assert 61 in seen["simhash_near_dedup"] and 61 not in seen["benchmark_decontamination"]
    assert seen["secret_scan"][62] == "My [SECRET] is written down here in full." and seen["secret_scan"][5] == texts[5]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(seen["secret_scan"])


def plain_pipeline(texts, predicted, item, encode):
    """The stages one after the other in plain Python: (doc_id, length, crc32) of what is left."""
    kept = [(i, t) for i, t in enumerate(texts) if predicted[i]]
    fps = {i: test_simhash.fingerprint(t) for i, t in kept}
    group = {i: i for i, _ in kept}
    for i, _ in kept:
        for j, _ in kept:
            if j < i and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    kept = [(i, t) for i, t in kept if i == min(k for k in group if group[k] == group[i])]
    window = item.split(" ")
    windows = {tuple(window[k : k + 10]) for k in range(len(window) - 9)}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    kept = [(i, t) for i, t in kept if not any(tuple(words(t)[k : k + 10]) in windows for k in range(len(words(t))))]
    out = []
    for i, t in kept:
        spans = sorted((m.start(), m.end()) for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]{8,}", t))
        for a, b in reversed(spans):
            t = t[:a] + "[SECRET]" + t[b:]
        ids = ids_of(encode, t)
        out.append((i, len(ids), crc(ids)))
    return out


def test_pipeline_equals_a_plain_run(spark, whole, tmp_path):
    rng = random.Random(31)
    words = [f"{a}{b}" for a in ("river", "hill", "stone", "cloud", "field", "door") for b in "abcdefghij"]
    item = " ".join(f"bench{i}" for i in range(14))
    texts = ["The " + " ".join(rng.choice(words) for _ in range(rng.randrange(25, 60))) + "." for _ in range(70)]
    texts += [texts[3], texts[3], texts[9].replace(".", " indeed."), f"Well {item[:40]} and {item} here.", f"And {' '.join(item.split(' ')[3:13])} again.", "A password=abcdefgh1234 and token: 'zyxwvuts9876' stand in this one.", "password=short is none."]
    texts += ["!!! ### BAD BAD " * 5] * 40
    documents(spark, texts).drop("spans", "score").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int("BAD" not in t), 0) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    scores = quality.quality_scores(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()
    want = plain_pipeline(texts, {r.doc_id: r.predicted for r in scores}, item, whole)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in got) == sorted(want) and len(want) > 60
    assert sum(r.length for r in got) <= 2048 * len({r.sequence_id for r in got})


def test_stages_keep_columns_of_clashing_names(spark):
    """Columns with names that operators might use themselves, and no n_chars."""
    rows = [(i, t, "a", "b", "c", "d", "e") for i, t in enumerate(["one two three four", "one two three four", "my password=abcdefgh1 x", None])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash string, length string, _text_hash string, words string, row string")
    out = corpus_pipeline.secrets_stage(spark, simhash.drop_near_duplicates(docs.union(docs.limit(2))), "")
    assert out.columns == docs.columns and [(r.text, r.text_hash, r.length, r._text_hash) for r in out.orderBy("doc_id").collect()] == [("one two three four", "a", "b", "c"), ("my [SECRET] x", "a", "b", "c"), (None, "a", "b", "c")]


def test_drop_lists_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(common, "stage", lambda df, name: df)  # so that Spark doesn't know how small the list is
    docs = documents(spark, [f"text {i}" for i in range(50)] + ODD, [*range(100, 150), *ODD_IDS])
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    left = common.without(docs, keyed.where("doc_id is null or doc_id % 3 = 0"))
    assert "SortMergeJoin" in left._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i in [*range(100, 150), *ODD_IDS] if i is not None and i % 3)


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default))})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(Cluster, "x")


def test_pipeline_survives_odd_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = documents(spark, ODD, ODD_IDS)
    for docs, name in ((odd, "odd"), (odd.limit(0), "none")):
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            assert i == 4 or out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")
        assert docs.where("piece = 0").count() == spark.read.parquet(f"{tmp_path}/{name}3").count() == (9 if name == "odd" else 0)
