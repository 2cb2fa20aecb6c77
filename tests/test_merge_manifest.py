import sqlite3

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestone.operators import manifest, merge
from lodestone.schema import MANIFEST, PRODUCT_CACHE
from lodestone.sources import snapshots, tables
from lodestone.sources.snapshots import Snapshots, VersionTaken, diff, identity

# Rows of the hand-over fixtures.
OLD = [("cam-001", "Camera 1"), ("cam-002", "Camera 2"), ("cam-003", "Camera 3")]
APART = [("cam-004", "Camera 4"), ("cam-005", "Camera 5")]
OVER = [("cam-002", "Updated Camera 2"), ("cam-003", "Updated Camera 3"), ("cam-006", "Camera 6")]


def table(spark, rows):
    return spark.createDataFrame([(k, m, i) for i, (k, m) in enumerate(rows)], "camera_id string, model_name string, ord long")


@pytest.mark.parametrize(("strategy", "new", "rows", "counts", "second"), [
    ("update", APART, 5, (2, 0, 0), "Camera 2"), ("update", OVER, 4, (1, 2, 0), "Updated Camera 2"), ("skip", OVER, 4, (1, 0, 2), "Camera 2"), ("error", APART, 5, (2, 0, 0), "Camera 2"),
])
def test_strategies(spark, strategy, new, rows, counts, second):
    merged, n = merge.merge(table(spark, OLD), table(spark, new), "camera_id", "ord", strategy)
    got = {r.camera_id: r.model_name for r in merged.collect()}
    assert len(got) == merged.count() == rows and got["cam-002"] == second and tuple(n.values()) == counts


def test_error_names_keys_and_unknown_strategies_raise(spark):
    with pytest.raises(merge.MergeConflict, match="cam-002"):
        merge.merge(table(spark, OLD), table(spark, OVER), "camera_id", "ord", "error")
    with pytest.raises(ValueError, match="skip"):
        merge.merge(table(spark, OLD), table(spark, OVER), "camera_id", "ord", "nothing")
    assert merge.merge(None, table(spark, OVER), "camera_id", "ord")[1]["added"] == 3


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.text("xyz", max_size=2)), max_size=8), st.lists(st.tuples(st.sampled_from("abcdef"), st.text("xyz", max_size=2)), max_size=8))
def test_update_is_last_write_and_idempotent(spark, old, new):
    merged, n = merge.merge(table(spark, old), table(spark, new), "camera_id", "ord")
    want = dict(old) | dict(new)
    assert {r.camera_id: r.model_name for r in merged.collect()} == want
    assert n["added"] + len(dict(old)) == len(want)


TREE = {"categories": {"Dome cameras": {"series": {"M30": {"products": [
    {"camera_id": "axis-m3057-plr", "model_name": "AXIS M3057-PLR", "image_urls": ["a", "b"], "datasheet_url": "d", "specifications_html": {"Video": {"Resolution": "6 MP"}}},
    {"camera_id": "axis-m3085-v", "model_name": "AXIS M3085-V", "image_urls": [], "datasheet_url": None, "specifications_html": {}},
    {"camera_id": "", "model_name": "nameless", "image_urls": [], "datasheet_url": None, "specifications_html": {}},
]}}}}}


def test_render_deals_a_large_series_over_documents(spark, monkeypatch):
    monkeypatch.setattr(manifest, "DOCUMENT_PRODUCTS", 20)
    rows = [("c", "large", f"id{i}", f"name{i}", ["u"], None, None) for i in range(400)] + [("c", "small", "x", "x", ["u"], None, None)]
    columns = "category string, series string, camera_id string, model_name string, image_urls array<string>, datasheet_url string, specifications_html map<string, map<string, string>>"
    docs = manifest.render(spark.createDataFrame(rows, columns)).collect()
    sizes = {"large": [], "small": []}
    for d in docs:
        sizes[d.series].append(d.json.count('"camera_id"'))
    assert sum(sizes["large"]) == 400 and len(sizes["large"]) > 15 and max(sizes["large"]) <= 60 and sizes["small"] == [1]


def test_flatten_rollup_render(spark, tmp_path):
    flat = manifest.flatten(spark.createDataFrame([TREE], MANIFEST))
    assert flat.count() == 3 and manifest.to_products(flat).count() == 2
    rows = {(r.category, r.series): r for r in manifest.rollup(manifest.with_counts(flat.where("camera_id <> ''")), "category", "series").collect()}
    assert (rows[None, None].product_count, rows[None, None].image_count, rows["Dome cameras", "M30"].pdf_count, rows["Dome cameras", None].spec_count) == (2, 2, 1, 1)
    tables.write_documents(manifest.render(flat.where("camera_id <> ''"), parts=3), str(tmp_path / "m"))
    again = manifest.flatten(tables.manifest(spark, str(tmp_path / "m"), lines=True))
    assert {(r.camera_id, ((r.specifications_html or {}).get("Video") or {}).get("Resolution")) for r in again.collect()} == {("axis-m3057-plr", "6 MP"), ("axis-m3085-v", None)}
    status = {r.category: r.status for r in manifest.compare(flat.select("category"), flat.selectExpr("concat(category, '!') category"), "category").collect()}
    assert status == {"Dome cameras": "missing", "Dome cameras!": "extra"}


def test_reconstruct_from_files(spark):
    names = ["AXIS_COMMUNICATIONS/network_cameras/AXIS_M3000/axis-m3027-pve/1.webp", "AXIS_COMMUNICATIONS/network_cameras/AXIS_M3000/axis-m3027-pve/0.webp", "HIKVISION/ptz_cameras/DS-2DE/ds-2de2a404iw-de3/0.webp", "HIKVISION/ptz_cameras/DS-2DE/ds-2de2a404iw-de3.pdf", "HIKVISION/readme.txt"]
    cached = spark.createDataFrame([("u1", "AXIS M3027-PVE", '["i"]', "sheet", '{"Video":{"Resolution":"5 MP"}}')], PRODUCT_CACHE)
    got = {r.camera_id: r for r in manifest.reconstruct(manifest.tree_paths(spark.createDataFrame([(n,) for n in names], "path string")), cached).collect()}
    axis, hik = got["axis-m3027-pve"], got["ds-2de2a404iw-de3"]
    assert (axis.vendor, axis.category, axis.series, axis.model_name, axis.n_image_files) == ("Axis Communications", "Network Cameras", "AXIS M3000", "AXIS M3027-PVE", 2)
    assert (hik.model_name, hik.n_image_files, hik.datasheet_file is not None) == ("ds-2de2a404iw-de3", 1, True)


def test_broken_json_empties_both(spark):
    rows = [("u1", "One", '["i"]', "s", '{"a":{"b":"c"}}'), ("u2", "Two", "[broken", "s", '{"a":{"b":"c"}}'), ("u3", "Three", '["i"]', None, "{broken"), ("u4", "Four", None, None, "")]
    got = {r.model_name: (r.image_urls, r.specifications_html) for r in manifest.decoded(spark.createDataFrame(rows, PRODUCT_CACHE)).collect()}
    assert got == {"One": (["i"], {"a": {"b": "c"}}), "Two": ([], {}), "Three": ([], {}), "Four": ([], {})}


def test_versions(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "v"))
    assert store.current() == 0
    for n in range(5):
        v = store.create(table(spark, OLD[: n % 3 + 1]))
    assert v.version == store.current() == 5 and v.parent_version is None
    assert store.keep_last(3) == [1, 2] and [v.version for v in store.versions()] == [3, 4, 5]
    v = store.append(table(spark, OVER), "camera_id", "ord")
    assert (v.version, v.parent_version, v.append_mode, v.records_added) == (6, 5, True, 2)
    assert store.read(3).count() == 3 and store.read().count() == 4
    with pytest.raises(ValueError):
        store.create(table(spark, OLD), version=4)
    with pytest.raises(ValueError):
        store.keep_last(0)
    assert diff(store.read(5), store.read(6)).count() == 4


def test_two_writers_of_one_number(spark, tmp_path, monkeypatch):
    """Both choose 2; the one whose entry comes second gets an error, and replaces nothing of the first's."""
    mine, other = Snapshots(spark, str(tmp_path / "v")), Snapshots(spark, str(tmp_path / "v"))
    mine.create(table(spark, OLD))
    record = Snapshots._record

    def slow(self, v, name):
        if self is mine:
            monkeypatch.setattr(Snapshots, "_record", record)
            other.create(table(spark, APART))
        record(self, v, name)

    monkeypatch.setattr(Snapshots, "_record", slow)
    with pytest.raises(VersionTaken):
        mine.create(table(spark, OVER))
    assert {r.camera_id for r in mine.read(2).collect()} == {k for k, _ in APART} and mine.current() == 2
    assert mine.create(table(spark, OVER)).version == 3


def test_pointer_and_cleanup(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "v"))
    versions = [store.create(table(spark, OLD[: n + 1]), manifest=spark.createDataFrame([("{}",)], "json string") if n == 0 else None) for n in range(3)]
    store.point_to(1)
    assert store.current() == 1 and store.read().count() == 1
    appended = store.append(table(spark, APART), "camera_id", "ord")
    assert (appended.version, appended.parent_version, store.current()) == (4, 1, 4) and store.read().count() == 3
    store.point_to(2)
    assert store.keep_last(1) == [1, 3] and [v.version for v in store.versions()] == [2, 4]  # the current one stays
    there = {p.name for p in (tmp_path / "v").iterdir()}
    gone = {v.path.rsplit("/", 1)[1] for v in versions if v.version in (1, 3)}
    assert not gone & there and not any(name.endswith("-manifest") for name in there) and store.read().count() == 2
    assert store.create(table(spark, OLD)).version == 5  # no number twice
    with pytest.raises(ValueError):
        store.point_to(3)


def test_reports_and_file_heads(spark, tmp_path):
    report = spark.createDataFrame([("b", 1, 2, 1, 2, 0.5, 1.0), ("a", 2, 4, 2, 3, 0.5, 0.75)], "group string, severity int, n int, top1_hits int, top5_hits int, top1_rate double, top5_rate double")
    tables.write_report(report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/json")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "r/csv")).columns == report.columns
    (tmp_path / "f/sub dir").mkdir(parents=True)
    for name, data in (("a.pdf", b"%PDF-1.7 and more"), ("sub dir/b.webp", b"RIFFxxxx"), ("sub dir/c", b"ab"), ("sub dir/d", b"")):
        (tmp_path / "f" / name).write_bytes(data)
    got = {r.path: (r.size, bytes(r.head)) for r in tables.files(spark, str(tmp_path / "f")).collect()}
    assert got == {"a.pdf": (17, b"%PDF"), "sub dir/b.webp": (8, b"RIFF"), "sub dir/c": (2, b"ab")}  # empty files are not listed


def test_identity_of_many_documents(spark):
    """Two manifests that share their first document differ; order, partitions and repeats do what they should."""
    docs = lambda *values: spark.createDataFrame([(v,) for v in values], "value string")
    a = identity(docs("A", "B"))
    assert a == identity(docs("B", "A")) == identity(docs("A", "B").repartition(3)) and a.startswith("sha256:")
    assert len({a, identity(docs("A", "C")), identity(docs("A", "B", "B")), identity(docs("A")), identity(docs("A", None)), identity(docs())}) == 6
    assert identity(docs(*map(str, range(3000)))) == identity(docs(*map(str, reversed(range(3000)))).repartition(7))


def numbers(spark, ids, word="old"):
    return spark.createDataFrame([(i, f"{word}{i}", i) for i in ids], "id long, name string, ord long")


def test_appends_write_what_they_change(spark, tmp_path, monkeypatch):
    """Every strategy gives the rows of a merge of the whole table, a null key included; a layer has the batch's rows."""
    monkeypatch.setattr(snapshots, "MOST_LAYERS", 3)
    store, expected = Snapshots(spark, str(tmp_path / "v")), None
    rows = lambda df: sorted(map(str, df.select("id", "name", "ord").collect()))
    expected = numbers(spark, [*range(200), None])
    store.create(expected, key="id", unique=True)
    batches = [("update", [5, 6, 300, None]), ("skip", [7, 301, 301]), ("error", [400, 401]), ("update", [5, 401, 500]), ("update", [1])]
    layers = []
    for strategy, ids in batches:
        new = numbers(spark, ids, strategy)
        expected = spark.createDataFrame(snapshots.merging.STRATEGIES[strategy](expected, new, "id", "ord").collect(), expected.schema)
        v = store.append(new, "id", "ord", strategy)
        layers.append(len(v.layers))
        assert rows(store.read()) == rows(expected) and v.record_count == expected.count()
        assert rows(store.diff(v.version - 1, v.version).drop("change")) == rows(diff(store.read(v.version - 1), store.read(v.version)).drop("change"))
    assert layers == [1, 2, 3, 0, 1]
    assert spark.read.parquet(store.info(2).layers[0]).count() == 4
    with pytest.raises(merge.MergeConflict):
        store.append(numbers(spark, [1]), "id", "ord", "error")
    assert store.keep_last(1) == [1, 2, 3, 4, 5] and rows(store.read()) == rows(expected)


def test_buckets_that_are_equal_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "BUCKET_ROWS", 20)
    store = Snapshots(spark, str(tmp_path / "v"))
    store.create(numbers(spark, range(200)), key="id")
    store.create(numbers(spark, [i for i in range(200) if i != 17]).unionByName(numbers(spark, [17], "new")), key="id")
    found = store.diff(1, 2)
    assert sorted((r.name, r.change) for r in found.collect()) == [("new17", "added"), ("old17", "removed")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all("__bucket" in filters.split("]")[0] for filters in plan.split("PartitionFilters: [")[1:]) and "PartitionFilters: [" in plan
    assert store.diff(1, 1).count() == 0


def test_sqlite_tables_are_read_in_ranges(spark, tmp_path):
    paths = [str(tmp_path / name) for name in ("a b.db", "c.db")]
    for i, path in enumerate(paths):
        db = sqlite3.connect(path)
        db.execute('CREATE TABLE "t""x" (id INTEGER PRIMARY KEY, "na me" VARCHAR(9), price REAL, raw BLOB, other)')
        db.executemany('INSERT INTO "t""x" VALUES (?, ?, ?, ?, ?)', [(100 * i + k, f"n{k}", k / 2, bytes([k]), k) for k in range(1, 50, 1 + i)] + [(1000 * (i + 1), None, "no number", "text", b"\xff")])
        db.execute("CREATE TABLE bare (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
        db.execute("INSERT INTO bare VALUES ('x', 1), ('y', NULL)")
        db.execute("CREATE TABLE none_yet (k INT)")
        db.commit()
        db.close()
    df = tables.sqlite(spark, paths, 't"x', partitions=4)
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "string", "double", "binary", "string"]
    assert df.rdd.getNumPartitions() == 8
    rows = {r.id: r for r in df.collect()}
    assert len(rows) == 49 + 25 + 2 and rows[7]["na me"] == "n7" and rows[7].price == 3.5 and bytes(rows[7].raw) == b"\x07" and rows[7].other == "7"
    assert rows[1000].price is None and bytes(rows[1000].raw) == b"text" and rows[2000].other == "\ufffd"
    assert sorted(map(tuple, tables.sqlite(spark, paths[0], "bare").collect())) == [("x", 1), ("y", None)]
    assert tables.sqlite(spark, paths, "none_yet").count() == 0
    with pytest.raises(Exception, match="no table"):
        tables.sqlite(spark, paths, "absent").collect()


def test_heads_through_an_opener_of_ones_own(spark, tmp_path):
    """Of a file of any size, four bytes are asked for."""
    (tmp_path / "f").mkdir()
    (tmp_path / "asked").mkdir()
    sizes, asked = {"small.pdf": 10, "large.pdf": 3_000_000}, str(tmp_path / "asked")
    for name, size in sizes.items():
        (tmp_path / "f" / name).write_bytes(b"%PDF".ljust(size, b"."))

    def opened(path):
        import io
        import os

        class Counted(io.FileIO):
            def read(self, n=-1):
                with open(os.path.join(asked, os.path.basename(path)), "a") as log:
                    log.write(f"{n},")
                return super().read(n)

        return Counted(path.removeprefix("file:"))

    got = {r.path: (r["size"], bytes(r["head"])) for r in tables.files(spark, str(tmp_path / "f"), opened=opened).collect()}
    assert got == {name: (size, b"%PDF") for name, size in sizes.items()}
    for name in sizes:
        assert set((tmp_path / "asked" / name).read_text().split(",")) == {"4", ""}
