import json

import pytest

from lodestone.functions import specs, text
from lodestone.operators import catalog
from lodestone.schema import PRODUCTS

ROWS = [
    ("axis-m3027", "AXIS M3027-PVE", "AXIS M3027-PVE", None, "Axis Communications", "Network Camera", "Network Cameras", "AXIS M3000", '["http://x/1.jpg"]', '["data/images/A/B.jpg"]', "http://x/d.pdf", "d.pdf", '{"Resolution":{"value":"5 MP"}}'),
    ("axis-m3028", "AXIS M3028-PVE", None, None, "Axis Communications", "Network Camera", "Network Cameras", "AXIS M3000", '["http://x/1.jpg","/2.jpg"]', '["a.webp","b.webp"]', None, None, '{"Resolution":{"value":"8 MP"}}'),
    ("hik-ds2de", "DS-2DE2A404IW-DE3", "", None, None, "PTZ Camera", "PTZ Cameras", None, "[]", "not json", "http://y/d.pdf", None, "{}"),
    ("  ", "blank", None, None, None, None, None, None, None, None, None, None, None),
    (" axis-m3027 ", "AXIS M3027 later", None, None, "Axis Communications", "Network Camera", "Network Cameras", "AXIS M3000", None, "", None, None, None),
]


@pytest.fixture
def products(spark):
    df = spark.createDataFrame(ROWS, PRODUCTS)
    return df.selectExpr("*", "monotonically_increasing_id() as ord")


def test_last_row_of_a_stripped_id_wins_and_blank_ids_go(products):
    got = {r.camera_id: r.model_name for r in catalog.last_by_id(products, "camera_id", "ord").collect()}
    assert got == {"axis-m3027": "AXIS M3027 later", "axis-m3028": "AXIS M3028-PVE", "hik-ds2de": "DS-2DE2A404IW-DE3"}


def test_records_have_defaults(products):
    got = {r.camera_id: r for r in catalog.as_records(products).collect()}
    assert got["hik-ds2de"].display_name == "DS-2DE2A404IW-DE3" and got["hik-ds2de"].source == "Unknown" and got["hik-ds2de"].image_files == []
    assert got["axis-m3028"].image_urls == ["http://x/1.jpg", "/2.jpg"] and got["axis-m3028"].specifications == {"Resolution": '{"value":"8 MP"}'}
    again = catalog.as_rows(catalog.as_records(products)).where("camera_id = 'axis-m3028'").first()
    assert json.loads(again.image_files) == ["a.webp", "b.webp"]


def test_filters_search_pages(products):
    assert catalog.filter_equal(products, source="Axis Communications", product_series=None).count() == 3
    assert catalog.search(products, "m302[78]-", ["model_name", "display_name"]).count() == 2
    assert catalog.search(products, "m302[78]-", ["model_name"], literal=True).count() == 0
    assert catalog.search(products, None, ["model_name"]).count() == 5
    assert [r.camera_id for r in catalog.page(products, 2, 2, "ord").collect()] == ["hik-ds2de", "  "]
    assert catalog.page_info(5, 2, 2)["total_pages"] == 3
    with pytest.raises(ValueError):
        catalog.page(products, 0, 20, "ord")
    assert catalog.by_id(products, "camera_id", "nobody", "ord").count() == 0


def test_facets_drop_nulls_and_counts_fall(products):
    got = {(r.facet, r.value): r.n for r in catalog.facets(products, "source", "product_series").collect()}
    assert got == {("source", "Axis Communications"): 3, ("product_series", "AXIS M3000"): 3}
    assert [r.n for r in catalog.value_counts(products, "category", 1).collect()] == [3]
    assert {r.field: r.n_null for r in catalog.null_profile(products, "source", "camera_id").collect()} == {"source": 2, "camera_id": 0}
    stats = catalog.json_list_stats(products, "image_files").first()
    assert (stats.total, stats["mean"]) == (3, 0.6)


def test_views(products):
    row = catalog.list_view(products).where("camera_id = 'axis-m3027'").first()
    assert row.thumbnail_url == "/api/v1/images/A/B.jpg" and row.specs.max_resolution is None  # its object has no such key
    assert catalog.detail_view(products).where("camera_id = 'axis-m3028'").first().image_urls == ["http://x/1.jpg"]
    records = catalog.as_records(products)
    assert {(r.camera_id, r.path) for r in catalog.first_images(records.where("camera_id = 'axis-m3028'")).collect()} == {("axis-m3028", "a.webp")}
    there, missing = catalog.columns_of(products, ["camera_id", "nothing"])
    assert there.columns == ["camera_id"] and missing == ["nothing"]


def test_spec_search_in_document_order(spark):
    cases = [
        ('{"Lens":{"Focal length":"3.16 mm","Horizontal field of view":"103 °","Lens mount":"M12"}}', ["focal length", "lens"], "3.16 mm"),
        ('{"Lens":"Fixed lens 2.8 mm"}', ["focal length", "lens"], "Fixed lens 2.8 mm"),
        ('{"Z":{"x":1},"A":{"b":"-"}}', ["b"], "-"),
        ('{"Zoom K":{"other":"v"},"B":{"zoom":"w"}}', ["zoom"], None),
        ('{"n":3}', ["n"], "3"),
        ("broken", ["n"], None),
        (None, ["n"], None),
        ("{}", ["n"], None),
    ]
    for doc, keys, want in cases:
        df = spark.createDataFrame([(doc,)], "s string")
        got = df.select(specs.find_value(df.s, keys).alias("a"), specs.find_value_deep(df.s, keys).alias("b")).first()
        assert (got.a, got.b) == (want, want), doc
    deep = spark.createDataFrame([('{"a":{"b":{"c":{"lens":"deep"}}}}',)], "s string")
    assert deep.select(specs.find_value_deep(deep.s, ["lens"])).first()[0] == "deep"
    combined = spark.createDataFrame([('{"Focal length & FOV":"2.8 mm, horizontal FOV 100.2°"}',)], "s string")
    got = combined.select(specs.summary(combined.s).alias("x")).first().x
    assert (got.lens, got.horizontal_fov) == ("2.8 mm", "2.8 mm, horizontal FOV 100.2°")


def test_scalars(spark):
    row = spark.range(1).selectExpr("'DS-2DE 40/4 X' n", "'network_cameras-x2y' d", "'AXIS_COMMUNICATIONS' v", "'//a/b' u", "'/p' r", "'' e", "808596553 f", "2.8 fps").select("*")
    got = row.select(text.slug(row.n), text.folder_title(row.d), text.vendor_name(row.v), text.https_url(row.u), text.absolute_url(row.r, "http://h"), text.absolute_url(row.e, "http://h"), text.fourcc(row.f)).first()
    assert list(got) == ["ds-2de-40-4-x", "Network Cameras-X2Y", "Axis Communications", "https://a/b", "http://h/p", None, "I420"]
    label = spark.createDataFrame([("horizontal field of view: 100.2° x",)], "t string")
    assert label.select(text.horizontal_fov(label.t)).first()[0].strip() == "100.2°"
