import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import html
from lodestone.operators import cache, validation
from lodestone.plans import catalog_queries
from lodestone.schema import PRODUCTS
from lodestone.sources import tables


def products(spark):
    row = lambda i, images="[]", files="[]", sheet=None, pdf=None, series="S": (i, "m", "d", None, "v", "c", "pc", series, images, files, sheet, pdf, "{}")
    return spark.createDataFrame([row("a", '["u"]', '["ok.webp","bad.webp","gone.webp"]', "s", "ok.pdf"), row("a"), row("b", files="{", pdf="bad.pdf"), row("c", series=None)], PRODUCTS)


def test_layers_and_report(spark):
    files = spark.createDataFrame([("ok.webp", b"RIFF"), ("bad.webp", b"NOPE"), ("ok.pdf", b"%PDF"), ("bad.pdf", b"NOPE")], "path string, head binary")
    got = {(r.type, r.field, r.path): r.cnt for r in validation.file_issues(products(spark), files).collect()}
    assert set(got) == {("missing_image", None, "gone.webp"), ("invalid_image_format", None, "bad.webp"), ("invalid_pdf_format", None, "bad.pdf"), ("invalid_json_image_files", None, "b")}
    report = validation.validate(products(spark), files)
    assert report.stats["duplicate_ids"] == 2 and report.stats["no_media_records"] == 3 and report.stats["missing_images"] == 1 and report.stats["image_coverage"] == "25.0%"
    words = validation.format_report(report, verbose=True)
    assert "Duplicate IDs: 2" in words and "product_count_mismatch" in words and f"{report.n_errors} error(s)" in words
    assert [r.type for r in validation.schema_issues(products(spark).drop("source")).collect()].count("missing_column") == 1


def test_clean_table_passes_and_empty_has_no_coverage(spark):
    one = spark.createDataFrame([("a", "m", "d", None, "v", "c", "pc", "s", '["u"]', "[]", "x", None, '{"k":{"a":"b"}}')], PRODUCTS)
    report = validation.validate(one)
    assert (report.n_errors, report.n_warnings) == (0, 0) and "passed" in validation.format_report(report)
    assert validation.statistics(one.limit(0)).first().image_coverage is None


TABLES = """<html><h1>other</h1><h1 class="x title-attention"> AXIS M1 </h1><div class="product-img-carousel--main"><img src="/1.jpg"><img></div>
<a href="/d.pdf">Data<b>sheet</b> (PDF)</a><table class="ac-table"><caption class="ac-table__caption">Video</caption><tbody class="ac-table__body">
<tr class="ac-table__row"><td class="ac-table__cell">Res</td><td class="ac-table__cell"> 5 MP </td></tr><tr class="ac-table__row"><td class="ac-table__cell">short</td></tr></tbody></table></html>"""
ACCORDION = """<meta name="page-title" content="Meta"><div class="product_description-wrapper" data-product-name="Name" data-product-number="N1"></div>
<div id="productCarouselComp"><div class="swiper-slide" data-original="//h/1.jpg"></div><img src="//h/2.jpg"></div><a class="product_data_sheet" href="//h/d.pdf">x</a>
<div class="tech-specs-accordion-container"><li class="tech-specs-items-title__name"><a data-target="#1">Cam</a></li><ul class="tech-specs-items-description" data-target="#1">
<li class="tech-specs-items-description-list"><span class="tech-specs-items-description__title">Sensor</span><span class="tech-specs-items-description__title-details">CMOS</span></li></ul></div>"""


def test_pages(spark):
    pages = spark.createDataFrame([("u1", TABLES), ("u2", "<p>nothing"), ("u3", None)], "url string, html string")
    got = {r.url: r for r in html.extract(pages).collect()}
    assert (got["u1"].name, got["u1"].images, got["u1"].datasheet_url, got["u1"].specifications) == ("AXIS M1", ["/1.jpg"], "/d.pdf", {"Video": {"Res": "5 MP"}})
    assert got["u2"].name == got["u3"].name == "Unknown Product"
    row = html.extract(spark.createDataFrame([("u", ACCORDION)], "url string, html string"), html.accordion_page).first()
    assert (row.name, row.number, row.images, row.datasheet_url, row.specifications) == ("Name", "N1", ["https://h/1.jpg"], "https://h/d.pdf", {"Cam": {"Sensor": "CMOS"}})
    cards = html.series_cards(html.parse('<a class="nav-card" href="/0"><h4>Out</h4></a><h3>Products within</h3><div class="nav-card__coll"><a class="nav-card" href="/1" data-history-node-id="7"><h4>In</h4></a></div>'))
    assert cards == [("In", "/1", "7")]

    def broken(page):
        raise RuntimeError("no")

    assert html.extract(pages, broken).first().error == "no"


def test_names_with_references_that_sql_does_not_decode(spark, tmp_path):
    """Cut ones, quotes, numbers and doubly escaped ones: as the query's SQL has them; the parser itself decodes all."""
    headings = ["a &amp;&amp", "token = &quot;7", "&#x27;x&#39;", "&amp;lt; &lt;b&gt; &nbsp;&eacute;", " &am", "", "plain"]
    spark.createDataFrame([(f"u{i}", f"<h1>{h}</h1>") for i, h in enumerate(headings)], "url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    pages = duckdb.connect()
    pages.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalog_queries.html_parsed(spark, str(tmp_path)).orderBy("url").collect()
    assert [tuple(r) for r in got] == pages.execute(catalog_queries.SQL["html_parsed"] + " ORDER BY url").fetchall()
    whole = html.extract(spark.read.parquet(str(tmp_path / "pages.parquet"))).orderBy("url").collect()
    assert [r.name for r in whole][:3] == ["a &&", 'token = "7', "'x'"]


@pytest.mark.parametrize("query", ["html_accordion_details", "html_table_details", "html_product_links", "html_series_cards", "html_category_cards"])
def test_pages_made_of_a_small_file_are_parsed_by_many_tasks(spark, tmp_path, query):
    rows = spark.range(20_000).selectExpr("id p_partkey", "concat('part ', id) p_name", "'Brand#1' p_brand", "'TYPE' p_type", "cast(id % 50 as int) p_size")
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    found = getattr(catalog_queries, query)(spark, str(tmp_path))
    assert found.where("url like '%1'").select(F.spark_partition_id()).distinct().count() >= 4


def test_products_of_pages_are_listed_in_one_pass(spark):
    """Pages that share a url keep their own links, and each page is made and parsed once, without a join."""
    card = '<h3>Products within</h3><div class="nav-card__coll">{}</div>'
    one, two = ('<a class="nav-card" href="/p/%d"><h4>n</h4></a>' % i for i in (1, 2))
    pages = spark.createDataFrame([("/s", card.format(one)), ("/s", card.format(one + two)), ("/q", card.format("")), (None, None)], "url string, html string")
    found = html.product_links(pages)
    assert sorted(map(tuple, found.where("url is not null").collect())) == [("/q", 0, "/q"), ("/s", 0, "/p/1"), ("/s", 0, "/p/1"), ("/s", 1, "/p/2")]
    assert [tuple(r) for r in found.where("url is null").collect()] == [(None, 0, None)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_caches(spark):
    known = spark.createDataFrame([("u1", 1)], "url string, n long")
    new = spark.createDataFrame([("u1", 5), ("u2", 7), ("u2", 6)], "url string, n long")
    assert sorted((r.url, r.n) for r in cache.insert_new(known, new, "url", "n").collect()) == [("u1", 1), ("u2", 6)]
    same = spark.createDataFrame([(1, b"x"), (2, b"x"), (3, b"y")], "id long, content binary")
    assert [(r.id, r.duplicate) for r in cache.first_of_content(same, "content", "id").orderBy("id").collect()] == [(1, False), (2, True), (3, False)]
    assert cache.cache_stats(spark.createDataFrame([], "file_type string, file_size_bytes long")).first().total_bytes == 0


def test_strict_lines_and_files(spark, tmp_path):
    schema = T.StructType([T.StructField("image", T.StringType()), T.StructField("camera_id", T.StringType())])
    good = tmp_path / "good.jsonl"
    good.write_text('{"image":"a","camera_id":"x"}\n\n{"image":"b","camera_id":"y"}\n')
    assert tables.jsonl(spark, str(good), schema, ["camera_id"]).count() == 2
    for line in ('{"image":"a"}', "{broken"):
        bad = tmp_path / "bad.jsonl"
        bad.write_text(line)
        with pytest.raises(PySparkException):
            tables.jsonl(spark, str(bad), schema, ["camera_id"]).collect()
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "t.webp").write_bytes(b"RIFF\0\0\0\0WEBP")
    row = tables.files(spark, str(tmp_path / "f")).first()
    assert (row.path, bytes(row["head"]), row["size"]) == ("t.webp", b"RIFF", 12)
    assert tables.parquet(spark, str(tmp_path / "none"), optional=True) is None
    df = spark.range(3)
    tables.write_parquet(df, str(tmp_path / "p"))
    with pytest.raises(PySparkException):
        tables.write_parquet(df, str(tmp_path / "p"))
    tables.write_parquet(df, str(tmp_path / "p"), force=True)
    tables.write_csv(df, str(tmp_path / "c"))
    assert tables.CachedTable(spark, str(tmp_path / "p")).reload().count() == 3
