import random

import duckdb
import pandas as pd
import pytest

from lodestone.llm import urls

COLUMNS = ("page_id", "host", "path", "rule", "verdict", "because")


def brute(rows):
    con = duckdb.connect()
    pages = pd.DataFrame(rows, columns=["page_id", "url"]).astype({"page_id": "Int64"})
    con.register("given", pages)
    con.sql("CREATE VIEW pages AS SELECT CAST(page_id AS BIGINT) AS page_id, CAST(url AS VARCHAR) AS url FROM given")
    return sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({urls.ORACLE_SQL})").fetchall(), key=str)


def found(spark, rows):
    table = spark.createDataFrame([(i, u, "x", 1.0) for i, u in rows], "page_id long, url string, tokens string, confidence double")
    return sorted((tuple(r[c] for c in COLUMNS) for r in urls.filter_urls(table).collect()), key=str)


def pages(seed=5, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        spam = rng.random() < 0.3
        site = rng.choice(["cheap-pills", "casino"]) if spam else rng.choice(["news", "wiki", "garden"])
        lang = rng.choice(["de", "de", "fr", "en"]) if spam else rng.choice(["fr", "fr", "de", "en"])
        out.append((i, f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'www.', 'm.'])}{site}.{rng.choice(['example.com', 'Example.ORG', 'example.net'])}/{lang}/{rng.randrange(99)}{rng.choice(['', '.html', '?ref=x', '?utm=1&ref=y#top', '/'])}"))
    return out


ODD = [
    None, "", "no scheme", "://", "http://", "http://org", "http://org/", "http://ORG/x?y", "http://a.org?q/#/", "http://xorg/", "http://example.org/es/1", "http://a.example.org/en/1234", "x://y://z/p",
    "http://com/fr/", "http://a.com/fr", "http://\n.com/de/\n?a\nb", "http://ÄÖ.com/FR/É", "http://" + "a." * 3000 + "net/" + "p/" * 3000, "http://a..b...net//x//y",
]


def test_against_every_combination(spark):
    rows = pages() + list(zip(range(1000, 1000 + len(ODD)), ODD)) + [(None, "http://null.example.net/en/1"), (5, pages()[5][1]), (5, pages()[5][1])]
    got = found(spark, rows)
    assert got == brute(rows)
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}
    assert found(spark, []) == []


def test_without_labels_all_are_allowed(spark):
    rows = [(i, f"http://a{i}.net/x") for i in range(20)]
    assert {r[4] for r in found(spark, rows)} == {"allow"}


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_joins_by_shuffle_or_broadcast_agree(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "BROADCAST_BYTES", most)
    assert found(spark, pages(8)) == brute(pages(8))


@pytest.mark.parametrize(("url", "host", "path", "rule"), [
    ("http://WWW.Example.Org/es/x?y#z", "www.example.org", "/es/x", "example.org/es/"), ("http://example.org/en/199", "example.org", "/en/199", "example.org/en/1"), ("http://example.org/en/299", "example.org", "/en/299", "org/"),
    ("http://badexample.org/es/", "badexample.org", "/es/", "org/"), ("ftp://x.com/de/", "x.com", "/de/", "com/de/"), ("http://x.com/DE/", "x.com", "/DE/", None), ("x.com/de/", "", "", None),
])
def test_given_rules(spark, url, host, path, rule):
    assert found(spark, [(1, url)])[0][1:4] == (host, path, rule)
