import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import catalog
from lodestone.operators.indexes import PART, POS, TableIndex, grams_of, necessary

PATTERNS = [
    "axis m30[0-9]+", "abc?de", "ab+cde|dea?bcd", "(abc|dea)+.b", "a(bc)?dea", "(?:ab|cd)eab", "abc{2}dea", r"ab\.cd\d", "(?=abc)a.cde", "a[bc]dea", "(a|b)(c|d)(e|a)bcd", "abc*|", "^abcd$", "((ab|bc)cde|eab)d", r"\babc\b",
    "a(?i)bcd", r"(ab)\1cd", "ab[^]]cd", r"a\x41bc", "abc+?dea", "(abcd){0}ea",
]


def test_whatever_matches_has_the_trigrams_of_one_way():
    rng, met = random.Random(5), set()
    pieces = ["a", "b", "c", "d", "e", ".", "0", "abc", "cde", "dea", "bcd", "eab", "ab.cd0", "abccdea"]
    for pattern in PATTERNS:
        try:
            compiled = re.compile(pattern)
        except re.error:  # flags in the middle are an error here and not in Spark
            assert necessary(pattern) == [frozenset()]
            continue
        for _ in range(5000):
            text = "".join(rng.choices(pieces, k=rng.randint(1, 6)))
            if compiled.search(text):
                met.add(pattern)
                assert any(way <= grams_of(text) for way in necessary(pattern)), (pattern, text)
    assert len(met) >= len(PATTERNS) - 5


def test_what_is_necessary():
    assert necessary("small ri.g") == [grams_of("small ri")]
    assert set(necessary("x(abc|dea)y")) == {grams_of("abc"), grams_of("dea")}
    assert necessary("a.c", literal=True) == [frozenset({"a.c"})]
    for unsure in ("(?i)abc", r"\x41bcd", "(abc", "abc)", "[a&&b]cde", "*abc", "abc\\"):
        assert necessary(unsure) == [frozenset()], unsure


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    words = ["Axis", "m3027", "dome", "ptz", "İstanbul", "größe", "😀cam", "a", "", "x.y"]
    rows = [(rng.choice([i, i, i, None]), rng.choice([None, " ".join(rng.choices(words, k=rng.randint(0, 4)))]), rng.choice([None, "p", "q", "dome ptz"]), i) for i in range(600)]
    rows += [(7, "the same", "p", 1000 + i) for i in range(300)] + [(9, "y" * 50000 + "needle" + "z" * 50000, None, 2000)]
    return spark.createDataFrame(rows, "id long, name string, series string, n long")


@pytest.fixture(scope="module")
def index(table, tmp_path_factory):
    return TableIndex.build(table, str(tmp_path_factory.mktemp("index") / "t"), ["id", "n"], ["name", "series"], parts=5)


@pytest.mark.parametrize("term,literal", [("needle", True), ("M3027 axis", False), ("ptz (m30|xis)", False), ("x.y x", True), ("x.y", True), ("größe x|needlez", False), ("😀cam 😀", False), ("stanbul ptz a", False), ("the same", True), ("nowhere", True), ("e", False), ("", False), (None, False)])
def test_searches_equal_scans(table, index, term, literal, monkeypatch):
    want = sorted(r.n for r in catalog.search(table, term, ["name", "series"], literal).collect())
    assert sorted(r.n for r in index.search(term, literal).collect()) == want
    monkeypatch.setattr("lodestone.operators.indexes.LOOKUP", 1)  # too many places to name
    assert sorted(r.n for r in index.search(term, literal).collect()) == want


def test_a_search_reads_candidates_alone(index):
    found = index.candidates("needle", literal=True)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1 and PART in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")] and POS in plan[plan.index("PushedFilters") :]
    assert index.candidates("the same", literal=True) is None and index.candidates("a.b") is None and index.candidates("nowhere").count() == 0


def test_pages_equal_sorted_pages(table, index):
    assert index.total() == table.count() and index.rows().columns == table.columns
    for number, limit in ((1, 100), (2, 37), (5, 100), (10, 100), (11, 100), (901, 1)):
        want = [tuple(r) for r in catalog.page(table, number, limit, "id", "n").collect()]
        assert [tuple(r) for r in index.page(number, limit).collect()] == want
    with pytest.raises(ValueError):
        index.page(0, 10)


def test_odd_tables(spark, table, tmp_path):
    empty = TableIndex.build(table.limit(0), str(tmp_path / "e"), ["id"], ["name"])
    assert empty.page(1, 10).count() == 0 and empty.search("abcd").count() == 0 and empty.total() == 0
    down = TableIndex.build(table, str(tmp_path / "d"), [F.desc("n")], parts=3)
    assert [r.n for r in down.page(1, 3).collect()] == [2000, 1299, 1298]
    with pytest.raises(ValueError, match="__pos"):
        TableIndex.build(table.withColumn("__pos", F.lit(1)), str(tmp_path / "c"), ["id"])
