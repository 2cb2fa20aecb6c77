"""Rows at rest in an order, with ordinals and trigram postings: pages at any depth, and searches that read what may match.

A row's place is its part, one of the ranges that the order is cut into, and its position there. Pages are
found from the parts' counts, so page one million reads as few rows as page one. A search asks the postings for
places that have the trigrams which any match must have, reads these rows and tests them as a scan would.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import catalog
from lodestone.sources.shared import written

PART, POS = "__part", "__pos"
#: Trigrams asked for of each way to match, the rarest ones; ways that are told apart; places that are read by value.
RAREST, WAYS, LOOKUP = 3, 16, 1000


class TableIndex:
    """A copy of a table in the order of some columns, which should end in a unique one, below a path that all machines see.

    build() makes it: one range shuffle of the rows, one of the postings. Rows may repeat and any column may be null;
    columns must not be named __part or __pos. There are as many parts as the session shuffles into, unless parts
    says otherwise; what a page has to know are their counts.
    """

    def __init__(self, spark: SparkSession, path: str, searched: list[str] = ()):
        self.spark, self.path, self.searched = spark, path, list(searched)

    @classmethod
    def build(cls, df: DataFrame, path: str, order: list[str | Column], searched: list[str] = (), parts: int = 0) -> TableIndex:
        if clash := {PART, POS} & {c.lower() for c in df.columns}:
            raise ValueError(f"columns of these names have a meaning here: {sorted(clash)}")
        spark = df.sparkSession
        parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # The id of a row is its partition and, in the lower 33 bits, its position there.
        placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(POS, F.monotonically_increasing_id())
        placed = placed.withColumns({PART: F.shiftright(POS, 33).cast("int"), POS: F.col(POS).bitwiseAND(F.lit((1 << 33) - 1))})
        placed.sortWithinPartitions(PART, POS).write.partitionBy(PART).parquet(f"{path}/rows")
        spark.createDataFrame([], placed.schema).write.parquet(f"{path}/layout")  # an empty table has no part to tell its columns
        index = cls(spark, path, searched)
        rows = index._rows()
        rows.groupBy(PART).agg(F.count("*").alias("n")).write.parquet(f"{path}/counts")
        if searched:
            fields = F.array(*[F.struct(F.lit(i).alias("field"), trigrams(F.col(c)).alias("grams")) for i, c in enumerate(searched)])
            each = rows.select(PART, POS, F.inline(fields)).select(PART, POS, "field", F.explode("grams").alias("gram"))
            each.repartitionByRange(parts, "gram", "field", PART, POS).sortWithinPartitions("gram", "field", PART, POS).write.parquet(f"{path}/postings")
            counts = spark.read.parquet(f"{path}/postings").groupBy("gram", "field").agg(F.count("*").alias("n"))
            counts.sort("gram").write.parquet(f"{path}/grams")
        return index

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/layout").schema).parquet(f"{self.path}/rows")

    def rows(self) -> DataFrame:
        return self._rows().drop(PART, POS)

    def counts(self) -> list[tuple[int, int]]:
        """part and number of rows, in order: one entry a part."""
        return [tuple(r) for r in self.spark.read.schema(f"{PART} int, n long").parquet(f"{self.path}/counts").sort(PART).collect()]

    def page(self, number: int, limit: int) -> DataFrame:
        """What catalog.page() gives for the same order; reads only the parts and positions of the page."""
        if number < 1 or not 1 <= limit <= 100:
            raise ValueError("page must be at least 1 and limit between 1 and 100")
        start, before, wanted = (number - 1) * limit, 0, []
        for part, n in self.counts():
            low, high = max(start - before, 0), min(start + limit - before, n)
            if low < high:
                wanted.append((F.col(PART) == part) & F.col(POS).between(low, high - 1))
            before += n
        return self._rows().where(reduce(Column.__or__, wanted, F.lit(False))).orderBy(PART, POS).drop(PART, POS)

    def total(self) -> int:
        return sum(n for _, n in self.counts())

    def search(self, term: str | None, literal: bool = False) -> DataFrame:
        """What catalog.search() gives for the same rows and columns. Expressions without necessary trigrams, or with such as
        a quarter of all rows may have, are answered by a scan."""
        if not term:
            return self.rows()
        found = self.candidates(term, literal)
        return catalog.search(self._rows() if found is None else found, term, self.searched, literal).drop(PART, POS)

    def candidates(self, term: str, literal: bool = False) -> DataFrame | None:
        """Rows that have the necessary trigrams of a term in one column; None if a scan is due."""
        ways = necessary(term.lower(), literal)
        grams = sorted(set().union(*ways))
        if not all(ways):
            return None
        known = self.spark.read.parquet(f"{self.path}/grams").where(F.col("gram").isin(grams))
        counts = {(r["field"], r["gram"]): r["n"] for r in known.collect()}  # a term's trigrams by searched columns
        possible = [(field, sorted(way, key=lambda g: (counts[field, g], g))[:RAREST]) for field in range(len(self.searched)) for way in ways if all((field, g) in counts for g in way)]
        if sum(counts[field, rarest[0]] for field, rarest in possible) * 4 > self.total():
            return None
        if not possible:
            return self._rows().where(F.lit(False))
        has = lambda field, rarest: (F.count_if((F.col("field") == field) & F.col("gram").isin(rarest)) == len(rarest))
        asked = self.spark.read.parquet(f"{self.path}/postings").where(F.col("gram").isin(sorted({g for _, rarest in possible for g in rarest})))
        places = asked.groupBy(PART, POS).agg(reduce(Column.__or__, [has(*p) for p in possible]).alias("hit")).where("hit").select(PART, POS)
        places = written(places, "places")
        few = places.limit(LOOKUP + 1).collect()
        if len(few) > LOOKUP:
            return self._rows().join(places, [PART, POS], "left_semi")
        by_part: dict[int, list[int]] = {}
        for part, pos in few:
            by_part.setdefault(part, []).append(pos)
        return self._rows().where(reduce(Column.__or__, [(F.col(PART) == part) & F.col(POS).isin(at) for part, at in by_part.items()], F.lit(False)))


def trigrams(value: Column) -> Column:
    """Distinct runs of three characters of a text in lower case; none for null and shorter ones."""
    chars = F.split(F.lower(value), "")
    follow = lambda a, n: F.zip_with(a, F.slice(chars, n, F.size(chars)), lambda x, y: F.concat(x, y))  # noqa: E731 (null past the end)
    return F.array_distinct(F.filter(follow(follow(chars, 2), 3), lambda g: g.isNotNull()))


def grams_of(run: str) -> frozenset[str]:
    return frozenset(run[i : i + 3] for i in range(len(run) - 2))


class _Unsure(Exception):
    """Syntax of which it isn't known what it makes necessary."""


def necessary(pattern: str, literal: bool = False) -> list[frozenset[str]]:
    """Ways to match, each as a set of trigrams: a text that matches has all of at least one set. An empty set says nothing.

    Of an expression, literal runs and groups count if they occur at least once; classes, boundaries, lookarounds and
    optional parts say nothing. Flags, quotations and rare escapes make the whole expression say nothing.
    """
    if literal:
        return [grams_of(pattern)]
    try:
        ways, end = _choice(pattern, 0)
        return ways if end == len(pattern) else [frozenset()]
    except (_Unsure, IndexError, RecursionError):
        return [frozenset()]


def _choice(p: str, i: int) -> tuple[list[frozenset[str]], int]:
    """Branches up to the closing bracket or the end."""
    ways, i = _sequence(p, i)
    while i < len(p) and p[i] == "|":
        more, i = _sequence(p, i + 1)
        ways = ways + more
    ways = list(dict.fromkeys(ways))
    return (ways if len(ways) <= WAYS else [frozenset()]), i


def _sequence(p: str, i: int) -> tuple[list[frozenset[str]], int]:
    ways, run = [frozenset()], ""
    while i < len(p) and p[i] not in "|)":
        char, inner, i = _atom(p, i)
        at_least_once, once, i = _repeats(p, i)
        if char and at_least_once:
            run += char
        if not (char and once):
            ways, run = [w | grams_of(run) for w in ways], ""
        if inner and at_least_once and len(ways) * len(inner) <= WAYS:
            ways = [w | v for w in ways for v in inner]
    return [w | grams_of(run) for w in ways], i


def _atom(p: str, i: int) -> tuple[str, list[frozenset[str]], int]:
    """The character that the next item stands for, or the ways of a group, or neither; and where it ends."""
    c = p[i]
    if c == "\\":
        if not p[i + 1].isalnum():
            return p[i + 1], [], i + 2
        if p[i + 1] not in "dwsbhvntrfz":
            raise _Unsure
        return "", [], i + 2
    if c == "[":
        j = i + 1 + (p[i + 1] == "^")
        if p[j] == "]":
            raise _Unsure
        while p[j] != "]":
            if p[j] == "[" or p[j : j + 2] == "&&":
                raise _Unsure
            j += 2 if p[j] == "\\" else 1
        return "", [], j + 1
    if c == "(":
        silent = next((s for s in ("(?=", "(?!", "(?<=", "(?<!") if p.startswith(s, i)), "")
        if p[i + 1] == "?" and not silent and p[i + 2] != ":":
            raise _Unsure
        ways, end = _choice(p, i + (len(silent) or (3 if p[i + 1] == "?" else 1)))
        if p[end] != ")":
            raise _Unsure
        return "", [] if silent else ways, end + 1
    if c in "*+?{":
        raise _Unsure
    return ("" if c in ".^$" else c), [], i + 1


def _repeats(p: str, i: int) -> tuple[bool, bool, int]:
    """Whether what stands before occurs at least once, and exactly once; and where its quantifier ends."""
    if i == len(p) or p[i] not in "*+?{":
        return True, True, i
    some = p[i] == "+"
    i = p.index("}", i) + 1 if p[i] == "{" and "}" in p[i:] else i + 1
    return some, False, i + (i < len(p) and p[i] in "?+")
