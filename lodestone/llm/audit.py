"""Source divergence audit: how far the word frequencies of each source of a language lie from one another.

Terms are counted by sorting pointers. A shard, a bounded run of documents, stays one Arrow buffer of bytes with A-Z
lower-cased; a pointer stands at every word's start. Multikey quicksort orders the pointers by eight bytes of
their words at a time: one quicksort of the keys, after which only runs that are still equal go on to the next
eight bytes. What is equal in the end is one run of a term, with its documents in order, so that a pass over it
gives its occurrences and its documents for each (lang, source). Spark sums these over the shards.

From there on all is exact integer arithmetic in Spark. For a pair of sources the differences of all kept terms
are summed in blocks of terms by tiles of sources, as matrices of bounded size, and the blocks' sums added up.

Defined results: null text, lang and source are ''; a document is a row, so repeated rows count as often as they
stand there; a text without letters has no terms, yet its (lang, source) is a group; a language in which no
term is in enough documents has V = 0 and pairs with value 0; ties go to the smaller item by its UTF-8 bytes; an empty table
gives an empty result; other columns are ignored. A text is never cut: one longer than a shard is a shard of its own, and a
word of any length is one term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, UPPER, stage

LEAST_DOCS, TOP_TERMS, SCALE, SMOOTH = 30, 50, 1_000_000_000, 5
#: Bytes of text of a shard; levels of eight bytes that are sorted as numbers before words are compared whole.
SHARD_BYTES, LEVELS = 12_000_000, 32
#: Terms of a block and sources of a tile: a task of the pair sums holds two matrices of this size.
BLOCK_TERMS, TILE_SOURCES = 2048, 256

_KIND = np.zeros(256, bool)
_KIND[0x80:] = True
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pointers to the starts of words in data, in order, their lengths, and the texts (between offsets) they are in."""
    letter = np.zeros(len(data) + 2, bool)
    letter[1:-1] = _KIND[data]
    edge = letter[1:] != letter[:-1]  # edge[i]: a word starts or ends before byte i
    # where one text's last word meets the first word of the next
    meet = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    meet = meet[letter[meet] & letter[meet + 1]]
    at = np.flatnonzero(edge)
    starts, ends = np.sort(np.append(at[::2], meet)), np.sort(np.append(at[1::2], meet))
    return starts, ends - starts, np.searchsorted(offsets, starts, side="right") - 1


def _eight_bytes(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes at each pointer as a number that sorts like them, zero where a word has ended. data has
    eight bytes to spare."""
    words = np.lib.stride_tricks.as_strided(data[:8].view(">u8"), shape=(len(data) - 7,), strides=(1,))
    spare = (8 * (8 - np.clip(left, 0, 8))).astype(np.uint64)
    return np.where(left > 0, words[at].astype(np.uint64) >> spare << spare, np.uint64(0))


def sort_pointers(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pointers by their words, equal ones in the order given, and where in it a new word begins."""
    key = _eight_bytes(data, starts, lengths)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(order), bool)
    new[1:] = key[1:] != key[:-1]
    whole = lambda k: (k & np.uint64(0xFF)) != 0  # noqa: E731  # all eight bytes are letters: the word may go on
    open_ = np.flatnonzero(whole(key))
    for level in range(1, LEVELS + 1):
        open_ = open_[_in_runs(new, open_)]
        if not len(open_):
            return order, new
        own = order[open_]
        run = new[open_].cumsum()
        if level < LEVELS:
            key = _eight_bytes(data, starts[own] + 8 * level, lengths[own] - 8 * level)
            sub = np.lexsort((key, run))
            key = key[sub]
        else:  # what is still equal is compared as bytes
            words = [data[s : s + n].tobytes() for s, n in zip(starts[own].tolist(), lengths[own].tolist())]
            sub = np.array(sorted(range(len(own)), key=lambda i: (run[i], words[i])), dtype=np.int64)
            number = {w: i for i, w in enumerate(dict.fromkeys(words[i] for i in sub))}
            key = np.array([number[words[i]] for i in sub], dtype=np.uint64)
        order[open_] = own[sub]  # runs keep their places
        first = new[open_]
        first[1:] |= key[1:] != key[:-1]
        new[open_] = first
        open_ = open_[whole(key)] if level < LEVELS else open_[:0]
    return order, new


def _in_runs(new: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which positions lie in a run of more than one pointer."""
    return ~(new[at] & np.append(new, [True])[at + 1])


def shard_counts(texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """term, group, occurrences and documents for every term of every group of texts. group ascends."""
    texts = texts.cast(pa.large_string())
    raw = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[raw[0] : raw[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    data = np.append(_FOLD[body], np.zeros(8, np.uint8))
    starts, lengths, doc = word_starts(data[:-8], raw - raw[0])
    if not len(starts):
        return pa.array([], pa.string()), *(np.zeros(0, np.int64) for _ in range(3))
    order, new = sort_pointers(data, starts, lengths)
    doc = doc[order]
    fresh = new.copy()  # a document's first pointer within a run
    fresh[1:] |= doc[1:] != doc[:-1]
    own = group[doc]
    head = new.copy()
    head[1:] |= own[1:] != own[:-1]
    at = np.flatnonzero(head)
    first, length = starts[order[at]], lengths[order[at]]
    ends = length.cumsum()
    bytes_ = data[np.repeat(first - (ends - length), length) + np.arange(ends[-1])]
    terms = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append([0], ends).astype(np.int64)), pa.py_buffer(bytes_)])
    return terms.cast(pa.string()), own[at], np.diff(np.append(at, len(order))), np.add.reduceat(fresh.astype(np.int64), at)


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs, for every term of each (lang, source)."""
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.binary_length(batch.column("text")), dtype=np.int64).cumsum() if batch.num_rows else np.zeros(0, np.int64)
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SHARD_BYTES, side="right")))
                part = pa.Table.from_batches([batch.slice(at, end - at)]).sort_by([("lang", "ascending"), ("source", "ascending")]).combine_chunks()
                at = end
                lang, source, text = (part.column(c).chunk(0) for c in ("lang", "source", "text"))
                changed = np.ones(len(text), bool)
                changed[1:] = np.asarray(pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(source[1:], source[:-1])))
                terms, group, n, in_docs = shard_counts(text, changed.cumsum() - 1)
                of = pa.array(np.flatnonzero(changed)[group])
                yield pa.RecordBatch.from_arrays([lang.take(of), source.take(of), terms, pa.array(n, pa.int64()), pa.array(in_docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])
        pa.default_memory_pool().release_unused()

    counted = own.mapInArrow(sort, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + SMOOTH) / (total + SMOOTH terms)), exact."""
    big = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", (big(count) + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), big(total) + big(terms) * SMOOTH)


def _pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, other, value: the differences of p, less those of floor, summed over the kept terms that either
    source has; of the others only the difference of floor, the p of a term that doesn't occur, remains.

    shares: what occurs; groups: every source. A task sees one block of terms and two tiles of sources.
    """
    tiles = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least("tile", t).alias("a"), F.greatest("tile", t).alias("b"))))
    left = shares.withColumn("t", tiles).select("lang", "block", "t.a", "t.b", "source", "tile", "term", "p")
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    right = groups.where("blocks > 0").withColumn("block", blocks).withColumn("t", tiles).select("lang", "block", "t.a", "t.b", "source", "tile", "floor")

    def differ(key: tuple, table: pa.Table, sources: pa.Table) -> pa.Table:
        lang, _, a, b = (k.as_py() for k in key)
        terms, rows = pc.unique(table.column("term")), {}
        for tile in {a, b}:
            own, seen = sources.filter(pc.equal(sources.column("tile"), tile)), table.filter(pc.equal(table.column("tile"), tile))
            names, floor = own.column("source").combine_chunks(), np.asarray(own.column("floor").combine_chunks(), dtype=np.int64)
            p = np.repeat(floor[:, None], len(terms), axis=1)
            p[np.asarray(pc.index_in(seen.column("source"), names), dtype=np.int64), np.asarray(pc.index_in(seen.column("term"), terms), dtype=np.int64)] = np.asarray(seen.column("p"), dtype=np.int64)
            rows[tile] = names, floor, p
        (names, floor, p), (others, low, q) = rows[a], rows[b]
        value = np.array([np.abs(q - one).sum(axis=1) - len(terms) * np.abs(low - f) for one, f in zip(p, floor)], dtype=np.int64).reshape(len(names), len(others))
        i, j = (x.ravel() for x in np.indices(value.shape))
        x, y = names.take(pa.array(i)), others.take(pa.array(j))
        sides = [(x, y)] if a == b else [(x, y), (y, x)]
        return pa.concat_tables(pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": s, "other": o, "value": value.ravel()}) for s, o in sides)

    keys = ["lang", "block", "a", "b"]
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(differ, "lang string, source string, other string, value long")
    return parts.where("source <> other").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: part pair has every other source of the language with the summed
    differences of all kept terms; part term has the terms that stand out most against the language."""
    counts = stage(count_terms(docs), "audit-counts")
    occurring = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    kept = stage(counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs"), "audit-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_n"))
    own = stage(counts.drop("docs").join(kept, ["lang", "term"]), "audit-own")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # one row for each (lang, source); sources are numbered within their language
    number, sources = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1, F.count("*").over(Window.partitionBy("lang"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = occurring.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("total"), zero("v"), zero("lang_n"), F.floor(number / TILE_SOURCES).cast("int").alias("tile"), F.ceil(sources / TILE_SOURCES).cast("int").alias("tiles"))
    groups = stage(groups.withColumns({"blocks": F.ceil(F.col("v") / BLOCK_TERMS).cast("int"), "floor": F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v")))}), "audit-groups")

    shares = own.join(groups, ["lang", "source"]).withColumns({"p": _share(F.col("n"), F.col("total"), F.col("v")), "q": _share(F.col("in_lang"), F.col("lang_n"), F.col("v")), "block": F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")})
    shares = stage(shares.select("lang", "source", "term", "p", "q", "block", "tile", "tiles"), "audit-shares")
    others = groups.select("lang", F.col("source").alias("other"), F.col("floor").alias("low"))
    pairs = groups.select("lang", "source", "v", "floor").join(others, "lang").where("source <> other").join(_pair_sums(shares, groups), ["lang", "source", "other"], "left")
    value = F.coalesce(F.col("v") * F.abs(F.col("floor") - F.col("low")), F.lit(0).cast("long")) + F.coalesce("value", F.lit(0).cast("long"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), value.alias("value"))
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", rank).select(*columns).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= TOP_TERMS).select(*columns))


ORACLE_SQL = f"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
n AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {LEAST_DOCS}),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + ({SCALE}::HUGEINT * (n + {SMOOTH})) // (sum(n) OVER (PARTITION BY lang, source) + {SMOOTH} * v)::HUGEINT AS p FROM c JOIN size USING (lang)),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (n + {SMOOTH})::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + {SMOOTH} * v)::HUGEINT AS q FROM l JOIN size USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
