import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from helpers import DOCS, ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import audit

UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=30):
    rows = [(lang or "", source or "", [t.translate(UP) for t in TERM.findall(text or "")]) for text, lang, source in rows]
    docs, n, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, terms in rows:
        docs[lang].update(set(terms))
        n[lang, source].update(terms)
    for lang in {r[0] for r in rows}:
        kept = sorted(t for t, k in docs[lang].items() if k >= least)
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[k] for k in kept) + 5 * len(kept)) for t in kept}
        sources = [s for g, s in n if g == lang]
        p = {s: share(n[lang, s]) for s in sources}
        q = share(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, items, top in (("pair", pairs, None), ("term", terms, 50)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:top]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def found(spark, rows):
    table = spark.createDataFrame([(i, text, lang, source, None, "x", "y") for i, (text, lang, source) in enumerate(rows)], DOCS)
    return sorted(tuple(r) for r in audit.source_divergence(table).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed=4, n=400, sources=7):
    rng = random.Random(seed)
    words = [f"{rng.choice(['Ab', 'x', 'ÉT', 'supercalifragilistic'])}{'abcdefgh'[i % 8]}{'qrstuvw'[i % 7]}" for i in range(40)]
    return [(" ".join(rng.choices(words, range(1, 41), k=rng.randrange(60))), rng.choice(["en", "de"]), f"s{min(rng.randrange(sources * 2), sources - 1)}") for _ in range(n)]


def test_against_brute_force(spark):
    rows = corpus() + [(t, None, "odd") for t in ODD] + [(None, "en", None), ("", "fr", "alone"), ("alone", "it", "a"), ("two", "it", "b")]
    rows += [("same words here", "en", "copies")] * 300  # repeated rows count as often as they are there
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(audit, "BLOCK_TERMS", 5)
    monkeypatch.setattr(audit, "TILE_SOURCES", 3)
    monkeypatch.setattr(audit, "LEAST_DOCS", 8)
    rows = corpus(seed=6, n=150)
    assert found(spark, rows) == brute(rows, 8)


WORDS = st.lists(st.text(st.sampled_from("aBé-"), max_size=30), max_size=12)


@settings(max_examples=150, deadline=None)
@given(WORDS, st.integers(1, 5))
def test_pointers_find_every_word(texts, levels):
    group = np.arange(len(texts)) // 3
    before, audit.LEVELS = audit.LEVELS, levels
    try:
        terms, own, n, docs = audit.shard_counts(pa.array(texts, pa.string()), group)
    finally:
        audit.LEVELS = before
    want, in_docs = Counter(), Counter()
    for g, text in zip(group.tolist(), texts):
        found = [t.translate(UP) for t in TERM.findall(text)]
        want.update((t, g) for t in found)
        in_docs.update((t, g) for t in set(found))
    keys = list(zip(terms.to_pylist(), own.tolist()))
    assert keys == sorted(keys, key=lambda k: (k[0].encode(), k[1]))
    assert dict(zip(keys, n.tolist())) == want and dict(zip(keys, docs.tolist())) == in_docs


def test_very_long_words():
    long = "a" * 200_000
    terms, _, n, docs = audit.shard_counts(pa.array([long, long + "b " + long, "a"]), np.zeros(3, np.int64))
    assert [len(t) for t in terms.to_pylist()] == [1, 200_000, 200_001] and n.tolist() == [1, 2, 1] and docs.tolist() == [1, 2, 1]
