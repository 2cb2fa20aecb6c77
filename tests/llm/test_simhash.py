import random
import re

import xxhash
from helpers import ODD, ODD_IDS, documents

from lodestone.llm import simhash
from lodestone.llm.components import component_labels

UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(str((d, f"{f:016x}", least.get(find(i)))) for i, ((d, _), f) in enumerate(zip(rows, fps)))


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([4, 60, 400]))]
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def test_against_brute_force(spark):
    rows = list(zip(range(1000, 1100), texts())) + list(zip(ODD_IDS, ODD))
    got = simhash.simhash_components(documents(spark, [t for _, t in rows], [d for d, _ in rows])).collect()
    want = brute(rows)
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    assert any(str(d) not in w.split(",")[-1] for d, w in zip(range(1000, 1100), want))


def test_chains_and_hubs_of_links(spark):
    # a chain in order is the longest way for pointers
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(5000, 5001)]
    got = {}
    for r in component_labels(spark.createDataFrame(links, "a long, b long")).collect():
        got.setdefault(r.label, set()).add(r.node)
    assert sorted(map(len, got.values())) == [2, 100, 201]


def test_one_row_of_each_component_stays(spark):
    rows = list(zip(ODD_IDS, ODD))
    docs = documents(spark, [t for _, t in rows], [d for d, _ in rows])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    roots = simhash._components(docs)[1].select("root").distinct().count()
    assert kept.count() == roots


def test_empty_table(spark):
    assert simhash.simhash_components(documents(spark, []).limit(0)).count() == 0
