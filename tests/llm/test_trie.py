import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, path int"
ROWS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
        ends[rebuilt].append(c)
        for d in range(len(rebuilt) + 1):
            nodes[rebuilt[:d]].append(c)
    children = defaultdict(int)
    for path in nodes:
        if path:
            children[path[:-1]] += 1
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children[path], sum(not children[p] for p in below),
            sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p), hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted((tuple(r[c] for c in ROWS) for r in trie.prefix_trie(table).collect()), key=str)


def conversations(seed=3, n=120):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 12])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t else "system", rng.choice(["hi", "no", "é", ""]) if t else "be kind"))
    return rows


def test_against_brute_force_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_CHAINS", 40)
    monkeypatch.setattr(trie, "RUN_TURNS", 3)
    monkeypatch.setattr(trie, "CHUNK_BITS", 2)
    rows = conversations()
    assert found(spark, rows) == brute(rows)


def test_copies_odd_rows_and_absent_bases(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(200, 260) for t in range(4)]  # one group of copies
    rows += [(7, None, None, None), (7, 1, "user", "b"), (7, 1, "user", "a"), (7, 1, "user", "a"), (None, 1, "user", "lost"), (1003, 0, None, ""), (-3, 2, "user", "x"), (-3, 1, "", "y" * 5000)]
    rows += [(40, t, "user", "again") for t in range(300)] + [(41, t, "user", "again") for t in range(280)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


def test_one_conversation_of_many_turns_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN_TURNS", 64)
    rows = [(10, t, "user", f"{t}") for t in range(1500)] + [(15, t, "user", f"{t}") for t in range(1500)]
    got = found(spark, rows)
    assert len(got) == 1501 + (0 if zlib.crc32(b"15") % 9 <= 1500 else 1)
    top = next(r for r in got if r[1] == 0)
    assert top[3:7] == (2, 1, 1, sum(len(f"{t}") for t in range(1500)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=300))
def test_find_close(choices):
    bits, depth = [True], 1
    for up in choices:
        if up or depth > 1:
            bits.append(up)
            depth += 1 if up else -1
    bits += [False] * depth
    stack, close = [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            close[stack.pop()] = i
    tree = trie.Parentheses(np.array(bits))
    at = np.flatnonzero(tree.opens)
    assert tree.find_close(at).tolist() == [close[i] for i in at.tolist()]
    rank = tree.leaf_rank(np.ones(len(at), np.int64))
    assert (rank[tree.find_close(at) + 1] - rank[at]).tolist() == [sum(bits[j] and not bits[j + 1] for j in range(i, close[i])) for i in at.tolist()]
