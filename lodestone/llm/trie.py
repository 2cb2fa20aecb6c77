"""Conversation prefix trie: which beginnings conversations share, and what storing them once would save.

A node is a distinct beginning. Its identity is two 64-bit sums without carries over the hashes of its turns, each
hashed with its place; such sums can be put together from parts, so a conversation of any length is dealt over
many tasks. Consecutive nodes with the same members are one chain, known by its smallest conv_id and its number of
conversations. Every leaf has one path of chains, and as their counts fall along it, a path is never longer than
the square root of twice the number of turns.

Paths are sorted and dealt to shards by range. A shard writes its part of the trie of chains as balanced
parentheses. Their excess is kept with the least value of each block and a tree of minima over the blocks, by which findclose
finds the end of every subtree; the rank of () pairs counts its leaves, and cumulative arrays over the opening
parentheses give its savings. The spines, the first and the last path of a shard, may go on in its neighbours: a chain
counts in the first shard that has it, and what the shards found for the chains of their spines is summed.

Defined results: rows with a null conv_id take no part; turns with the same number are ordered by role, then text;
a conversation with several equal rows has them as several turns; null role and text are empty; turns beyond h and base
conversations that are absent leave a conversation shorter, down to no turn, and then it ends in the root; an empty table
gives an empty result, without a root; other columns are ignored. Ids of members are hashed in ascending order as a
stream of bounded pieces, as SHA-256 has no other order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import stage
from lodestone.operators.frames import numbered

EVERY, TURNS = 5, 9
#: Turns of a conversation whose prefixes are summed in one task; chains on the paths of a shard; parentheses of a
#: block; 2**CHUNK_BITS ids go to one piece of a list of members.
RUN_TURNS, SHARD_CHAINS, BLOCK, CHUNK_BITS = 4096, 200_000, 16, 16


# --- balanced parentheses


class Parentheses:
    """A balanced sequence with its excess, the least excess of every block, and a tree of these minima."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        self.excess = np.where(opens, 1, -1).cumsum()
        blocks = max(1, -(-len(opens) // BLOCK))
        self.leaves = 1 << (blocks - 1).bit_length()
        padded = np.full(self.leaves * BLOCK, np.iinfo(np.int64).max)
        padded[: len(opens)] = self.excess
        self.least = np.zeros(2 * self.leaves, np.int64)  # a heap: the children of i are 2i and 2i + 1
        self.least[self.leaves :] = padded.reshape(-1, BLOCK).min(axis=1)
        for i in range(self.leaves.bit_length() - 1, 0, -1):
            at = np.arange(1 << (i - 1), 1 << i)
            self.least[at] = np.minimum(self.least[2 * at], self.least[2 * at + 1])
        self.padded = padded

    def _in_block(self, at: np.ndarray, below: np.ndarray) -> np.ndarray:
        """From each position on, in its own block, the first whose excess is below; -1 if there is none."""
        found, live = np.full(len(at), -1), np.arange(len(at))
        at = at.copy()
        while len(live):
            hit = self.padded[at[live]] < below[live]
            found[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] % BLOCK != 0]
        return found

    def find_close(self, at: np.ndarray) -> np.ndarray:
        """The closing parenthesis of each opening one: the first position after it with less excess."""
        below = self.excess[at]
        nxt = at + 1
        found = np.full(len(at), -1)
        near = np.flatnonzero(nxt % BLOCK != 0)
        found[near] = self._in_block(nxt[near], below[near])
        far = np.flatnonzero(found < 0)
        # the first block that reaches below, from the next one on: up the tree as long as the right side doesn't, then down
        block = self.leaves + -(-nxt[far] // BLOCK)
        climbing = np.arange(len(far))
        while len(climbing):
            climbing = climbing[self.least[block[climbing]] >= below[far[climbing]]]
            block[climbing] = np.where(block[climbing] % 2 == 0, block[climbing] + 1, (block[climbing] + 1) // 2)
        going = np.flatnonzero(block < self.leaves)
        while len(going):
            left = 2 * block[going]
            block[going] = np.where(self.least[left] < below[far[going]], left, left + 1)
            going = going[block[going] < self.leaves]
        found[far] = self._in_block((block - self.leaves) * BLOCK, below[far])
        return found

    def leaf_rank(self, counts: np.ndarray) -> np.ndarray:
        """How many () pairs that count begin before each position; counts: for each opening, in order, whether it does."""
        pair = np.zeros(len(self.opens) + 1, np.int64)
        pair[1:-1] = self.opens[:-1] & ~self.opens[1:]
        own = np.zeros(len(self.opens) + 1, np.int64)
        own[1:][self.opens] = counts
        return (pair * own).cumsum()


def _shard_trie(paths: list[list[tuple]], before: list[tuple] | None) -> dict[str, list]:
    """For each chain of a shard of sorted paths: its parent, and the leaves, children and savings that count here.

    A path: (conv_id, n_convs, bytes) of each chain, root first. before: the last path before this shard's first."""
    chains, parent, bits = [], [], []
    shared = 0
    for a, b in zip(paths[0], before or []):
        if a[:2] != b[:2]:
            break
        shared += 1
    path: list[tuple] = []
    on_path: list[int] = []  # numbers of the chains of the path
    for new in paths:
        same = 0
        while same < len(path) and path[same][:2] == new[same][:2]:
            same += 1
        bits.append(np.zeros(len(path) - same, bool))
        bits.append(np.ones(len(new) - same, bool))
        on_path = on_path[:same]
        for chain in new[same:]:
            parent.append(on_path[-1] if on_path else -1)
            on_path.append(len(chains))
            chains.append(chain)
        path = new
    bits.append(np.zeros(len(path), bool))
    tree = Parentheses(np.concatenate(bits))
    owned = np.ones(len(chains), np.int64)
    owned[:shared] = 0  # preorder: the first path's chains come first
    at = np.flatnonzero(tree.opens)
    close = tree.find_close(at)
    rank = tree.leaf_rank(owned)
    conv, n, size = (np.array([c[i] for c in chains], dtype=np.int64) for i in range(3))
    saved = np.append([0], (owned * (n - 1) * size).cumsum())
    opened = tree.opens.cumsum()  # openings up to and with a position
    up = np.array(parent)
    children = np.zeros(len(chains), np.int64)
    np.add.at(children, up[up >= 0], owned[up >= 0])
    spine = np.zeros(len(chains), bool)
    spine[: len(paths[0])] = True
    spine[on_path] = True
    return {
        "conv_id": conv, "n_convs": n, "parent": [int(conv[p]) if p >= 0 else None for p in parent], "leaves": rank[close + 1] - rank[at],
        "children": children, "saved": saved[opened[close]] - saved[opened[at] - 1], "spine": spine,
    }


# --- rebuilt conversations, nodes and chains


def _xor(c: str, window: Column) -> Column:
    return F.coalesce(F.bit_xor(c).over(window), F.lit(0).cast("long"))


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of every conversation conv_id and length, and of every rebuilt turn conv_id, depth, a, b (its hashes) and bytes."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role").alias("role"), text("text").alias("text"))
    placed = numbered(rows, "conv_id", "turn", "role", "text")
    turns = stage(placed.select("conv_id", F.col("__pos").alias("pos"), F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(7), "text", "role").alias("b"), F.octet_length("text").cast("long").alias("bytes")), "trie-turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % EVERY
    known = sizes.select("conv_id", "n", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % TURNS).alias("h"))
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0).cast("long")))
    convs = stage(known.join(of_base, "base", "left").select("conv_id", "base", "h", taken.alias("m"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie-convs")
    own = turns.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "a", "b", "bytes")
    heads = turns.where(F.col("pos") < TURNS).withColumnRenamed("conv_id", "base")
    first = heads.join(convs, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "a", "b", "bytes")
    every = own.unionByName(first)
    return convs.select("conv_id", "length"), every.select("conv_id", "depth", F.xxhash64("depth", "a", "b").alias("a"), F.xxhash64("b", "a", "depth").alias("b"), "bytes")


def prefixes(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, depth, a, b (what identifies the first depth turns), bytes (of the last), upto (of all), last (whether the
    conversation ends there), for every depth from 0."""
    dealt = stage(turns.withColumn("run", F.floor((F.col("depth") - 1) / RUN_TURNS)), "trie-rebuilt")
    within = Window.partitionBy("conv_id", "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    runs = dealt.groupBy("conv_id", "run").agg(F.bit_xor("a").alias("run_a"), F.bit_xor("b").alias("run_b"), F.sum("bytes").alias("run_bytes"))
    earlier = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "run", _xor("run_a", earlier).alias("from_a"), _xor("run_b", earlier).alias("from_b"), F.coalesce(F.sum("run_bytes").over(earlier), F.lit(0).cast("long")).alias("from_bytes"))
    local = dealt.select("conv_id", "run", "depth", "bytes", _xor("a", within).alias("a"), _xor("b", within).alias("b"), F.sum("bytes").over(within).alias("upto"))
    summed = local.join(runs, ["conv_id", "run"]).select("conv_id", "depth", F.col("a").bitwiseXOR(F.col("from_a")).alias("a"), F.col("b").bitwiseXOR(F.col("from_b")).alias("b"), "bytes", (F.col("upto") + F.col("from_bytes")).alias("upto"))
    zero = F.lit(0).cast("long")
    ending = summed.join(convs, "conv_id").select(*summed.columns, (F.col("depth") == F.col("length")).alias("last"))
    return ending.unionByName(convs.select("conv_id", *[zero.alias(c) for c in ("depth", "a", "b", "bytes", "upto")], (F.col("length") == 0).alias("last")))


def _ends(beginnings: DataFrame) -> DataFrame:
    """depth, a, b and ends_sha256 of the nodes in which conversations end."""
    key = ["depth", "a", "b"]
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = beginnings.where("last").groupBy(*key, F.shiftright("conv_id", CHUNK_BITS).alias("piece")).agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of one node follow each other; of all that was read only the state of one hash is kept."""
        node, state = None, None
        for batch in batches:
            done = []
            for *new, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids"))):
                if new != node:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = new, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _ended(done)
        if node:
            yield _ended([(*node, state.hexdigest())])

    def _ended(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], pa.int64() if i < 3 else pa.string()) for i in range(4)]
        return pa.RecordBatch.from_arrays(columns, names=[*key, "ends_sha256"])

    return pieces.repartition(*key).sortWithinPartitions(*key, "piece").mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def _paths(beginnings: DataFrame, nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """path: of each leaf the (conv_id, n_convs, bytes) of all chains from the root to it."""
    leaves = chains.where("leaf").select(F.col("conv_id").alias("leaf_conv"))
    below = beginnings.join(leaves, beginnings["conv_id"] == leaves["leaf_conv"]).select("leaf_conv", "depth", "a", "b")
    met = below.join(nodes.select("depth", "a", "b", "conv_id", "n_convs"), ["depth", "a", "b"]).groupBy("leaf_conv", "conv_id", "n_convs").agg(F.count("*").alias("_"))
    with_bytes = met.join(chains.select("conv_id", "n_convs", (F.col("upto") - F.col("above")).alias("bytes")), ["conv_id", "n_convs"])
    # from the root on the number of conversations falls
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n_convs")).alias("order"), "conv_id", "n_convs", "bytes")))
    return with_bytes.groupBy("leaf_conv").agg(F.transform(ordered, lambda x: F.struct(x["conv_id"].alias("conv_id"), x["n_convs"].alias("n_convs"), x["bytes"].alias("bytes"))).alias("path")).select("path")


def chain_totals(paths: DataFrame) -> DataFrame:
    """conv_id, n_convs, parent, leaves, children, saved of every chain, from the leaves' paths."""
    size = paths.agg(F.sum(F.size("path"))).first()[0] or 0
    sharded = stage(paths.repartitionByRange(max(1, -(-size // SHARD_CHAINS)), "path").withColumn("shard", F.spark_partition_id()), "trie-shards")
    lasts = stage(sharded.groupBy("shard").agg(F.max("path").alias("before")), "trie-lasts")
    # one number for each shard
    follows = lasts.select("shard", F.lag("shard").over(Window.orderBy("shard")).alias("earlier"))
    before = follows.join(lasts.withColumnRenamed("shard", "earlier"), "earlier").select("shard", "before")

    def encode(key: tuple, own: pa.Table, previous: pa.Table) -> pa.Table:
        plain = lambda path: [(c["conv_id"], c["n_convs"], c["bytes"]) for c in path]
        found = _shard_trie(sorted(map(plain, own.column("path").to_pylist())), plain(previous.column("before")[0].as_py()) if previous.num_rows else None)
        return pa.table({name: pa.array(values, pa.bool_() if name == "spine" else pa.int64()) for name, values in found.items()})

    parts = sharded.groupBy("shard").cogroup(before.groupBy("shard")).applyInArrow(encode, "conv_id long, n_convs long, parent long, leaves long, children long, saved long, spine boolean")
    parts = stage(parts, "trie-parts")
    merged = parts.where("spine").groupBy("conv_id", "n_convs").agg(F.max("parent").alias("parent"), *[F.sum(c).alias(c) for c in ("leaves", "children", "saved")])
    return parts.where("NOT spine").drop("spine").unionByName(merged)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    beginnings = stage(prefixes(*rebuilt_turns(conversations)), "trie-prefixes")
    nodes = beginnings.groupBy("depth", "a", "b").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), F.max("upto").alias("upto"), F.count_if("last").alias("ends"))
    nodes = stage(nodes, "trie-nodes")
    chains = nodes.groupBy("conv_id", "n_convs").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.min(F.col("upto") - F.col("bytes")).alias("above"), F.max("upto").alias("upto"), F.max(F.col("ends") == F.col("n_convs")).alias("leaf"))
    chains = stage(chains, "trie-chains")
    totals = chain_totals(stage(_paths(beginnings, nodes, chains), "trie-paths"))
    known = chains.select("conv_id", "n_convs", "top", "bottom", "above").join(totals, ["conv_id", "n_convs"])
    every = nodes.join(known, ["conv_id", "n_convs"]).join(_ends(beginnings), ["depth", "a", "b"], "left")
    parent = F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent"))
    not_below = (F.col("n_convs") - 1) * (F.col("upto") - F.col("bytes") - F.col("above"))
    return every.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.when(F.col("depth") < F.col("bottom"), F.lit(1).cast("long")).otherwise(F.col("children")).alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("saved") - not_below).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(unicode(x) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)"
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, role, text
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
o AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY pos) AS turns FROM t GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - conv_id % {EVERY} AS base, CAST({_CRC} AS BIGINT) % {TURNS} AS h FROM o),
c AS (SELECT h.conv_id, list_concat(coalesce(o.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN o ON o.conv_id = h.base),
m AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM c),
p AS (SELECT conv_id, depth, turns[1:depth] AS path, depth = len(turns) AS last FROM m),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(strlen(path[depth].t), 0) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM p GROUP BY path, depth),
k AS (SELECT a.path, a.depth, count(b.depth) AS n_children FROM n a LEFT JOIN n b ON b.depth = a.depth + 1 AND b.path[1:a.depth] = a.path GROUP BY a.path, a.depth),
f AS (SELECT n.*, k.n_children FROM n JOIN k USING (path, depth)),
s AS (SELECT a.path, a.depth, count_if(b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved FROM f a JOIN f b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY a.path, a.depth)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (path, depth) LEFT JOIN n q ON q.depth = f.depth - 1 AND q.path = f.path[1:f.depth - 1]
"""
