"""Token ids as a content-addressed store.

A rolling hash over the last ids cuts every document's id stream where its content says so, so equal
passages become equal chunks. A chunk is named by the BLAKE2b digest of its bytes and stored once. A
document is a recipe: its chunks in order and the Merkle root over them. Recipes lie in ascending doc_id
order, with the number of ids before each document; a manifest holds one Merkle root per recipe file.

One shuffle carries the chunks: a task sends each of its distinct chunks once, so a chunk of many copies
reaches its owner at most once per task. How many recipe files there are follows from the number of documents,
and a file's Merkle tree is built from blocks of a bounded number of documents, so no task holds a file.
Reading back checks every chunk against its name, every recipe against its root and every file against the
manifest, and any mismatch raises an error.

Defined results: a null or empty text is the end id alone; documents without a doc_id come first, and rows
that share a doc_id follow one another by a row number, each with its own recipe; other columns are
ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.tokens import default_vocabulary, encoder, slices
from lodestone.sources.shared import scratch

END = 0
#: Ids that the rolling hash sees, its cut mask (one place in 256 cuts), least and most ids of a chunk.
SPAN, MASK, LEAST, MOST = 8, 255, 64, 1024
DIGEST = 16
#: Documents of a recipe file, on average, and of a block of its Merkle tree (a power of two, so that the blocks'
#: roots are nodes of the tree over all documents of the file).
FILE_ROWS, BLOCK_ROWS = 100_000, 4096
#: Names that a task remembers as already sent; when full, it starts anew and may send one again.
SENT = 500_000


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over digests in order; an odd one moves up unchanged."""
    level = list(leaves) or [digest(b"")]
    while len(level) > 1:
        level = [digest(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cut_points(documents: list[np.ndarray]) -> list[list[int]]:
    """Ends of the chunks of each id stream. Where to cut depends on the SPAN ids before it alone, but for the
    bounds. All streams are hashed in one array, with SPAN zeros before each, which add nothing to a hash."""
    begins = np.cumsum([SPAN, *(len(ids) + SPAN for ids in documents)])
    x = np.zeros(begins[-1], np.uint32)
    for at, ids in zip(begins.tolist(), documents):
        x[at : at + len(ids)] = ids
    h = np.zeros(len(x), np.uint32)
    for back in range(SPAN):
        h[back:] += x[: len(x) - back] * np.uint32(pow(0x9E3779B1, back + 1, 1 << 32))
    marks = np.flatnonzero((h >> np.uint32(13)) & np.uint32(MASK) == 0) + 1
    firsts = np.searchsorted(marks, begins + 1).tolist()
    out = []
    for ids, begin, i, j in zip(documents, begins.tolist(), firsts, firsts[1:]):
        out.append(_bounded(len(ids), (marks[i:j] - begin).tolist()))
    return out


def _bounded(length: int, marks: list[int]) -> list[int]:
    """The marks that become ends, so that all chunks but the last have LEAST to MOST ids."""
    ends, begin, at = [], 0, 0
    while length - begin > LEAST:
        while at < len(marks) and marks[at] < begin + LEAST:
            at += 1
        begin = min(marks[at] if at < len(marks) else length, begin + MOST, length)
        ends.append(begin)
    if begin < length:
        ends.append(length)
    return ends


_ROW = pa.schema([("kind", pa.string()), ("name", pa.binary()), ("data", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("chunks", pa.list_(pa.binary())), ("root", pa.binary())])


def chunks_and_recipes(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows of two kinds: chunk (name, data) and recipe (doc_id, row, n_tokens, chunks, root)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sent = encoder(vocabulary), set()
        end = np.asarray([END], dtype=enc.kind)
        for batch in slices(batches):
            names, data, recipes = [], [], []
            streams = [np.append(found, end) for found in enc.encode_many(batch.column("text"))]
            for doc_id, row, ids, stops in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), streams, cut_points(streams)):
                whole, mine, at, width = ids.tobytes(), [], 0, ids.itemsize
                for stop in stops:
                    part = whole[at * width : stop * width]
                    mine.append(digest(part))
                    at = stop
                    if mine[-1] not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(mine[-1])
                        names.append(mine[-1])
                        data.append(part)
                recipes.append((b"r" + int(row).to_bytes(8, "big"), doc_id, row, len(ids), mine, merkle_root(mine)))
            n, m = len(names), len(recipes)
            columns = [["chunk"] * n + ["recipe"] * m, names + [r[0] for r in recipes], data + [None] * m, *([None] * n + [r[i] for r in recipes] for i in range(1, 6))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROW)], schema=_ROW)

    own = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string"))
    return own.mapInArrow(cut, "kind string, name binary, data binary, doc_id long, row long, n_tokens long, chunks array<binary>, root binary")


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Write parts/kind=chunk, recipes and manifest under path."""
    spark = docs.sparkSession
    rows = chunks_and_recipes(docs, vocabulary or default_vocabulary())
    # the first row of each name; a running count needs no sort before the shuffle, unlike first() or a rank
    seen = F.count("*").over(Window.partitionBy("kind", "name").orderBy("kind").rowsBetween(Window.unboundedPreceding, 0))
    once = rows.withColumn("seen", seen).where("seen = 1").drop("seen")
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/parts")

    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    recipes = _part(spark, path, "recipe", "doc_id long, row long, n_tokens long, chunks array<binary>, root binary")
    files = max(1, -(-recipes.count() // FILE_ROWS))
    ordered = recipes.repartitionByRange(files, *order).sortWithinPartitions(*order)
    ordered.withColumn("file", F.spark_partition_id()).write.option("compression", "zstd").parquet(f"{path}/sorted")
    ranged = spark.read.parquet(f"{path}/sorted")
    sums = ranged.groupBy("file").agg(F.sum("n_tokens").alias("n"))  # one row per file
    before = sums.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    within = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumns({"upto": F.sum("n_tokens").over(within), "leaf": F.count("*").over(within) - 1}).join(F.broadcast(before), "file")
    placed = placed.withColumn("start", F.col("before") + F.col("upto") - F.col("n_tokens"))
    placed.drop("before", "upto").write.option("compression", "zstd").parquet(f"{path}/recipes")
    file_roots(spark, path).write.parquet(f"{path}/manifest")


def file_roots(spark: SparkSession, path: str) -> DataFrame:
    """file, n_docs, n_ids and the Merkle root over its documents' roots, of every recipe file as it is now."""
    block = F.floor(F.col("leaf") / BLOCK_ROWS).cast("long").alias("block")
    leaves = read_recipes(spark, path).select("file", block, "leaf", F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").alias("n_ids"), "root")
    blocks = leaves.groupBy("file", "block").applyInArrow(_root_over("leaf"), "file int, block long, n_docs long, n_ids long, root binary")
    return blocks.groupBy("file").applyInArrow(_root_over("block"), "file int, block long, n_docs long, n_ids long, root binary").drop("block")


def _root_over(order: str):
    def root(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        sums = [[pc.sum(group[c]).as_py()] for c in ("n_docs", "n_ids")]
        return pa.table([group["file"].slice(0, 1), group["block"].slice(0, 1), *sums, [merkle_root(group["root"].to_pylist())]], names=["file", "block", "n_docs", "n_ids", "root"])

    return root


def _part(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    return spark.read.schema(schema + ", kind string").parquet(f"{path}/parts").where(F.col("kind") == kind).drop("kind")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file int, doc_id long, row long, n_tokens long, chunks array<binary>, root binary, leaf long, start long").parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return _part(spark, path, "chunk", "name binary, data binary")


class Crc32:
    """crc32 of a whole from the crc32 of its parts. Appending zero bytes is linear: for each power of two of
    them there is a table of 4 x 256 entries, and a part takes those of the bits of the length after it."""

    def __init__(self):
        unit = np.array([zlib.crc32(b"\0", 1 << b) ^ zlib.crc32(b"\0", 0) for b in range(32)], np.uint32)
        self.powers = [self._table(unit)]

    @staticmethod
    def _table(unit: np.ndarray) -> np.ndarray:
        """unit: what becomes of each single bit."""
        value, table = np.arange(256), np.zeros((4, 256), np.uint32)
        for b in range(32):
            table[b // 8] ^= np.where(value >> b % 8 & 1, unit[b], 0).astype(np.uint32)
        return table

    @staticmethod
    def _apply(table: np.ndarray, crcs: np.ndarray) -> np.ndarray:
        return table[0][crcs & 255] ^ table[1][crcs >> 8 & 255] ^ table[2][crcs >> 16 & 255] ^ table[3][crcs >> 24]

    def shifted(self, crcs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What each crc32 becomes when so many bytes follow it."""
        out, bit = crcs.astype(np.uint32), 0
        while (sizes >> bit).any():
            if bit == len(self.powers):
                last = self.powers[-1]
                self.powers.append(self._table(self._apply(last, self._apply(last, np.uint32(1) << np.arange(32, dtype=np.uint32)))))
            on = (sizes >> bit & 1) == 1
            out[on] = self._apply(self.powers[bit], out[on])
            bit += 1
        return out

    def joined_many(self, crcs: np.ndarray, sizes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The crc32 of each whole; crc32 and bytes of all parts in order, and where each whole's parts begin."""
        ends = sizes.cumsum()
        counts = np.diff(np.append(begins, len(sizes)))
        after = np.repeat(ends[begins + counts - 1], counts) - ends
        return np.bitwise_xor.reduceat(self.shifted(crcs, after), begins)

    def joined(self, parts: list[tuple[int, int]]) -> int:
        """parts: (crc32, bytes) in order."""
        return int(self.joined_many(np.array([c for c, _ in parts], np.uint32), np.array([n for _, n in parts], np.int64), np.array([0]))[0])


def verified_chunks(spark: SparkSession, path: str, vocabulary: str) -> DataFrame:
    """name, crc (crc32 of the ids as 32-bit integers) and n (ids) of each stored chunk, read and checked."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(encoder(vocabulary).kind)
        for batch in batches:
            names, data = batch.column("name").to_pylist(), batch.column("data").to_pylist()
            for name, part in zip(names, data):
                if digest(part) != name:
                    raise ValueError(f"chunk {name.hex()} does not hold what its name says")
            wide = memoryview(np.frombuffer(b"".join(data), dtype=kind).astype("<u4").tobytes())
            sizes = np.fromiter(map(len, data), np.int64, len(data)) // kind.itemsize
            ends = (4 * sizes.cumsum()).tolist()
            crcs = [zlib.crc32(wide[a:b]) for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int32())], names=["name", "crc", "n"])

    return read_chunks(spark, path).mapInArrow(check, "name binary, crc long, n int")


def read_digests(spark: SparkSession, path: str, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files, with every check made.

    The bytes are read and hashed where they lie; only names, sizes and crc32s of chunks are shuffled.
    """
    recipes = read_recipes(spark, path)
    refs = recipes.select("row", F.posexplode("chunks").alias("seq", "name"))
    met = refs.join(verified_chunks(spark, path, vocabulary or default_vocabulary()), "name", "left")
    parts = met.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("seq", "crc", "n"))).alias("p"))
    parts = parts.select("row", F.transform("p", lambda x: x["crc"]).alias("crcs"), F.transform("p", lambda x: x["n"]).alias("sizes"))
    whole = recipes.select("doc_id", "row", "start", "n_tokens", "chunks", "root").join(parts, "row")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc32 = Crc32()
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, found, held = (batch.column(c) for c in ("chunks", "crcs", "sizes"))
            counts = np.asarray(pc.list_value_length(lists))
            crcs, sizes = found.flatten(), held.flatten()
            begins = np.append(0, counts.cumsum())[:-1]
            whole = not crcs.null_count and (np.asarray(pc.list_value_length(found)) == counts).all() and counts.all()
            whole = whole and (np.add.reduceat(np.asarray(sizes).astype(np.int64), begins) == np.asarray(batch.column("n_tokens"))).all()
            broken = [d for d, names, root in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "chunks", "root"))) if merkle_root(names) != root]
            if not whole or broken:
                raise ValueError(f"documents can't be rebuilt from the store: {broken[:5] or 'chunks are missing'}")
            out = crc32.joined_many(np.asarray(crcs), 4 * np.asarray(sizes).astype(np.int64), begins)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(out.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return whole.mapInArrow(fold, "doc_id long, start long, n_tokens long, ids_crc32 long")


def verify_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files whose recipes no longer give the manifest's root: empty if all is well."""
    now = file_roots(spark, path)
    then = spark.read.schema("file int, n_docs long, n_ids long, root binary").parquet(f"{path}/manifest").withColumnRenamed("root", "written")
    return now.select("file", "root").join(then.select("file", "written"), "file", "full").where(~F.col("root").eqNullSafe(F.col("written")))


def read_ids(spark: SparkSession, path: str, vocabulary: str | None = None) -> DataFrame:
    """doc_id, row and ids (array of int) of every document, rebuilt from its chunks."""
    kind = encoder(vocabulary or default_vocabulary()).kind
    refs = read_recipes(spark, path).select("doc_id", "row", F.posexplode("chunks").alias("seq", "name"))
    parts = refs.join(read_chunks(spark, path), "name").groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("parts"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["data"] for p in parts), dtype=kind).astype(np.int32) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "row", "ids"])

    return parts.mapInArrow(build, "doc_id long, row long, ids array<int>")


def stored_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write docs to a new store in the shared folder and return read_digests() of it."""
    spark = docs.sparkSession
    path = scratch(spark, "token-store")
    write_store(docs, path, vocabulary)
    broken = verify_manifest(spark, path).count()
    if broken:
        raise ValueError(f"{broken} recipe files differ from the manifest")
    return read_digests(spark, path, vocabulary)
