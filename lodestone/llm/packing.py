"""Best-fit packing with certified bounds.

Pieces shorter than a sequence are dealt by a hash into groups of a bounded number of rows, and every
group is packed by best-fit decreasing. Dual-feasible functions of the lengths bound each group's number
of bins from below. A group that meets its bound is certified; it hands over no more than its emptiest bin, if that
is half empty. The other groups hand over the rows of their emptiest bins, up to a quarter of a group. Four
groups exchange what was handed over and run best-fit decreasing again, and the result stands where it has
fewer bins than before. So it goes on, four by four, until all have met in one group; no round has larger
groups than the first, and each has a quarter of the groups of the one before. certificate() bounds the whole
table from the counts of its lengths.

Defined results: a null or empty text is the end id alone; rows are told apart by a row number, so null
and repeated doc_ids and repeated rows are packed each; other columns are ignored; empty tables give no
rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import stage
from lodestone.llm.tokens import default_vocabulary, encoder, slices

CAPACITY, END = 2048, 0
#: Rows of a group on average, in every round.
GROUP_ROWS = 50_000

PIECE_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document's ids and end id; of a longer document all but the first have capacity ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in slices(batches):
            rows: list[list] = [[], [], [], [], [], []]
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), enc.encode_many(batch.column("text"))):
                ids = np.append(found, found.dtype.type(END)).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = end - capacity if piece else 0
                    data = ids[start:end].tobytes()
                    for column, value in zip(rows, (doc_id, piece, start, end - start, zlib.crc32(data), data if with_ids else None)):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows[:n], kinds)], names=names[:n])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return own.mapInArrow(cut, PIECE + ", ids binary" * with_ids)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins. Free space has one bit per size: the bins with
    the least space that is enough are found by one shift."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = n = 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[at])
        fits = mask >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                mask ^= 1 << space
        else:
            space, b, n = capacity, n, n + 1
        bins[at], offsets[at] = b, capacity - space
        left = space - size
        if left:
            by_space[left].append(b)
            mask |= 1 << left
    return bins, offsets, n


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins of any packing: the best of two families of dual-feasible functions."""
    return least_bins_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def least_bins_of_counts(count: np.ndarray, capacity: int) -> int:
    """The same, from how often each length from 0 to capacity occurs."""
    if not count.any():
        return 0
    size = np.arange(capacity + 1)
    best = 0
    tokens, number = np.append(0, (count * size).cumsum()), np.append(0, count.cumsum())
    low = np.arange(0, capacity // 2 + 1)  # below low: 0; above capacity - low: a whole bin; between: its share
    whole = number[-1] - number[capacity - low + 1]
    between = tokens[capacity - low + 1] - tokens[low]
    best = max(best, int((whole + -(-between // capacity)).max()))
    for k in range(1, 33):  # sizes rounded to multiples of 1/k, but for those that k + 1 divides evenly
        exact = size * (k + 1) % capacity == 0
        scaled = np.where(exact, size * k, size * (k + 1) // capacity * capacity)  # times 1 / (k * capacity)
        best = max(best, -(-int((count * scaled).sum()) // (k * capacity)))
    return best


def _packer(capacity: int, most: int):
    """most: rows that a group hands over."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        """One group: rows already in bins (bin >= 0) keep them unless fewer bins are found."""
        pdf = pdf.sort_values("row", ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        bound = least_bins(lengths, capacity)
        before = pdf["bin"].to_numpy()
        had = len(np.unique(before)) if before[0] >= 0 else n + 1
        if n < had:
            pdf["offset"] = offsets
            # the smallest row in it names a bin, everywhere and in every round
            pdf["bin"] = pdf["row"].groupby(bins).transform("min")
        else:
            n = had
        pdf["gap"] = n - bound
        bins_now = pdf.groupby("bin")["length"].agg(["sum", "size"]).sort_values("sum", kind="stable")
        if n > bound:
            given = bins_now.index[(bins_now["size"].cumsum() <= most) & (bins_now["sum"] < capacity)]
        else:
            given = bins_now.index[:1][2 * bins_now["sum"].to_numpy()[:1] <= capacity]
        pdf["open"] = pdf["bin"].isin(given)
        return pdf

    return pack


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece; gap is the number
    of bins above the certified bound in the group that packed it last (0: proven least)."""
    cut = cut_pieces(docs, vocabulary or default_vocabulary(), capacity, with_ids).withColumn("row", F.monotonically_increasing_id())
    pieces = stage(cut, "packing-pieces")
    whole = pieces.where(F.col("length") == capacity).select(*pieces.columns, F.col("row").alias("bin"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("gap"))
    part = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-part.count() // GROUP_ROWS))
    todo = part.select(*pieces.columns, F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"), F.lit(0).cast("long").alias("gap"), F.lit(True).alias("open"), F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group"))
    done = whole
    while groups:
        packed = stage(todo.groupBy("group").applyInPandas(_packer(capacity, GROUP_ROWS // 4), todo.schema), "packing-round")
        final = packed if groups == 1 else packed.where(~F.col("open"))
        done = done.unionByName(final.drop("open", "group"))
        todo = packed.where("open").withColumn("group", F.floor(F.col("group") / 4))
        groups = -(-groups // 4) if groups > 1 else 0
    return done.withColumnRenamed("bin", "sequence_id").select(*PIECE_COLUMNS, "sequence_id", "offset", "gap", *["ids"] * with_ids)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """How many sequences packed has, and how many any packing of its pieces must have."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():  # at most capacity rows
        counts[r["length"]] = r["count"]
    return packed.select("sequence_id").distinct().count(), least_bins_of_counts(counts, capacity)
