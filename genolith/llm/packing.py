"""Best-fit packing of token pieces by exact-complement hashing.

The plan needs only how many pieces there are of each length, at most one number for each length up to the capacity,
so it is made on the driver whatever the number of documents. From the longest length on, the gap that a piece leaves
is looked up among available single lengths, sums of two and sums of three; a combination that fills it exactly is
consumed as often as availability counts allow. What remains is packed best-fit decreasing, again many equal bins at
a time. The plan is a list of patterns (lengths that stand together) and how often each is used.

Pieces find their place without being gathered: within its length a piece has a rank (numbered in cells, so that one
frequent length isn't one task), and a pattern owns an interval of ranks.

Defined cases. Null or empty text: the end id alone, one piece. Null or repeated doc_id: every row is packed on its
own. A text of any length is cut into pieces of the capacity, the last one shorter. Ties between equal lengths are
broken by doc_id, piece and ids_crc32. Empty table: no rows. Only doc_id and text are read by `pieces`; `pack` keeps
all columns of its pieces, also those named like its own.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import settled
from .tokens import Encoder, default_path

CAPACITY, END = 2048, 0
#: Pieces of a length that are numbered in one cell; a more frequent length has several, each a task's own group.
PER_CELL = 2_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used, over all pieces of lengths (length: count)."""
    left = Counter({n: c for n, c in lengths.items() if c > 0})
    patterns: list[tuple[tuple[int, ...], int]] = []
    index = {"stale": True, "pairs": 0}

    def consume(*combination: int) -> None:
        need = Counter(combination)
        times = min(left[n] // k for n, k in need.items())
        if times:
            patterns.append((combination, times))
            for n, k in need.items():
                left[n] -= times * k
                if not left[n]:
                    del left[n]
                    index["stale"] = True

    def pair_sums() -> int:
        """The sums of two available lengths, as bits."""
        if index["stale"]:
            available = sum(1 << n for n in left)
            sums = 0
            for n in left:
                sums |= available << n
            index.update(stale=False, pairs=sums)
        return index["pairs"]

    for n in sorted(left, reverse=True):
        gap = capacity - n
        if n in left and gap == 0:
            consume(n)
        if n in left and gap in left:
            consume(n, gap)
        if n in left and pair_sums() >> gap & 1:
            for x in sorted(x for x in left if 2 * x >= gap > x):
                if n not in left:
                    break
                if gap - x in left and x in left:
                    consume(n, x, gap - x)
        if n in left:
            for x in sorted((x for x in left if 3 * x >= gap > x), reverse=True):
                if n not in left:
                    break
                if x not in left or not pair_sums() >> (gap - x) & 1:
                    continue
                for y in sorted(y for y in left if 2 * y >= gap - x > y):
                    if n not in left or x not in left:
                        break
                    if y in left and gap - x - y in left:
                        consume(n, x, y, gap - x - y)
    # best fit: bins of one pattern stand for each other; gaps are kept in order
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in bins:
            bins[gap] = []
            insort(gaps, gap)
        bins[gap].append((pattern, times))

    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            k = bisect_left(gaps, n)
            if k == len(gaps):
                fit = capacity // n
                if count >= fit:
                    put((n,) * fit, count // fit)
                if count % fit:
                    put((n,) * (count % fit), 1)
                break
            gap = gaps[k]
            pattern, times = bins[gap].pop()
            if not bins[gap]:
                del bins[gap], gaps[k]
            fit = min(gap // n, count)  # as many as go into this bin before a better one exists
            used = min(times, count // fit)
            if times > used:
                put(pattern, times - used)
            put(pattern + (n,) * fit, used)
            count -= fit * used
    return patterns + [x for own in bins.values() for x in own]


class Places:
    """Where each (length, rank) stands: sorted arrays of rank intervals."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        taken: Counter = Counter()
        rows, sequence = [], 0
        for pattern, times in patterns:
            offset = 0
            for n in pattern:
                rows.append((n, taken[n], sequence, offset))
                taken[n] += times
                offset += n
            sequence += times
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.key, self.first, self.sequence, self.offset = (table[:, 0] << 44) + table[:, 1], table[:, 1], table[:, 2], table[:, 3]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, (length << 44) + rank, "right") - 1
        return self.sequence[k] + rank - self.first[k], self.offset[k]


def _cutter(path: str, capacity: int, end: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(path)
        for batch in batches:
            row = 0
            for counts, ids in encode.with_end(batch.column(1), end):
                cuts = -(-counts // capacity)
                piece = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(np.repeat(counts, cuts) - start, capacity)
                raw, ends = ids.astype("<u4", copy=False).tobytes(), (4 * np.cumsum(length)).tolist()
                own = [raw[a:z] for a, z in zip([0, *ends], ends, strict=False)]
                doc_id = batch.column(0).take(pa.array(row + np.repeat(np.arange(len(counts)), cuts)))
                row += len(counts)
                columns = [doc_id, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(own if with_ids else [None] * len(own), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return cut


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: doc_id, piece, start, length, ids_crc32, and ids (little-endian uint32) if asked for."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_cutter(path or default_path(), capacity, end, with_ids), PIECES)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. cut: rows with doc_id, piece, length, ids_crc32 and any other columns.

    A caller's own sequence_id and offset are replaced; all other columns stay, whatever their names.
    """
    cut = settled(cut.drop("sequence_id", "offset"))
    lengths = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row a length
    held = cut.sparkSession.sparkContext.broadcast(Places(plan(lengths, capacity)))
    # a frequent length has more cells, so that none holds more than PER_CELL rows but by chance
    wide = {n: -(-c // PER_CELL) for n, c in lengths.items() if c > PER_CELL}
    many = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in wide.items() for x in p)), F.col("length")), F.lit(1)) if wide else F.lit(1)
    rows = cut.select(F.struct(*(F.col(f"`{c}`") for c in cut.columns)).alias("row"), "length", F.xxhash64("doc_id", "piece", "ids_crc32").alias("tie"), many.cast("long").alias("cells"))
    celled = rows.withColumn("cell", F.pmod("tie", "cells"))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each length and another for each PER_CELL rows: small, and joined by key, so never broadcast blindly
    shifts = celled.groupBy("length", "cell").agg(F.count("*").alias("n")).withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("length", "cell").orderBy("row.doc_id", "row.piece", "row.ids_crc32"))
    ranked = celled.withColumn("own", own).join(shifts, ["length", "cell"]).withColumn("rank", F.col("own") - 1 + F.col("shift"))

    names = [*cut.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, length, rank = batch.columns
            sequence, offset = held.value.find(length.to_numpy(), rank.to_numpy())
            yield pa.RecordBatch.from_arrays([*row.flatten(), pa.array(sequence), pa.array(offset)], names)

    chosen = ranked.select("row", F.col("length").cast("long"), F.col("rank").cast("long"))
    return chosen.mapInArrow(place, StructType([*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids (array of long), of pieces packed with their ids."""
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def op10_pack(spark, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids"))
