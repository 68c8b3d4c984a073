"""Sharding by minimax contiguous partition, in DataFrame functions only.

Groups of equal texts are atomic and stand in the order of their text's digest, which every row can compute for
itself. The smallest capacity for which a greedy pass needs no more than the wanted shards is found by binary search
over the ordered group sizes; the cuts are then digests, so that a row finds its shard by comparing its digest with
them, without a join.

The search never gathers the groups: it works on totals by digest prefix (4,096 at first). Greedy passes that treat
a prefix as atomic and as divisible bound the capacity from above and below; only prefixes in which a cut may still
lie are split by two more hex digits, until both bounds meet on single groups. What reaches the driver is bounded by
the number of shards, whatever the number of rows.

Defined cases. Null text: a group of its own kind, of size 1 a row (no bytes). Empty text: a group, size 1. Null or
repeated doc_id: rows are placed like any other; slots of a shard stay gapless. Empty table: no rows. Ties cannot
occur between groups, since digests differ; between equal rows slots are interchangeable. Columns of other names are
not carried; a text of any length is only digested.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settled

FIRST_DIGITS, MORE_DIGITS = 3, 2
#: Cells by which the slots of a shard are numbered, each by its own task.
CELLS = 256


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32 and grp (a digest that equal texts share, nulls sharing another)."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.sha2(F.concat(F.when(F.col(text).isNull(), "0").otherwise("1").cast("binary"), raw), 256).alias("grp"),
    )


class _Parts:
    """Totals of digest prefixes in order; a part of one group can't be split."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        self.parts = sorted(parts)
        self.ends = [0, *accumulate(p[1] for p in self.parts)]
        self.single = [p[2] == 1 for p in self.parts]

    def walk(self, capacity: int, shards: int, divisible: bool) -> list[int]:
        """The cumulative size at which each of the shards ends, filled greedily."""
        at, cuts = 0, []
        for _ in range(shards):
            target = at + capacity
            k = bisect_right(self.ends, target) - 1
            at = self.ends[k]
            if divisible and k < len(self.parts) and not self.single[k]:
                at = target
            cuts.append(at)
        return cuts

    def least(self, shards: int, low: int, high: int, divisible: bool) -> int:
        total = self.ends[-1]
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards, divisible)[-1] >= total:
                high = mid
            else:
                low = mid + 1
        return low


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest feasible capacity over groups (grp, size) in the order of grp, and the digests at which shards 1, 2, ... begin."""

    largest = 0

    def totals(digits: int, within: list[str] | None) -> list[tuple[str, int, int]]:
        nonlocal largest
        chosen = groups if within is None else groups.where(F.substring("grp", 1, digits - MORE_DIGITS).isin(within))
        found = chosen.groupBy(F.substring("grp", 1, digits).alias("p")).agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.max("size").alias("m")).collect()
        largest = max([largest, *(r.m for r in found)])
        return [(r.p, r.s, r.n) for r in found]

    parts = _Parts(totals(FIRST_DIGITS, None))
    if not parts.parts:
        return 0, []
    while True:
        total = parts.ends[-1]
        low = parts.least(shards, max(largest, -(-total // shards)), total, True)
        high = parts.least(shards, low, total, False)
        doubtful: set[int] = set()
        # whatever the capacity in doubt, a cut lies between where the dearest and the cheapest walk put it
        for first, last in zip(parts.walk(low, shards, False), parts.walk(high, shards, True), strict=True):
            k = max(0, bisect_right(parts.ends, first) - 1)
            while k < len(parts.parts) and parts.ends[k] <= last:
                if not parts.single[k]:
                    doubtful.add(k)
                k += 1
        if not doubtful:
            break
        split = [parts.parts[k][0] for k in doubtful]
        finer = [x for length in {len(p) for p in split} for x in totals(length + MORE_DIGITS, [p for p in split if len(p) == length])]
        parts = _Parts([p for k, p in enumerate(parts.parts) if k not in doubtful] + finer)
    cuts = parts.walk(high, shards, False)
    at = dict(zip(parts.ends, [*(p[0] for p in parts.parts), None], strict=True))
    return high, [at[c] for c in cuts[:-1] if at.get(c) is not None]


def shard(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row with its shard and its slot there: doc_id, size, text_crc32, grp, shard, slot."""
    rows = settled(measured(docs, text, doc_id))
    groups = settled(rows.groupBy("grp").agg(F.sum("size").alias("size")))
    _, cuts = minimax_cuts(groups, shards)
    number = sum((F.when(F.col("grp") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    placed = rows.withColumn("shard", number).withColumn("cell", F.pmod(F.xxhash64("doc_id", "grp"), F.lit(CELLS)).cast("int"))
    # cells are numbered on their own and shifted by the rows of the cells before: shards * CELLS rows at most
    before = placed.groupBy("shard", "cell").count().withColumn(
        "shift", F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    own = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "grp"))
    return (
        placed.withColumn("own", own)
        .join(F.broadcast(before.select("shard", "cell", "shift")), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "grp", "shard", (F.col("own") - 1 + F.col("shift")).cast("long").alias("slot"))
    )


def op3_minimax_shards(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
