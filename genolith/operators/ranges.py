"""Intervals: merging, containment joins, windows, nearest boundaries and clusters, without quadratic plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals that a containment join may broadcast.
BROADCAST_ROWS = 200_000
BUCKET = 1 << 16


def merge(intervals: DataFrame, key: str = "chrom", start: str = "start_pos", end: str = "end_pos", gap: int = 1) -> DataFrame:
    """Intervals of a key that touch or overlap, as one (start <= the furthest end before + gap)."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = intervals.withColumn("__new", F.when(F.col(start) <= reach + gap, 0).otherwise(1))
    numbered = opened.withColumn("__no", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "__no").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__no")


def small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The table, to be broadcast if it has no more rows than `most`; else Spark chooses how to join it."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def containing(points: DataFrame, intervals: DataFrame, how: str = "inner", chrom: str = "chrom", pos: str = "pos", start: str = "start_pos", end: str = "end_pos", bucket: int = BUCKET, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """points with each interval [start, end] of their contig that contains them; points' columns win over clashing names.

    Intervals are spread over the buckets that each covers and joined on (contig, bucket), so that a point meets only
    those of its bucket. The join is broadcast while the spread table is small, else dealt out.
    """
    clash = [c for c in intervals.columns if c in points.columns and c != chrom]
    right = intervals.drop(*clash).withColumnRenamed(chrom, "__chrom")
    within = (F.col(pos) >= F.col(start)) & (F.col(pos) <= F.col(end))
    spread = right.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    on = (F.col(chrom) == F.col("__chrom")) & (F.floor(F.col(pos) / bucket) == F.col("__bucket")) & within
    return points.join(small(spread, broadcast_rows), on, how).drop("__chrom", "__bucket")


def ranked(rows: DataFrame, key: list[str], order: tuple[str, ...] = ("chrom", "pos", "ref", "alt"), bucket: int = BUCKET, name: str = "__rank") -> DataFrame:
    """rows with their rank (from 0) by position within a key; order begins with contig and position, or with the position.

    Rows are numbered within buckets of position, each its own group, and shifted by the rows of the buckets before;
    only a row for each bucket is ever sorted together.
    """
    pos = order[1] if order[0] == "chrom" else order[0]
    group = [*key, *(["chrom"] if order[0] == "chrom" else []), "__bucket"]
    dealt = rows.withColumn("__bucket", F.floor(F.col(pos) / bucket))
    before = Window.partitionBy(*key).orderBy(*group[len(key):]).rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy(*group).agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return dealt.withColumn("__own", own).join(shift, group).withColumn(name, F.col("__own") + F.col("__before")).drop("__own", "__before", "__bucket")


def sliding_windows(sites: DataFrame, spans: DataFrame, size: int, step: int, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """sites with every window [win_start, win_end] that covers them.

    spans: chrom, span_start, span_end (one row a contig). Windows begin at the span's start, every step; tiling
    stops with the first window that reaches the span's end. Each site computes its windows, so no range join is needed.
    """
    at = F.col(pos) - F.col("span_start")
    # the last window that is needed is the first to reach the end
    last = F.greatest(F.lit(0), F.ceil((F.col("span_end") - F.col("span_start") + 1 - size) / F.lit(float(step)))).cast("long")
    first = F.greatest(F.lit(0), F.floor((at - size) / F.lit(float(step))) + 1).cast("long")
    until = F.least(F.floor(at / F.lit(float(step))).cast("long"), last)
    joined = sites.join(F.broadcast(spans), chrom)
    out = joined.where(first <= until).withColumn("__w", F.explode(F.sequence(first, until)))
    start = F.col("span_start") + F.col("__w") * step
    return out.withColumn("win_start", start.cast("long")).withColumn("win_end", F.least(start + size - 1, F.col("span_end")).cast("long")).drop("__w", "span_start", "span_end")


def nearest_boundary(points: DataFrame, intervals: DataFrame, chrom: str = "chrom", pos: str = "pos", start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    """points with `distance` to the nearest start or end of an interval of their contig, NULL if it has none.

    Boundaries and points are merged in order of position within buckets; the last boundary before and the first
    after are carried by running windows, and into a bucket from those beside it, of which only a row each is sorted.
    """
    edges = intervals.select(F.col(chrom).alias("__c"), F.explode(F.array(start, end)).alias("__p"))
    both = points.select(F.col(chrom).alias("__c"), F.col(pos).alias("__p")).distinct().withColumn("__edge", F.lit(False)).unionByName(edges.withColumn("__edge", F.lit(True)))
    dealt = both.where("__c is not null and __p is not null").withColumn("__bucket", F.floor(F.col("__p") / BUCKET))
    dealt = dealt.repartition("__c", "__bucket").distinct()
    mark = F.when(F.col("__edge"), F.col("__p"))
    up, down = (Window.partitionBy("__c").orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col("__bucket"), F.desc("__bucket")))
    beside = dealt.groupBy("__c", "__bucket").agg(F.min(mark).alias("__first"), F.max(mark).alias("__last"))
    beside = beside.select("__c", "__bucket", F.max("__last").over(up).alias("__lower"), F.min("__first").over(down).alias("__higher"))
    # a frame that reaches to the end is computed anew for each row, so the first after is the last of the other order
    own = Window.partitionBy("__c", "__bucket")
    before, after = F.max(mark).over(own.orderBy("__p").rangeBetween(Window.unboundedPreceding, 0)), F.min(mark).over(own.orderBy(F.desc("__p")).rangeBetween(Window.unboundedPreceding, 0))
    near = dealt.withColumn("__b", before).withColumn("__a", after).where("not __edge").join(beside, ["__c", "__bucket"])
    near = near.select("__c", "__p", F.coalesce("__b", "__lower").alias("__b"), F.coalesce("__a", "__higher").alias("__a"))
    distance = F.least(F.col("__p") - F.col("__b"), F.col("__a") - F.col("__p"))
    return points.join(near.select("__c", "__p", distance.alias("distance")), (F.col(chrom) == F.col("__c")) & (F.col(pos) == F.col("__p")), "left").drop("__c", "__p")


def clusters(records: DataFrame, flank: int, chrom: str = "chrom", start: str = "pos", end: Column | None = None) -> DataFrame:
    """records with a cluster number by contig: a record within flank of the furthest end before joins its cluster."""
    stop = end if end is not None else F.col(start)
    order = Window.partitionBy(chrom).orderBy(start)
    reach = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = records.withColumn("__new", F.when(F.col(start) <= reach + flank, 0).otherwise(1))
    return opened.withColumn("cluster", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
