"""Closed time intervals: delete intervals, overlaps, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.merge import islands


def in_bounds(t: Column, min_t: Column, max_t: Column) -> Column:
    return t.between(min_t, max_t)


def same_intervals(a: Column, b: Column) -> Column:
    """Whether two arrays of ``min_t, max_t`` hold the same intervals in the same order; two NULLs do, one does not."""
    return a.eqNullSafe(b)


def is_subrange(intervals: Column, min_t: Column | int, max_t: Column | int) -> Column:
    """Whether some interval of the array (of ``min_t, max_t``) holds both ends."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (min_t, max_t))
    return F.exists(intervals, lambda i: a.between(i["min_t"], i["max_t"]) & b.between(i["min_t"], i["max_t"]))


def coalesce_intervals(intervals: DataFrame) -> DataFrame:
    """``(series_id, min_t, max_t)`` with overlapping and adjacent intervals of a series joined."""
    return islands(intervals, ["series_id"], "min_t", "max_t", adjacent=1).groupBy("series_id", "island").agg(F.min("min_t").alias("min_t"), F.max("max_t").alias("max_t")).drop("island")


def delete(samples: DataFrame, tombs: DataFrame) -> DataFrame:
    """Samples outside all delete intervals ``(series_id, min_t, max_t)`` of their series.

    After coalescing, the intervals of a series are disjoint, so the only one that can hold a time is the last
    that begins at or before it. The intervals of a series travel as one sorted array, joined by series, and
    the sample is tested in place: an equality join of any size, no range join, no row is multiplied. Nothing
    below rests on its partitioning, so a hot series can be split by the adaptive plan.
    """
    arrays = coalesce_intervals(tombs).groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("min_t", "max_t"))).alias("_dead"))
    joined = samples.join(arrays, "series_id", "left")
    dead = F.exists("_dead", lambda i: F.col("t").between(i["min_t"], i["max_t"]))
    return joined.where(~F.coalesce(dead, F.lit(False))).drop("_dead")


def overlapping_blocks(blocks: DataFrame) -> DataFrame:
    """``blocks`` (``block, min_t, max_t``, half open) that overlap another, with ``first_block`` of their overlap group.

    A block belongs to the group before it if it begins before the latest end so far.
    """
    marked = islands(blocks, [], "min_t", "max_t", adjacent=-1)
    group = Window.partitionBy("island")
    return marked.withColumn("_size", F.count(F.lit(1)).over(group)).withColumn("first_block", F.min("block").over(group)).where("_size > 1").select("first_block", "block", "min_t", "max_t")


def overlapping_partitions(partitions: DataFrame, mint: int, maxt: int) -> DataFrame:
    """Partitions ``(time_boundary, time_interval)``, half open, that meet the closed range."""
    return partitions.where((F.col("time_boundary") <= maxt) & (F.col("time_boundary") + F.col("time_interval") > mint))


def purge_partitions(partitions: DataFrame, ts: int) -> DataFrame:
    """The partitions that retention keeps: those that end after ``ts``."""
    return partitions.where(F.col("time_boundary") + F.col("time_interval") > ts)


def purge_series(bounds: DataFrame, ts: int) -> DataFrame:
    """The series that retention keeps: those whose last time ``max_t`` is after ``ts``."""
    return bounds.where(F.col("max_t") > ts)
