"""Bucketed aggregates and last points of selected series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.timeutil import partition_floor


def label(name: str) -> Column:
    return F.try_element_at("labels", F.lit(name))


def bucketed(selected: DataFrame, width: int, by: Sequence[str] = (), how: str = "max") -> DataFrame:
    """``by labels, bucket, <how>_v, n`` of selected samples, per bucket of ``width`` milliseconds.

    ``by`` are label names; ``how`` is max, min, avg, sum or count. NULL and NaN samples do not count.
    """
    rows = selected.where("v IS NOT NULL AND NOT isnan(v)")
    keys = [label(n).alias(n) for n in by]
    fold = {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum, "count": F.count}[how]
    return rows.groupBy(*keys, partition_floor("t", width).alias("bucket")).agg(fold("v").alias(f"{how}_v"), F.count(F.lit(1)).alias("n"))


def last_points(selected: DataFrame, by: Sequence[str] = ("series_id",)) -> DataFrame:
    """``by, t, v`` of the latest sample; of equal times the greatest value."""
    return selected.groupBy(*by).agg(F.max(F.struct("t", "v")).alias("s")).select(*by, "s.t", "s.v")


def histogram(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, n, min_v, max_v, avg_v, stddev_v, p50, p90, p99`` of a latency-like column, percentiles by nearest rank.

    Percentiles come from a mergeable sketch of bounded size with a relative rank error of 1e-5; exact for
    fewer than 1e5 distinct values.
    """
    q = lambda p: F.percentile_approx(value, p, 100_000)
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min_v"), F.max(value).alias("max_v"), F.avg(value).alias("avg_v"), F.stddev_pop(value).alias("stddev_v"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"))
