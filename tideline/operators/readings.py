"""Valid readings of raw inserts, and the limits of their metrics.

A series may hold any share of all rows, so no operator partitions raw rows by series alone: versions are merged by
``(series_id, t)``, reduced in the map tasks, and what needs readings in order takes them from
:mod:`tideline.operators.blocks`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def day(t: str = "t") -> Column:
    """Days since 1970-01-01 of a time in milliseconds, before it too; a BIGINT, so every time has one."""
    return F.expr(f"({t} - pmod({t}, {DAY_MS}L)) div {DAY_MS}L")


def readings(samples: DataFrame) -> DataFrame:
    """``(series_id, t, v)``: the valid readings of raw inserts, hash-partitioned by series and time.

    Of the rows of one ``(series_id, t)`` the highest ``seq`` counts (equal ``seq``: the greatest value, NULL
    below all, NULL ``seq`` lowest). If that version's ``v`` is NULL or NaN the point has no reading. Rows with a NULL
    ``series_id`` or ``t`` are no readings. Other columns are ignored. One shuffle, of what the map tasks leave of
    the versions, however many rows a series or a single point has.
    """
    rows = samples.where("series_id IS NOT NULL AND t IS NOT NULL")
    last = rows.groupBy("series_id", "t").agg(F.max(F.struct("seq", "v")).alias("last"))
    return last.select("series_id", "t", "last.v").where("v IS NOT NULL AND NOT isnan(v)")


def series_metric(series: DataFrame) -> DataFrame:
    """``(series_id, metric_name)``, one row per registered series; of repeated registrations the least name."""
    return series.groupBy("series_id").agg(F.min(F.expr("labels['__name__']")).alias("metric_name")).where("series_id IS NOT NULL")


def series_limits(series: DataFrame, metric_ref: DataFrame) -> DataFrame:
    """``(series_id, metric_name, min_value, max_value, same_tol)`` of every registered series; NULL where the metric is unknown.

    ``metric_ref`` has one row per metric name; of repeated names one row counts. Its size is checked by the
    optimizer's own broadcast threshold.
    """
    limits = metric_ref.select("metric_name", "min_value", "max_value", "same_tol").where("metric_name IS NOT NULL").dropDuplicates(["metric_name"])
    return series_metric(series).join(limits, "metric_name", "left")
