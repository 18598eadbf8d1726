"""Totals over trailing periods, days without activity included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.readings import day, readings
from tideline.session import cut_lineage


def daily_totals(samples: DataFrame) -> DataFrame:
    """``(series_id, day_no, n, total)`` per UTC day, from the valid readings; ``day_no`` counts days since 1970-01-01.

    Versions are merged by series and time, the totals by series and day; both are reduced in the map tasks, so
    neither a hot series nor a day with most of its rows is the work of one task.
    """
    return readings(samples).groupBy("series_id", day().alias("day_no")).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


def trailing(daily: DataFrame, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """One row per series and day between its first and last active day, with totals over trailing periods.

    Columns ``series_id, day_no`` and for each period ``p``: ``n_p`` and ``sum_p`` (0 without readings) and
    ``avg_p`` (NULL without readings). A period of ``p`` days ends with the day itself. Each daily total is
    exploded onto the output days it influences, up to the last active day; the calendar of each series then
    supplies the days that nothing influences. Daily rows are partitioned by series once; exploding, summing
    and the calendar join all keep to that partitioning. Infinite totals stay infinite, opposite infinities
    sum to NaN. Rows with a NULL series or day have no place in a calendar and are left out. ``day_no`` is a BIGINT,
    and the calendar of a series is exploded a year at a time, so that one wrong time among its rows costs the days
    it spans but no array of them.
    """
    longest = max(periods)
    # Read three times below: a row per series and active day, worked out once.
    own = cut_lineage(daily.where("series_id IS NOT NULL AND day_no IS NOT NULL").select("series_id", "day_no", "n", "total")).repartition("series_id")
    span = own.groupBy("series_id").agg(F.min("day_no").alias("first_day"), F.max("day_no").alias("last_day"))
    bounded = own.join(span, "series_id")
    reach = bounded.select("series_id", "n", "total", F.col("day_no").alias("from_day"), F.explode(F.expr(f"sequence(day_no, least(day_no + {longest - 1}, last_day))")).alias("day_no"))
    inside = {p: F.col("day_no") - F.col("from_day") < p for p in periods}
    sums = [x for p in periods for x in (F.sum(F.when(inside[p], F.col("n"))).alias(f"n_{p}"), F.sum(F.when(inside[p], F.col("total"))).alias(f"sum_{p}"))]
    totals = reach.groupBy("series_id", "day_no").agg(*sums)
    years = span.select("series_id", "first_day", "last_day", F.explode(F.expr("sequence(first_day div 365, last_day div 365)")).alias("year"))
    within = "sequence(greatest(first_day, year * 365 + if(year > 0, 0, -364)), least(last_day, year * 365 + if(year < 0, 0, 364)))"
    calendar = years.select("series_id", F.explode(F.expr(within)).alias("day_no"))
    columns = ["series_id", "day_no"]
    for p in periods:
        columns += [F.coalesce(f"n_{p}", F.lit(0)).alias(f"n_{p}"), F.coalesce(f"sum_{p}", F.lit(0.0)).alias(f"sum_{p}"), (F.col(f"sum_{p}") / F.col(f"n_{p}")).alias(f"avg_{p}")]
    return calendar.join(totals, ["series_id", "day_no"], "left").select(*columns)
