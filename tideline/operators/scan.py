"""Range scans: matchers resolved on the series, times pruned on the samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.labels import label_key
from tideline.functions.timeutil import partition_floor
from tideline.operators.matchers import Matcher, conjunction
from tideline.operators.merge import last_write_wins

MAX_T = 2**63 - 1


def in_range(samples: DataFrame, mint: int, maxt: int, width: int | None = None) -> DataFrame:
    """Samples with ``mint <= t <= maxt``; a negative ``mint`` counts as 0.

    Where ``samples`` has the partition column ``p_start`` of the given ``width``, the range it implies is added, as
    the optimizer cannot derive it from the range of ``t``.
    """
    mint = max(mint, 0)
    kept = samples.where((F.col("t") >= mint) & (F.col("t") <= maxt))
    if width and "p_start" in samples.columns:
        floor = lambda x: x - (x % width if x >= 0 else -(-x % width))
        kept = kept.where((F.col("p_start") >= floor(mint)) & (F.col("p_start") <= floor(maxt)))
    return kept


def resolve(series: DataFrame, matchers: Sequence[Matcher]) -> DataFrame:
    """The series for which all matchers hold; no match gives an empty frame, no matcher is an error."""
    return series.where(conjunction(matchers, F.col("labels")))


def select(series: DataFrame, samples: DataFrame, matchers: Sequence[Matcher], mint: int = 0, maxt: int = MAX_T, width: int | None = None, at: int | None = None) -> DataFrame:
    """Valid samples ``(series_id, labels, t, v)`` of the selected series in the inclusive range.

    With ``at`` only rows of sequence numbers up to it are seen (a snapshot). ``series`` are registrations as they stand; labels
    are filtered first, and of the repeated registrations that are left one counts. The join
    reduces the samples before versions are merged, and labels are attached afterwards, so that the shuffle
    carries three numbers per row. The selected series are broadcast only where the planner's size
    statistics allow it. Versions are grouped by the point as one key: that never rests on a partitioning
    by series alone, so where both sides are shuffled a hot series can be split by the adaptive plan.
    """
    chosen = resolve(series, matchers).where(F.col("series_id").isNotNull()).groupBy("series_id").agg(F.any_value("labels", True).alias("labels"))
    rows = in_range(samples, mint, maxt, width)
    if at is not None:
        rows = rows.where(F.col("seq") <= at)
    own = rows.join(chosen.select("series_id"), "series_id", "left_semi")
    last = last_write_wins(own.withColumn("point", F.struct("series_id", "t")), ["point"], ["seq"])
    return last.select("point.series_id", "point.t", "v").join(chosen, "series_id").select("series_id", "labels", "t", "v")


def ordered(selected: DataFrame) -> DataFrame:
    """A selection in the order of label sets and time, as results are listed."""
    return selected.orderBy(label_key(F.col("labels")), "series_id", "t")


def select_all(series: DataFrame, samples: DataFrame, mint: int = 0, maxt: int = MAX_T) -> DataFrame:
    """As :func:`select`, for every series."""
    return select(series, samples, [lambda labels: F.lit(True)], mint, maxt)


def seek(samples: DataFrame, t: int) -> DataFrame:
    """``(series_id, t, v)``: the first sample of each series at or after ``t``."""
    later = samples.where(F.col("t") >= t)
    return later.groupBy("series_id").agg(F.min(F.struct("t", "v")).alias("s")).select("series_id", "s.t", "s.v")


def point_get(samples: DataFrame, series_id: int, t: int, at: int | None = None) -> DataFrame:
    """The newest visible value of one ``(series_id, t)``: one row or none."""
    rows = samples.where((F.col("series_id") == series_id) & (F.col("t") == t))
    rows = rows if at is None else rows.where(F.col("seq") <= at)
    return last_write_wins(rows, ["series_id", "t"], ["seq"])


def key_range(samples: DataFrame, low: tuple[int, int], high: tuple[int, int], reverse: bool = False) -> DataFrame:
    """Rows with ``low <= (series_id, t) < high`` in order of key, or in reverse order."""
    key = F.struct("series_id", "t")
    bound = lambda k: F.struct(F.lit(k[0]).cast("bigint").alias("series_id"), F.lit(k[1]).cast("bigint").alias("t"))
    # The leading column alone reaches the scan as a pushed filter.
    rows = samples.where(F.col("series_id").between(low[0], high[0])).where((key >= bound(low)) & (key < bound(high)))
    return rows.orderBy(*[F.col(c).desc() if reverse else F.col(c) for c in ("series_id", "t", "seq")])


def with_partition(samples: DataFrame, width: int) -> DataFrame:
    return samples.withColumn("p_start", partition_floor("t", width))


def empty(df: DataFrame) -> DataFrame:
    """A frame of the same columns without rows."""
    return df.where(F.lit(False))
