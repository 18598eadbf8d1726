"""Per-key results through a join, when a few keys hold most rows: eager aggregation on both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import cut_lineage


def eager_totals(left: DataFrame, right: DataFrame, on: str, keys: Sequence[str], value: str, how: str = "left") -> DataFrame:
    """Totals per ``keys`` of ``left`` over its join with ``right``, without ever forming the joined rows.

    Both inputs are reduced by the join key first: ``left`` to the multiplicity of each ``(on, keys)``,
    ``right`` to the compact state (rows, non-NULL values, sum, least, greatest ``value``) of each ``on``. The
    states are joined one row to one row and combined algebraically: counts and sums of the right side
    count once per left row. The roll-up by ``keys`` is reduced in the map tasks, so a key with most rows
    reaches its reducer as one state per task, and no task is longer than the others.

    Returns ``keys``, ``left_rows`` (rows of ``left`` as they stand), ``pair_rows`` (rows of the join),
    ``pair_values`` (those with a value), ``pair_sum`` (NULL without values), ``pair_min`` and
    ``pair_max``. NULL is a key like any other; a NULL ``on`` joins nothing, but its left rows count. With
    ``how`` = ``inner`` only left rows with a partner count. NaN values are no values.
    """
    clean = F.when(~F.isnan(value), F.col(value))
    small_left = left.select(on, *keys).groupBy(on, *keys).agg(F.count(F.lit(1)).alias("m"))
    small_right = right.select(on, clean.alias("x")).where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("r_n"), F.count("x").alias("r_v"), F.sum("x").alias("r_sum"), F.min("x").alias("r_min"), F.max("x").alias("r_max"))
    joined = small_left.join(small_right, on, how)
    return joined.groupBy(*keys).agg(
        F.sum("m").alias("left_rows"),
        F.coalesce(F.sum(F.col("m") * F.col("r_n")), F.lit(0)).alias("pair_rows"),
        F.coalesce(F.sum(F.col("m") * F.col("r_v")), F.lit(0)).alias("pair_values"),
        F.sum(F.col("m") * F.col("r_sum")).alias("pair_sum"),
        F.min("r_min").alias("pair_min"),
        F.max("r_max").alias("pair_max"),
    )


def frequent(totals: DataFrame, share: float, rows: str = "left_rows") -> DataFrame:
    """The keys of :func:`eager_totals` that hold at least ``share`` of all rows counted in ``rows``.

    The totals, a row per key, are worked out once for both the sum and the comparison.
    """
    totals = cut_lineage(totals)
    whole = totals.agg(F.sum(rows).alias("whole")).select("whole")
    return totals.where(F.col(rows) >= whole.scalar() * F.lit(share))
