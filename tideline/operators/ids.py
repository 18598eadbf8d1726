"""Dense ids in a total order, without one task that sees every row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import cut_lineage


def dense_ids(df: DataFrame, order: Sequence[str | Column], name: str, offset: int = 0) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3, ... plus ``offset`` in the given order, which should be total.

    Rows are range-partitioned by the order and numbered within their partition; the row counts of the
    partitions before, one number each, are added. The partitioning is materialised first, so a lost
    executor cannot renumber.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut_lineage(df.repartitionByRange(parts, *columns).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*columns))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, (within + F.col("_before") + offset).cast("bigint")).drop("_part", "_before")
