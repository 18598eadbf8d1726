"""Last write wins, and the other ways in which several versions of samples become one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.labels import label_key


def last_write_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], values: Sequence[str] = ("v",), non_null: bool = False) -> DataFrame:
    """One row per ``keys``: the ``values`` of the row that is greatest by ``order``.

    All values come from one row; of rows with equal ``order`` the one with the greatest ``values``, compared one
    after the other. NULL counts as the least, so a row with a NULL ``order`` wins only where there is no other. With
    ``non_null`` rows whose values are NULL do not overwrite. One shuffle on ``keys``, reduced in the map tasks
    first. Keys may be NULL; an empty input gives an empty result.
    """
    if non_null:
        for v in values:
            df = df.where(F.col(v).isNotNull())
    ranked = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)], *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    return df.groupBy(*keys).agg(F.max(ranked).alias("_last")).select(*keys, *[F.col(f"_last.v{i}").alias(v) for i, v in enumerate(values)])


def merge_sources(sources: Sequence[DataFrame], keys: Sequence[str], value: str = "v") -> DataFrame:
    """Several sources of the same columns as one; on equal keys the later source in the list wins."""
    tagged = [s.select(*keys, value).withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    whole = tagged[0]
    for more in tagged[1:]:
        whole = whole.unionByName(more)
    return last_write_wins(whole, keys, ["_source"], [value])


def merge_by_labels(sources: Sequence[DataFrame]) -> DataFrame:
    """``(label_key, t, v)`` of several selections (``labels, t, v``) whose ids differ: equal label sets are one series.

    On equal times the later selection in the list wins. Rows are hashed by label set and time, so a series with most rows is spread.
    """
    keyed = [s.select(label_key(F.col("labels")).alias("label_key"), "t", "v") for s in sources]
    return merge_sources(keyed, ["label_key", "t"])


def chain(sources: Sequence[DataFrame]) -> DataFrame:
    """The rows of all sources as they stand: neither deduplicated nor put in order."""
    whole = sources[0]
    for more in sources[1:]:
        whole = whole.unionByName(more)
    return whole


def visible(df: DataFrame, keys: Sequence[str], seq: str, deleted: str, at: int | None = None) -> DataFrame:
    """The live version of each key as of sequence number ``at``: later versions, older ones and deletions are hidden."""
    if at is not None:
        df = df.where(F.col(seq) <= at)
    newest = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return df.withColumn("_rank", F.row_number().over(newest)).where((F.col("_rank") == 1) & ~F.col(deleted)).drop("_rank")


def replay(log: DataFrame, flushed: DataFrame) -> DataFrame:
    """The rows of a log (``series_id, seq``, ...) that come after the flush mark of their series (``series_id, seq``, the highest
    of several counts); all rows of a series without a mark. Rows with a NULL ``seq`` cannot be known to be flushed and are kept."""
    marks = flushed.groupBy("series_id").agg(F.max("seq").alias("_mark"))
    return log.join(marks, "series_id", "left").where(F.coalesce(F.col("seq") > F.col("_mark"), F.lit(True))).drop("_mark")


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, adjacent: int = 0) -> DataFrame:
    """``df`` with ``island``: intervals of one key that overlap, or lie at most ``adjacent`` apart, share a number.

    Intervals are put in order per key; partitions are as large as a key has intervals, so this is for metadata
    (chunks, blocks, delete intervals), not for samples.
    """
    order = Window.partitionBy(*keys).orderBy(start, end) if keys else Window.partitionBy(F.lit(0)).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col(start) > reach + adjacent), 1).otherwise(0)
    return df.withColumn("_opens", opens).withColumn("island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def merged_chunks(chunks: DataFrame, samples: DataFrame) -> DataFrame:
    """Overlapping chunks of a series merged: their samples ``(series_id, island, t, v)``.

    ``chunks`` has ``series_id, chunk, min_t, max_t``, ``samples`` has ``series_id, chunk, t, v``; of equal times
    the later chunk wins. Chunks of one ``island`` overlap.
    """
    marked = islands(chunks, ["series_id"], "min_t", "max_t")
    owned = samples.join(marked.select("series_id", "chunk", "island"), ["series_id", "chunk"])
    return last_write_wins(owned, ["series_id", "island", "t"], ["chunk"])


def coalesce_chunks(chunks: DataFrame, samples: DataFrame) -> DataFrame:
    """Bounds and number of samples ``(series_id, min_t, max_t, n)`` of what :func:`merged_chunks` makes of the chunks."""
    points = merged_chunks(chunks, samples)
    return points.groupBy("series_id", "island").agg(F.min("t").alias("min_t"), F.max("t").alias("max_t"), F.count(F.lit(1)).alias("n")).drop("island")
