"""Label names and values, postings and their set operations, statistics of what is stored."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.labels import label_key
from tideline.operators.ids import dense_ids
from tideline.operators.intervals import coalesce_intervals


def postings(series: DataFrame) -> DataFrame:
    """``(name, value, series_id)`` of every label of every series, each once."""
    return series.select("series_id", F.explode("labels").alias("name", "value")).select("name", "value", "series_id").distinct()


def lookup(index: DataFrame, name: str, value: str) -> DataFrame:
    """The ids under one ``(name, value)``."""
    return index.where((F.col("name") == name) & (F.col("value") == value)).select("series_id").distinct()


def all_ids(series: DataFrame) -> DataFrame:
    return series.select("series_id").distinct()


def intersect(lists: Sequence[DataFrame]) -> DataFrame:
    """Ids in all of the lists: a chain of semi-joins on the id."""
    return reduce(lambda a, b: a.join(b, "series_id", "left_semi"), lists[1:], lists[0].distinct())


def union(lists: Sequence[DataFrame]) -> DataFrame:
    """Ids in any of the lists, each once."""
    return reduce(lambda a, b: a.unionByName(b), lists).distinct()


def subtract(full: DataFrame, dropped: DataFrame) -> DataFrame:
    """Ids of ``full`` that are not in ``dropped``."""
    return full.distinct().join(dropped, "series_id", "left_anti")


def expand(ids: DataFrame, most: int = 100_000) -> list[int]:
    """The ids of a list as Python values, in order; more than ``most`` of them are an error, they stay a frame."""
    own = [r.series_id for r in ids.select("series_id").limit(most + 1).collect()]
    if len(own) > most:
        raise ValueError(f"more than {most} ids")
    return sorted(own)


def delete_ids(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without the given ids."""
    return index.join(ids.select("series_id").distinct(), "series_id", "left_anti")


def label_names(series: DataFrame) -> DataFrame:
    """All label names, sorted."""
    return series.select(F.explode(F.map_keys("labels")).alias("name")).distinct().orderBy("name")


def union_names(catalogs: Sequence[DataFrame]) -> DataFrame:
    """The label names of several catalogs, each once, sorted."""
    return reduce(lambda a, b: a.unionByName(b), [label_names(c) for c in catalogs]).distinct().orderBy("name")


def union_values(catalogs: Sequence[DataFrame], name: str) -> DataFrame:
    """The values of one name over several catalogs, each once, sorted."""
    return reduce(lambda a, b: a.unionByName(b), [label_values(c, name) for c in catalogs]).distinct().orderBy("value")


def label_values(series: DataFrame, name: str) -> DataFrame:
    """All values of one label name, sorted. A NULL value is none."""
    value = F.try_element_at("labels", F.lit(name))
    return series.select(value.alias("value")).where("value IS NOT NULL").distinct().orderBy("value")


def symbols(series: DataFrame) -> DataFrame:
    """All names and values, sorted."""
    both = F.explode(F.concat(F.map_keys("labels"), F.map_values("labels")))
    return series.select(both.alias("symbol")).where("symbol IS NOT NULL").distinct().orderBy("symbol")


def label_pairs(series: DataFrame) -> DataFrame:
    """All ``(name, value)``, sorted."""
    return series.select(F.explode("labels").alias("name", "value")).distinct().orderBy("name", "value")


def tuple_values(series: DataFrame, names: Sequence[str]) -> DataFrame:
    """The combinations of values that the given names have together; series that lack one of them do not count."""
    values = [F.try_element_at("labels", F.lit(n)).alias(n) for n in names]
    return series.select(*values).dropna().distinct()


def index_entries(index: DataFrame) -> DataFrame:
    """``(name, value, ids, first_id, last_id)``: size and bounds of every posting list."""
    return index.groupBy("name", "value").agg(F.count_distinct("series_id").alias("ids"), F.min("series_id").alias("first_id"), F.max("series_id").alias("last_id"))


def partition_stats(samples: DataFrame) -> DataFrame:
    """``(p_start, samples, series, min_t, max_t)`` per time partition."""
    per_series = samples.groupBy("p_start", "series_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("b"))
    return per_series.groupBy("p_start").agg(F.sum("n").alias("samples"), F.count(F.lit(1)).alias("series"), F.min("a").alias("min_t"), F.max("b").alias("max_t"))


def series_in_order(series: DataFrame) -> DataFrame:
    """``(series_id, position)``: the series numbered in the order of their label sets, of equal sets by id."""
    keyed = series.select("series_id", label_key(F.col("labels")).alias("label_key"))
    return dense_ids(keyed, ["label_key", "series_id"], "position").select("series_id", "position")


def recovered(log: DataFrame) -> DataFrame:
    """``(series_id, label_key)``: the index built again from a log of ``labels, seq``: ids from 1 in order of first arrival."""
    first = log.groupBy(label_key(F.col("labels")).alias("label_key")).agg(F.min("seq").alias("_seq"))
    return dense_ids(first, ["_seq", "label_key"], "series_id").select("series_id", "label_key")


def cardinalities(series: DataFrame, tombs: DataFrame, bounds: DataFrame, purged_to: int) -> DataFrame:
    """One row: distinct tags, delete intervals after coalescing, and series that a purge up to a time would drop and keep."""
    tags = label_pairs(series).agg(F.count(F.lit(1)).alias("tags"))
    cut = coalesce_intervals(tombs).agg(F.count(F.lit(1)).alias("intervals"))
    gone = bounds.agg(F.count_if(F.col("max_t") <= purged_to).alias("purged"), F.count_if(F.col("max_t") > purged_to).alias("kept"))
    return gone.withColumns({"tags": tags.scalar(), "intervals": cut.scalar()})


def approximate_size(samples: DataFrame, low: int, high: int) -> DataFrame:
    """``(files, bytes)`` of the stored files that hold ids from ``low`` to ``high``; files count whole."""
    files = samples.where(F.col("series_id").between(low, high)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).distinct()
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def block_stats(samples: DataFrame, tombs: DataFrame, per_chunk: int = 8) -> DataFrame:
    """``(p_start, samples, series, chunks, tombstones)`` per time partition: chunks hold ``per_chunk`` samples of a series, tombstones
    are the delete intervals of the partition's series."""
    per_series = samples.groupBy("p_start", "series_id").agg(F.count(F.lit(1)).alias("n"))
    cut = tombs.groupBy("series_id").agg(F.count(F.lit(1)).alias("cut"))
    chunks = F.sum(F.ceil(F.col("n") / per_chunk))
    return per_series.join(cut, "series_id", "left").groupBy("p_start").agg(F.sum("n").alias("samples"), F.count(F.lit(1)).alias("series"), chunks.alias("chunks"), F.coalesce(F.sum("cut"), F.lit(0)).alias("tombstones"))


def time_bounds(samples: DataFrame) -> DataFrame:
    """``(series_id, min_t, max_t, samples)`` per series."""
    return samples.groupBy("series_id").agg(F.min("t").alias("min_t"), F.max("t").alias("max_t"), F.count(F.lit(1)).alias("samples"))
