"""Readers for line formats, metadata files and generated series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import labels as L
from tideline.operators.ids import dense_ids


def devops_lines(spark: SparkSession, path: str, metrics: Sequence[str]) -> DataFrame:
    """``labels`` of every host line ``prefix,k=v,k=v,...`` with each of the metrics as ``__name__``.

    Of a name that a line repeats the first value counts; parts without ``=`` are left out.
    """
    parts = F.split(F.element_at(F.split("value", ",", 2), 2), ",")
    entries = F.transform(F.filter(parts, lambda p: F.contains(p, F.lit("="))), lambda p: F.named_struct(F.lit("key"), F.split(p, "=", 2)[0], F.lit("value"), F.split(p, "=", 2)[1]))
    named = spark.read.text(path).where(F.size(F.split("value", ",", 2)) == 2).select(entries.alias("e"), F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    key = F.concat(F.array(F.struct(F.lit("__name__").alias("key"), F.col("metric").alias("value"))), F.col("e"))
    return named.select(L.from_key(key).alias("labels"))


def json_labels(spark: SparkSession, path: str) -> DataFrame:
    """``labels`` of each line, one JSON object per line; lines that are none are left out."""
    parsed = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    return spark.read.text(path).select(parsed.alias("labels")).where("labels IS NOT NULL")


def csv_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``line, values``: each line's number, from 1, and its comma-separated numbers; what is no number is NULL.

    Several files are numbered through in the order in which they are read.
    """
    values = F.transform(F.split("value", ","), lambda x: x.try_cast("double"))
    placed = spark.read.text(path).select(F.monotonically_increasing_id().alias("_at"), values.alias("values"))
    return dense_ids(placed, ["_at"], "line").select("line", "values")


def block_meta(spark: SparkSession, path: str) -> DataFrame:
    """Block metadata files: one JSON object per file with id, time range and statistics."""
    schema = "ulid string, minTime long, maxTime long, stats struct<numSamples:long,numSeries:long,numChunks:long,numTombstones:long>"
    meta = spark.read.schema(schema).json(path, multiLine=True)
    return meta.select(F.col("ulid").alias("block"), F.col("minTime").alias("min_t"), F.col("maxTime").alias("max_t"), F.col("stats.numSamples").alias("samples"), F.col("stats.numSeries").alias("series"), F.col("stats.numChunks").alias("chunks"), F.col("stats.numTombstones").alias("tombstones"))


def devops_hosts(spark: SparkSession, hosts: int, seed: int = 1, first: int = 100_000) -> DataFrame:
    """``labels`` of generated hosts: the number from ``first`` on, and tags picked by the seed from small domains."""
    domains = {"region": 9, "datacenter": 18, "rack": 100, "os": 3, "arch": 2, "team": 4, "service": 20, "service_version": 2, "service_environment": 3}
    pick = lambda n, k: F.pmod(F.xxhash64("id", F.lit(f"{seed}/{n}")), F.lit(k)).cast("string")
    pairs = [x for n, k in domains.items() for x in (F.lit(n), F.concat(F.lit(f"{n}-"), pick(n, k)))]
    return spark.range(hosts).select(F.create_map(F.lit("hostname"), F.concat(F.lit("host_"), F.col("id") + first), *pairs).alias("labels"))


def regular_samples(series: DataFrame, start: int, interval: int, count: int, jitter: int = 200) -> DataFrame:
    """``series_id, t, v`` of ``count`` samples per series, ``interval`` apart with jitter; the value is the jitter."""
    points = series.select("series_id", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k"))
    late = F.pmod(F.xxhash64("series_id", "k"), F.lit(jitter))
    return points.select("series_id", (F.lit(start) + F.col("k") * interval + late).alias("t"), late.cast("double").alias("v"))
