"""Continuous ingest: every micro-batch becomes one committed batch of the store.

No watermark: late and out-of-order samples are never dropped, as the last write wins on read. A batch that is
delivered again after a failure is recognised by its number and not written twice. Numbers are those of one stream,
so each stream into a store writes under a name of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.functions import wire
from tideline.sources.store import Store


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1, fmt: str = "parquet") -> DataFrame:
    """A stream of the files that arrive under ``path``; ``files_per_batch`` bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def topic_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Lines of a Kafka topic; needs the connector on the session's class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.col("value").cast("string").alias("value"))


def into_store(stream: DataFrame, store: Store, checkpoint: str, by_labels: bool = False, once: bool = True, writer: str | None = None) -> StreamingQuery:
    """Start writing a stream of ``series_id, t, v, seq`` (or ``labels, t, v, seq``) into the store.

    ``writer`` names the stream in the store's commits; by default that is its checkpoint folder, which numbers its batches.
    """

    def commit(rows: DataFrame, batch: int) -> None:
        (store.add if by_labels else store.append)(rows, batch, writer or checkpoint)

    sink = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (sink.trigger(availableNow=True) if once else sink).start()


def json_inserts(lines: DataFrame) -> DataFrame:
    """Single-series inserts of a stream of JSON lines as ``labels, t, v``; an insert has one value."""
    parsed = wire.parse_inserts(lines)
    return parsed.where("lset IS NOT NULL AND t IS NOT NULL").select(F.col("lset").alias("labels"), "t", F.get("v", F.lit(0)).alias("v"))


def windowed(stream: DataFrame, width: str, lateness: str, how: str = "max") -> DataFrame:
    """Tumbling aggregates ``series_id, start, <how>_v, n`` of a stream with ``ts`` (timestamp), for live views.

    Only these views forget: what is later than ``lateness`` is in the store but not in the view.
    """
    fold = {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum}[how]
    grouped = stream.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "series_id")
    return grouped.agg(fold("v").alias(f"{how}_v"), F.count(F.lit(1)).alias("n")).select("series_id", F.col("w.start").alias("start"), f"{how}_v", "n")
