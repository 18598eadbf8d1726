"""JSON requests and results as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.matchers import Eq

INSERT = "type int, id decimal(20,0), slots array<int>, lset map<string,string>, lsets array<map<string,string>>, t bigint, v array<double>"
NUMBERS = {"allowNonNumericNumbers": "true"}
PAGE_MS = 86_400_000  # span of time of a page of a result
REQUEST = "matchers map<string,string>, mint bigint, maxt bigint, metric int"


def parse_inserts(lines: DataFrame, column: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """Insert requests, one JSON object per row, in the shape ``INSERT``; rows that cannot be read are NULL in all fields.

    Group ids may exceed a signed long, so ``id`` is a decimal. ``keep`` are columns of ``lines`` to be kept.
    """
    return lines.select(*keep, F.from_json(column, INSERT, NUMBERS).alias("r")).select(*keep, "r.*")


def encode_inserts(inserts: DataFrame, *columns: str) -> DataFrame:
    """``value``: the given columns of each row as an insert request; NULL fields are left out."""
    return inserts.select(F.to_json(F.struct(*columns)).alias("value"))


def encode_query(matchers: Sequence[Eq], mint: int, maxt: int, metric: bool = True) -> str:
    """A query request, as :func:`parse_query` reads it."""
    return json.dumps({"matchers": {m.name: m.value for m in matchers}, "mint": mint, "maxt": maxt, "metric": int(metric)})


def rejected(parsed: DataFrame) -> DataFrame:
    """Parsed requests that cannot be carried out, with ``reason``: no time, no values, or not one value for each slot or label set."""
    several = F.greatest(F.size("slots"), F.size("lsets"))
    reason = F.when(F.col("t").isNull(), "no time").when(F.coalesce(F.size("v"), F.lit(0)) < 1, "no value").when(F.col("lset").isNull() & F.col("id").isNull() & F.col("lsets").isNull(), "no labels and no id").when((several > 0) & (several != F.size("v")), "values differ in number")
    return parsed.withColumn("reason", reason).where("reason IS NOT NULL")


def is_group(id_column: str = "id"):
    """Whether an id is a group's: bit 63 of the unsigned number."""
    return F.col(id_column) >= F.lit(str(2**63)).cast("decimal(20,0)")


def parse_query(text: str) -> tuple[list[Eq], int, int, bool]:
    """A query request: equality matchers, inclusive range, and whether labels are wanted (the default)."""
    request = json.loads(text)
    return [Eq(n, v) for n, v in sorted(request["matchers"].items())], int(request["mint"]), int(request["maxt"]), bool(request.get("metric", 1))


def encode_results(samples: DataFrame, metric: bool = True, page_ms: int = PAGE_MS) -> DataFrame:
    """``series_id, page, json`` of ``series_id, labels, t, v``: labels if wanted and ``[seconds, value]`` in order of time.

    The result of a series comes in pages of ``page_ms``, numbered by time, so that no row gathers a whole series.
    """
    pair = F.struct((F.col("t") / 1000).alias("t"), F.col("v").alias("v"))
    keys = [F.max_by("labels", "t").alias("metric")] if metric else []
    grouped = samples.groupBy("series_id", F.floor(F.col("t") / page_ms).alias("page")).agg(*keys, F.sort_array(F.collect_list(pair)).alias("values"))
    fields = (["metric"] if metric else []) + ["values"]
    return grouped.select("series_id", "page", F.to_json(F.struct(*fields)).alias("json"))


def decode_results(encoded: DataFrame) -> DataFrame:
    """The samples ``series_id, labels, t, v`` of encoded results."""
    shape = "metric map<string,string>, values array<struct<t:double,v:double>>"
    rows = encoded.select("series_id", F.from_json("json", shape, NUMBERS).alias("r"))
    return rows.select("series_id", F.col("r.metric").alias("labels"), F.explode("r.values").alias("p")).select("series_id", "labels", F.round(F.col("p.t") * 1000).cast("bigint").alias("t"), "p.v")
