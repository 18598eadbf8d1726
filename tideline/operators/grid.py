"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import cut_lineage

BLOCK = 4096  # grid slots of one result that are put in order, or generated, together
SALTS = 16  # keys over which the samples of a result are spread


def slot_readings(grids: DataFrame, samples: DataFrame) -> DataFrame:
    """``(id, slot, first_t, first_v, last_t, last_v, n)``: the readings of each grid slot that has any.

    Only rows of ``samples`` inside the grid of their ``id`` with ``v`` neither NULL nor NaN are readings. Of
    several rows of one ``(id, t)`` the greatest ``v`` counts; ``n`` counts rows as they stand. The rows are reduced inside the map tasks, so a
    result with many samples is no heavy group afterwards.
    """
    grid = grids.select("id", "mint", "maxt", "step_ms")
    # A result with most of the samples meets its grid in several tasks, by salt, of which the grid has a row each; as the
    # slots are grouped by a key of their own, the adaptive plan may split these further.
    rows = samples.select("id", "t", "v").where("v IS NOT NULL AND NOT isnan(v) AND t IS NOT NULL")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int"))
    spread = grid.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    inside = rows.join(spread, ["id", "salt"]).where("t BETWEEN mint AND maxt").selectExpr("named_struct('id', id, 'slot', (t - mint) div step_ms) AS at", "t", "v")
    return inside.groupBy("at").agg(
        F.min(F.struct("t", (-F.col("v")).alias("w"))).alias("head"),
        F.max(F.struct("t", "v")).alias("tail"),
        F.count(F.lit(1)).alias("n"),
    ).select("at.id", "at.slot", F.col("head.t").alias("first_t"), (-F.col("head.w")).alias("first_v"), F.col("tail.t").alias("last_t"), F.col("tail.v").alias("last_v"), "n")


def _slots(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """``df`` with ``at``, a row for each slot from ``low`` to ``high``, generated ``BLOCK`` at a time."""
    bounded = df.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    pages = bounded.withColumn("_page", F.explode(F.expr(f"sequence(_low div {BLOCK}, _high div {BLOCK})")))
    return pages.withColumn("at", F.explode(F.expr(f"sequence(greatest(_low, _page * {BLOCK}), least(_high, _page * {BLOCK} + {BLOCK - 1}))"))).drop("_low", "_high", "_page")


def regular(grids: DataFrame, samples: DataFrame, max_gap_ms: int | None = None) -> DataFrame:
    """One row per grid slot of every result: ``(id, slot_t, v, n, state)``.

    ``grids`` has one row per result, ``id, mint, maxt, step_ms``; its slots are ``mint, mint + step_ms, ...``
    up to ``maxt``. ``state`` is ``read`` (the slot has ``n`` readings, ``v`` is its last), ``filled`` (``v``
    interpolated linearly at ``slot_t`` between the readings before and after), ``gap`` (as ``filled``, but the
    readings are further apart than ``max_gap_ms``, default five steps: ``v`` NULL), ``before`` and ``after``
    (outside the readings: the first or last value is carried, unless further than the gap: NULL) or ``none``
    (the result has no readings). Between an infinite value and another nothing is interpolated: ``v`` NULL.

    Consecutive occupied slots are paired with ``lead``, and only the grid times between the two are exploded;
    the slots before the first and after the last reading are generated explicitly. The pairing runs per block
    of ``BLOCK`` slots; the pair that crosses into the next block comes from a row per block. Grids with NULL
    or impossible bounds (``step_ms`` <= 0, ``maxt`` < ``mint``) have no slots.
    """
    valid = grids.select("id", "mint", "maxt", "step_ms").where("id IS NOT NULL AND step_ms > 0 AND maxt >= mint").dropDuplicates(["id"])
    # Read three times below: a row per occupied slot, worked out once.
    occupied = cut_lineage(slot_readings(valid, samples)).withColumn("block", F.expr(f"slot div {BLOCK}"))
    inner = Window.partitionBy("id", "block").orderBy("slot")
    nxt = F.struct("slot", "first_t", "first_v")
    paired = occupied.withColumn("next", F.lead(nxt).over(inner))
    # A row per block knows its first occupied slot; the block before needs it for its last pair.
    blocks = occupied.groupBy("id", "block").agg(F.min(nxt).alias("head"))
    following = blocks.withColumn("over", F.lead("head").over(Window.partitionBy("id").orderBy("block"))).select("id", "block", "over")
    paired = paired.join(following, ["id", "block"]).withColumn("next", F.coalesce("next", "over")).drop("over")
    gap = F.lit(max_gap_ms).cast("bigint") if max_gap_ms is not None else F.col("step_ms") * 5
    grid = valid.withColumn("last_slot", F.expr("(maxt - mint) div step_ms")).withColumn("max_gap", gap)
    # Each occupied slot yields itself and the empty slots up to the next occupied one.
    to = F.when(F.col("next").isNull(), F.col("last_slot")).otherwise(F.col("next.slot") - 1)
    spread = _slots(paired.join(grid, "id"), F.col("slot"), to)
    slot_t = F.col("mint") + F.col("at") * F.col("step_ms")
    share = (F.col("slot_t") - F.col("last_t")) / (F.col("next.first_t") - F.col("last_t"))
    line = F.col("last_v") + (F.col("next.first_v") - F.col("last_v")) * share
    finite = (F.abs("last_v") < F.lit(float("inf"))) & (F.abs(F.col("next.first_v")) < F.lit(float("inf")))
    near = (F.col("next.first_t") - F.col("last_t")) <= F.col("max_gap")
    own, last = F.col("at") == F.col("slot"), F.col("next").isNull()
    state = F.when(own, "read").when(last, "after").when(near, "filled").otherwise("gap")
    value = F.when(own, F.col("last_v")).when(last, F.when(F.col("slot_t") - F.col("last_t") <= F.col("max_gap"), F.col("last_v"))).when(near & finite, line)
    body = spread.withColumn("slot_t", slot_t).select("id", "slot_t", value.alias("v"), F.when(own, F.col("n")).otherwise(F.lit(0)).alias("n"), state.alias("state"))
    # Boundary before the first reading, and results without any.
    first = occupied.groupBy("id").agg(F.min(nxt).alias("head"))
    lead_in = grid.join(first, "id", "left").withColumn("until", F.coalesce(F.col("head.slot") - 1, F.col("last_slot"))).where("until >= 0")
    lead_in = _slots(lead_in, F.lit(0).cast("bigint"), F.col("until")).withColumn("slot_t", slot_t)
    carried = F.when(F.col("head.first_t") - F.col("slot_t") <= F.col("max_gap"), F.col("head.first_v"))
    edge = lead_in.select("id", "slot_t", carried.alias("v"), F.lit(0).cast("bigint").alias("n"), F.when(F.col("head").isNull(), "none").otherwise("before").alias("state"))
    return body.unionByName(edge)
