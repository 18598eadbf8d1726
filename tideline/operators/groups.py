"""Groups: many series that share one time column, in long form ``(group, slot, t, v)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import labels as L
from tideline.operators.matchers import Matcher, member_conjunction
from tideline.operators.merge import chain, last_write_wins


def long_form(inserts: DataFrame, key: Sequence[str] = ("group_key",)) -> DataFrame:
    """``key, slot, t, v, seq``: one row per value of group inserts with ``slots, t, v, seq``.

    ``v`` runs parallel to ``slots``; an insert without slots gives all members, slot by position. A slot that an
    insert does not name has no row, so partial inserts never overwrite other slots; a NULL value is a row. An
    insert with slots but not one value for each is an error; :func:`malformed` finds such inserts beforehand.
    """
    slots = F.when(F.size(F.coalesce("slots", F.array().cast("array<int>"))) > 0, F.col("slots")).otherwise(F.transform("v", lambda _, i: i))
    checked = F.when(F.size("slots") == F.size("v"), F.col("slots")).otherwise(F.raise_error(F.concat(F.lit("slots and values of a group insert differ in number, seq "), F.coalesce(F.col("seq").cast("string"), F.lit("NULL")))))
    named = inserts.where("v IS NOT NULL").withColumn("slots", slots).withColumn("slots", checked)
    paired = named.select(*key, "t", "seq", F.explode(F.arrays_zip("slots", "v")).alias("e"))
    return paired.where("e.slots IS NOT NULL").select(*key, F.col("e.slots").alias("slot"), "t", F.col("e.v").alias("v"), "seq")


def malformed(inserts: DataFrame) -> DataFrame:
    """The inserts that name slots but have not one value for each."""
    return inserts.where((F.size("slots") > 0) & ~F.coalesce(F.size("slots") == F.size("v"), F.lit(False)))


def members(inserts: DataFrame, key: str = "group_key") -> DataFrame:
    """``key, slot, labels`` of every member: label sets run parallel to slots; the earliest insert names a slot."""
    paired = inserts.where(F.size("lsets") > 0).select(key, "seq", F.posexplode("lsets").alias("pos", "labels"), "slots")
    slot = F.coalesce(F.get("slots", F.col("pos")), F.col("pos"))
    return paired.withColumn("slot", slot).groupBy(key, "slot").agg(F.min_by("labels", "seq").alias("labels"))


def chained(chains: Sequence[DataFrame]) -> DataFrame:
    """The values of several chunks of a group (``key, slot, t, v``) as they stand, a row for each; nothing is merged."""
    return chain(chains)


def concat(earlier: DataFrame, later: DataFrame, key: Sequence[str] = ("group_key",)) -> DataFrame:
    """Two chunks of a group that do not overlap in time as one: ``key, slot, t, v`` with a NULL row where a member
    of either chunk has no value at a time of the other."""
    both = earlier.select(*key, "slot", "t", "v").unionByName(later.select(*key, "slot", "t", "v"))
    slots, times = both.select(*key, "slot").distinct(), both.select(*key, "t").distinct()
    return slots.join(times, list(key)).join(both, [*key, "slot", "t"], "left").select(*key, "slot", "t", "v")


def assign_slots(named: DataFrame, key: str = "group_key") -> DataFrame:
    """``key, label_key, slot`` for inserts that name members by labels: numbered by first arrival within the group.

    ``named`` has ``key, label_key, seq, pos``; a member seen again keeps its slot.
    """
    from pyspark.sql import Window

    first = named.groupBy(key, "label_key").agg(F.min(F.struct("seq", "pos")).alias("first"))
    return first.withColumn("slot", F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1).drop("first")


def current(long: DataFrame, key: Sequence[str] = ("group_key",), overwrite_with_null: bool = True) -> DataFrame:
    """The valid value of each ``(key, slot, t)``; with ``overwrite_with_null`` False a newer NULL keeps the older value."""
    return last_write_wins(long, [*key, "slot", "t"], ["seq"], non_null=not overwrite_with_null)


def non_null(values: DataFrame) -> DataFrame:
    return values.where("v IS NOT NULL")


def wide(values: DataFrame, key: Sequence[str], slots: Sequence[int]) -> DataFrame:
    """One row per ``key, t`` with a column ``s<slot>`` for each of the given slots, NULL where a member has no value."""
    columns = [F.max(F.when(F.col("slot") == s, F.col("v"))).alias(f"s{s}") for s in slots]
    return values.groupBy(*key, "t").agg(*columns)


def select_members(groups: DataFrame, matchers: Sequence[Matcher]) -> DataFrame:
    """Members of ``groups`` (``group_labels``, ``labels``) for which each matcher holds by group or by own labels.

    ``full_labels`` has the labels of both, a shared name with the member's value.
    """
    chosen = groups.where(member_conjunction(matchers, F.col("group_labels"), F.col("labels")))
    return chosen.withColumn("full_labels", L.merged(F.col("group_labels"), F.col("labels")))
