"""Arithmetic on millisecond times and time partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def partition_floor(t: Column | str, width: int) -> Column:
    """Start of the partition of ``t``: ``t / width * width`` with division that truncates towards zero."""
    t = F.col(t) if isinstance(t, str) else t
    return (t - F.try_mod(t, F.lit(width).cast("bigint"))).cast("bigint")


def partition_end(t: Column | str, width: int) -> Column:
    """The next aligned end after ``t``."""
    return partition_floor(t, width) + width


def block_ranges(least: int, steps: int, factor: int) -> list[int]:
    """Exponential widths ``least * factor^i`` for ``steps`` levels."""
    return [least * factor**i for i in range(steps)]


def adapted_width(width: Column, size: Column, budget: int, least: int = 450_000) -> Column:
    """The width of partitions that would hold ``budget`` where partitions of ``width`` hold ``size``, by halves or doubles.

    Halved until it is at most ``width * budget / size``, or at most ``least``; doubled as long as it stays below that. A ``size`` of 0 or
    NULL leaves it as it is.
    """
    width = width.cast("double")
    wanted = F.try_divide(width * budget, size)
    halves = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.floor(width / F.pow(F.lit(2.0), k)) <= F.greatest(wanted, F.lit(least)))
    doubles = F.filter(F.sequence(F.lit(1), F.lit(40)), lambda k: width * F.pow(F.lit(2.0), k) < wanted)
    changed = F.when(size > budget, F.floor(width / F.pow(F.lit(2.0), F.get(halves, F.lit(0))))).otherwise(width * F.pow(F.lit(2.0), F.size(doubles)))
    return F.when(wanted.isNotNull(), changed).otherwise(width).cast("bigint")


def clamp(a: Column, b: Column, mint: Column | int, maxt: Column | int) -> tuple[Column, Column]:
    """The interval ``[a, b]`` limited to ``[mint, maxt]``."""
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (mint, maxt))
    return F.greatest(a, low), F.least(b, high)


def pack_chunk(series_id: Column, chunk_no: Column) -> Column:
    """Series in the upper five bytes, chunk number in the lower three."""
    return F.shiftleft(series_id, 24).bitwiseOR(chunk_no.bitwiseAND(F.lit((1 << 24) - 1)))


def unpack_chunk(ref: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(ref, 24), ref.bitwiseAND(F.lit((1 << 24) - 1))


def backoff(delay: float, least: float, most: float) -> float:
    """The next delay of a retry: doubled, between ``least`` and ``most``."""
    return min(max(delay * 2, least), most)


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp, truncated."""
    return F.expr("0L") + (F.unix_micros(ts.cast("timestamp")) - F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1000))) / 1000
