"""Byte encodings of numbers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def big_endian(x: Column) -> Column:
    """A BIGINT as 8 bytes; of numbers that are not negative, bytes compare as the numbers do."""
    return F.unhex(F.lpad(F.hex(x.cast("bigint")), 16, "0"))


def from_big_endian(data: Column, at: int = 0) -> Column:
    """The BIGINT that begins at byte ``at``."""
    high, low = (F.conv(F.hex(F.substring(data, at + k, 4)), 16, 10).cast("bigint") for k in (1, 5))
    return F.shiftleft(high, 32).bitwiseOR(low)


def sample_key(series_id: Column, t: Column) -> Column:
    """The key of a sample: series and time, 8 bytes each."""
    return F.concat(big_endian(series_id), big_endian(t))


def zigzag(x: Column) -> Column:
    """Numbers of small size, negative ones too, as small numbers."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def from_zigzag(x: Column) -> Column:
    return F.shiftrightunsigned(x, 1).bitwiseXOR(-x.bitwiseAND(F.lit(1).cast("bigint")))


def varint_size(x: Column) -> Column:
    """Bytes of the number in groups of seven bits; a negative number takes ten."""
    return F.when(x < 0, 10).otherwise(reduce(lambda a, k: a + F.when(x >= F.lit(1 << (7 * k)).cast("bigint"), 1).otherwise(0), range(1, 9), F.lit(1)))


def checksum(data: Column) -> Column:
    """CRC-32 of bytes."""
    return F.crc32(data)
