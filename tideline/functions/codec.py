"""A compact binary form of one series' samples: delta-of-delta times and XORed values in a bit stream.

Parquet compresses columns as well; this is for samples that travel inside a single value.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The bits of a delta of deltas by class, each class one more leading 1.
TIME_BITS = (14, 17, 20, 64)


class _Out:
    """A bit stream; whole bytes are put aside, so that appending costs the same at any length."""

    def __init__(self) -> None:
        self.done, self.value, self.length = bytearray(), 0, 0

    def put(self, number: int, bits: int) -> None:
        self.value = (self.value << bits) | (number & ((1 << bits) - 1))
        self.length += bits
        if self.length >= 512:
            rest = self.length % 8
            self.done += (self.value >> rest).to_bytes(self.length // 8, "big")
            self.value, self.length = self.value & ((1 << rest) - 1), rest

    def bytes(self) -> bytes:
        pad = -self.length % 8
        return bytes(self.done) + (self.value << pad).to_bytes((self.length + pad) // 8, "big")


class _In:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, bits: int) -> int:
        end = self.at + bits
        window = int.from_bytes(self.data[self.at // 8 : -(-end // 8)], "big")
        self.at = end
        return (window >> (-end % 8)) & ((1 << bits) - 1)

    def signed(self, bits: int) -> int:
        x = self.take(bits)
        return x - (1 << bits) if x >> (bits - 1) else x


def _raw(v: float) -> int:
    return struct.unpack(">Q", struct.pack(">d", v))[0]


def encode(ts: Sequence[int], vs: Sequence[float | None]) -> bytes:
    """Samples as bytes; a NULL value takes one bit, every float keeps its exact bits."""
    out = _Out()
    out.put(len(ts), 32)
    before = delta = last = 0
    for i, (t, v) in enumerate(zip(ts, vs, strict=True)):
        if i == 0:
            out.put(t, 64)
        else:
            change = t - before - delta
            delta = t - before
            if change == 0:
                out.put(0, 1)
            else:
                for k, bits in enumerate(TIME_BITS):
                    if bits == 64 or -(1 << (bits - 1)) <= change < 1 << (bits - 1):
                        final = k == len(TIME_BITS) - 1
                        out.put((1 << (k + 1)) - 1 if final else ((1 << (k + 1)) - 1) << 1, k + 1 if final else k + 2)
                        out.put(change, bits)
                        break
        before = t
        if v is None:
            out.put(0, 1)
            continue
        out.put(1, 1)
        x = _raw(v) ^ last
        last ^= x
        if x == 0:
            out.put(0, 1)
        else:
            low = (x & -x).bit_length() - 1
            size = x.bit_length() - low
            out.put(1, 1)
            out.put(low, 6)
            out.put(size - 1, 6)
            out.put(x >> low, size)
    return out.bytes()


def decode(data: bytes) -> tuple[list[int], list[float | None]]:
    source, ts, vs = _In(data), [], []
    before = delta = last = 0
    for i in range(source.take(32)):
        if i == 0:
            t = source.signed(64)
        else:
            k = 0
            while k < len(TIME_BITS) and source.take(1):
                k += 1
            delta += source.signed(TIME_BITS[k - 1]) if k else 0
            t = before + delta
        ts.append(t)
        before = t
        if not source.take(1):
            vs.append(None)
            continue
        if source.take(1):
            low, size = source.take(6), source.take(6) + 1
            last ^= source.take(size) << low
        vs.append(struct.unpack(">d", struct.pack(">Q", last))[0])
    return ts, vs


def encode_group(ts: Sequence[int], columns: Sequence[Sequence[float | None]]) -> bytes:
    """Samples of a group as bytes: one stream of times, then a stream of values for each member; a bit a sample of each is idle."""
    streams = [encode(ts, [None] * len(ts)), *(encode([0] * len(ts), vs) for vs in columns)]
    return struct.pack(f">I{len(streams)}I", len(streams), *map(len, streams)) + b"".join(streams)


def decode_group(data: bytes) -> tuple[list[int], list[list[float | None]]]:
    n = struct.unpack_from(">I", data)[0]
    at, streams = 4 * (n + 1), []
    for size in struct.unpack_from(f">{n}I", data, 4):
        streams.append(decode(data[at : at + size]))
        at += size
    return streams[0][0], [vs for _, vs in streams[1:]]


SAMPLES = T.ArrayType(T.StructType([T.StructField("t", T.LongType()), T.StructField("v", T.DoubleType())]))


@F.pandas_udf(T.BinaryType())
def _encode(samples: pd.Series) -> pd.Series:
    return samples.map(lambda rows: None if rows is None else encode([r["t"] for r in rows], [None if r["v"] is None else float(r["v"]) for r in rows]))


@F.pandas_udf(SAMPLES)
def _decode(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else [{"t": t, "v": v} for t, v in zip(*decode(b), strict=True)])


GROUP_ROWS = T.ArrayType(T.StructType([T.StructField("t", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))]))


@F.pandas_udf(T.BinaryType())
def _encode_group(groups: pd.Series) -> pd.Series:
    def one(rows):
        columns = list(zip(*[[None if x is None or x != x else float(x) for x in r["v"]] for r in rows], strict=True))
        return encode_group([r["t"] for r in rows], columns)

    return groups.map(lambda rows: None if rows is None else one(rows))


@F.pandas_udf(GROUP_ROWS)
def _decode_group(data: pd.Series) -> pd.Series:
    def one(b):
        ts, columns = decode_group(b)
        return [{"t": t, "v": [c[i] for c in columns]} for i, t in enumerate(ts)]

    return data.map(lambda b: None if b is None else one(b))


def encoded_group(rows: Column) -> Column:
    """Binary form of an ``ARRAY<STRUCT<t BIGINT, v ARRAY<DOUBLE>>>``, a value per member in each row; NaN counts as NULL here,
    as both come as NaN in a batch."""
    return _encode_group(rows)


def decoded_group(data: Column) -> Column:
    return _decode_group(data)


def encoded(samples: Column) -> Column:
    """Binary form of an ``ARRAY<STRUCT<t BIGINT, v DOUBLE>>``."""
    return _encode(samples)


def decoded(data: Column) -> Column:
    return _decode(data)
