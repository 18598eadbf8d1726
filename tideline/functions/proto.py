"""Binary bodies of requests and results, in the protocol buffer wire format.

A body travels as one value; the codec is driven by a table of the messages' fields and runs over Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Number, name, kind and whether it repeats, of every field of every message.
MESSAGES = {
    "Tag": [(1, "name", "bytes", False), (2, "value", "bytes", False)],
    "Tags": [(1, "tags", "Tag", True)],
    "InsertSample": [(1, "type", "varint", False), (2, "id", "varint", False), (3, "slots", "varint", True), (4, "lset", "Tags", False), (5, "lsets", "Tags", True), (6, "t", "signed", False), (7, "v", "double", True)],
    "InsertSamples": [(1, "samples", "InsertSample", True)],
    "InsertResult": [(1, "id", "varint", False), (2, "slots", "varint", True)],
    "InsertResults": [(1, "results", "InsertResult", True)],
    "QueryRequest": [(1, "return_metric", "varint", False), (2, "lset", "Tags", False), (3, "mint", "signed", False), (4, "maxt", "signed", False)],
    "QuerySample": [(1, "t", "signed", False), (2, "v", "double", False)],
    "QueryGroupSample": [(1, "metric", "Tags", False), (2, "values", "QuerySample", True)],
    "QueryResult": [(1, "metric", "Tags", False), (2, "id", "varint", False), (3, "values", "QuerySample", True), (4, "series", "QueryGroupSample", True)],
    "QueryResults": [(1, "results", "QueryResult", True)],
}
VARINT, FIXED64, LENGTH, FIXED32 = 0, 1, 2, 5  # wire types
MASK = (1 << 64) - 1


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value & MASK, at
        shift += 7


def _scalar(kind: str, x) -> bytes:
    if kind == "double":
        return struct.pack("<d", x)
    return _varint(int(x) & MASK)


def encode(message: str, fields: dict) -> bytes:
    """A message from its fields by name. Fields that are missing, None or of the default value take no space; numbers that repeat are packed."""
    out = bytearray()
    for number, name, kind, repeats in MESSAGES[message]:
        value = fields.get(name)
        if value is None or (repeats and not value):
            continue
        if kind in MESSAGES or kind == "bytes":
            for one in value if repeats else [value]:
                body = encode(kind, one) if kind in MESSAGES else (one.encode() if isinstance(one, str) else one)
                if body or repeats or kind in MESSAGES:
                    out += _varint(number << 3 | LENGTH) + _varint(len(body)) + body
        elif repeats:
            body = b"".join(_scalar(kind, x) for x in value)
            out += _varint(number << 3 | LENGTH) + _varint(len(body)) + body
        elif value != 0 or (kind == "double" and struct.pack("<d", value) != bytes(8)):
            out += _varint(number << 3 | (FIXED64 if kind == "double" else VARINT)) + _scalar(kind, value)
    return bytes(out)


def _tokens(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """Field number, wire type and raw value of each field of a message."""
    at = 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        wire = tag & 7
        if wire == VARINT:
            raw, at = _read_varint(data, at)
        elif wire in (FIXED64, FIXED32, LENGTH):
            size, at = _read_varint(data, at) if wire == LENGTH else (8 if wire == FIXED64 else 4, at)
            if at + size > len(data):
                raise ValueError("a field ends beyond its message")
            raw, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire} is unknown")
        yield tag >> 3, wire, raw


def _values(kind: str, wire: int, raw) -> list:
    if kind in MESSAGES:
        return [decode(kind, raw)]
    if kind == "bytes":
        return [raw.decode("utf-8", "replace")]
    if kind == "double":
        return list(struct.unpack(f"<{len(raw) // 8}d", raw))
    if wire == LENGTH:
        numbers, at = [], 0
        while at < len(raw):
            n, at = _read_varint(raw, at)
            numbers.append(n)
    else:
        numbers = [raw]
    return [n - (1 << 64) if kind == "signed" and n >> 63 else n for n in numbers]


def decode(message: str, data: bytes) -> dict:
    """The fields of a message by name: numbers that are missing are 0, texts empty, messages None, and what repeats a list.

    Unknown fields are passed over; repeated numbers may be packed or not. Data that is no message is an error.
    """
    known = {number: (name, kind, repeats) for number, name, kind, repeats in MESSAGES[message]}
    out = {name: [] if repeats else None if kind in MESSAGES else "" if kind == "bytes" else 0.0 if kind == "double" else 0 for name, kind, repeats in known.values()}
    for number, wire, raw in _tokens(data):
        if number not in known:
            continue
        name, kind, repeats = known[number]
        own = LENGTH if kind in MESSAGES or kind == "bytes" else FIXED64 if kind == "double" else VARINT
        if wire != own and not (repeats and wire == LENGTH):
            raise ValueError(f"field {name} has wire type {wire}")
        values = _values(kind, wire, raw)
        if repeats:
            out[name] += values
        elif values:
            out[name] = values[-1]
    return out


def _tags(labels) -> dict | None:
    pairs = labels.items() if isinstance(labels, dict) else labels
    return None if labels is None else {"tags": [{"name": n, "value": v} for n, v in sorted(pairs)]}


def _labels(tags: dict | None) -> dict | None:
    """Of a repeated name the first value counts."""
    return None if tags is None else {t["name"]: t["value"] for t in reversed(tags["tags"])}


_MAP = T.MapType(T.StringType(), T.StringType())
INSERTS = T.ArrayType(T.StructType([T.StructField("type", T.IntegerType()), T.StructField("id", T.DecimalType(20, 0)), T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("lset", _MAP), T.StructField("lsets", T.ArrayType(_MAP)), T.StructField("t", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))]))
RESULT = T.StructType([T.StructField("id", T.LongType()), T.StructField("metric", _MAP), T.StructField("values", T.ArrayType(T.StructType([T.StructField("t", T.LongType()), T.StructField("v", T.DoubleType())])))])


@F.pandas_udf(T.BinaryType())
def _encode_inserts(bodies: pd.Series) -> pd.Series:
    def one(samples):
        rows = [{"type": s["type"], "id": s["id"], "slots": None if s["slots"] is None else list(s["slots"]), "lset": _tags(s["lset"]), "lsets": [_tags(x) for x in s["lsets"]] if s["lsets"] is not None else [], "t": s["t"], "v": None if s["v"] is None else list(s["v"])} for s in samples]
        return encode("InsertSamples", {"samples": rows})

    return bodies.map(lambda b: None if b is None else one(b))


@F.pandas_udf(INSERTS)
def _decode_inserts(bodies: pd.Series) -> pd.Series:
    def one(body):
        samples = decode("InsertSamples", body)["samples"]
        return [s | {"id": Decimal(s["id"]) if s["id"] else None, "lset": _labels(s["lset"]), "lsets": [_labels(x) for x in s["lsets"]]} for s in samples]

    return bodies.map(lambda b: None if b is None else one(b))


@F.pandas_udf(T.BinaryType())
def _encode_result(results: pd.DataFrame) -> pd.Series:
    rows = zip(results["id"], results["metric"], results["values"], strict=True)
    return pd.Series([encode("QueryResult", {"id": int(i), "metric": _tags(m), "values": [{"t": p["t"], "v": float(p["v"])} for p in values]}) for i, m, values in rows])


@F.pandas_udf(RESULT)
def _decode_result(bodies: pd.Series) -> pd.DataFrame:
    rows = [decode("QueryResult", b) for b in bodies]
    return pd.DataFrame({"id": [r["id"] - (1 << 64) if r["id"] >> 63 else r["id"] for r in rows], "metric": [_labels(r["metric"]) for r in rows], "values": [r["values"] for r in rows]})


def encoded_inserts(samples: Column) -> Column:
    """A body of an array of inserts (fields as in ``wire.INSERT``); NULL fields take no space."""
    return _encode_inserts(samples)


def decoded_inserts(body: Column) -> Column:
    """The inserts of a body, an array of structs of the fields of ``wire.INSERT``. An ``id`` of 0 is none."""
    return _decode_inserts(body)


def encoded_result(result: Column) -> Column:
    """A body of a result or page of it: a struct ``id, metric, values`` (``t, v`` each); values without ``v`` are not for results."""
    return _encode_result(result)


def decoded_result(body: Column) -> Column:
    return _decode_result(body)
