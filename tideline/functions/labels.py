"""Label sets as Column expressions. A label set is a ``MAP<STRING,STRING>``; its identity and order is its key.

All functions take and give Columns and run inside generated code; none needs a UDF.
"""

from __future__ import annotations

import random
import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def random_labels(n: int, seed: int) -> dict[str, str]:
    """A label set of up to ``n`` random names, the last value of a repeated one counts; the same for the same seed."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices(string.ascii_lowercase, k=rnd.randint(1, 25)))
    return dict(sorted({word(): word() for _ in range(n)}.items()))


def label_key(labels: Column) -> Column:
    """The label set as entries in byte order of names: equal sets have equal keys, and keys compare as label sets do."""
    return F.array_sort(F.map_entries(labels))


def from_key(key: Column) -> Column:
    """The map of a key; of a repeated name the first entry counts."""
    names = F.transform(key, lambda e: e["key"])
    first = F.filter(key, lambda e, i: F.array_position(names, e["key"]) == i + 1)
    return F.map_from_entries(first)


def from_flat(flat: Column) -> Column:
    """Labels of a flat list ``n1, v1, n2, v2, ...``; a list of odd length gives none, the first of a repeated name counts."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(flat) / 2 - 1, F.lit(0)).cast("int")), lambda i: F.struct(F.get(flat, i * 2).alias("key"), F.get(flat, i * 2 + 1).alias("value")))
    none = F.filter(pairs, lambda e: F.lit(False))
    return from_key(F.when((F.size(flat) % 2 == 0) & (F.size(flat) > 0), pairs).otherwise(none))


def add(labels: Column, name: str, value: Column | str) -> Column:
    """``labels`` with ``name`` added, unless it is there already."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.when(F.map_contains_key(labels, name), labels).otherwise(F.map_concat(labels, F.create_map(F.lit(name), value)))


def drop(labels: Column, name: str) -> Column:
    return F.map_filter(labels, lambda k, _: k != name)


def only(labels: Column, names: Sequence[str]) -> Column:
    """The labels of the given names: what series are grouped *by*."""
    return F.map_filter(labels, lambda k, _: k.isin(list(names)))


def without(labels: Column, names: Sequence[str]) -> Column:
    """The labels but for the given names and the metric name."""
    return F.map_filter(labels, lambda k, _: ~k.isin([*names, "__name__"]))


def text(labels: Column) -> Column:
    """``{a=b,c=d}`` in order of names."""
    pairs = F.transform(label_key(labels), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def identity(labels: Column) -> Column:
    """A 64-bit hash of the label set, for spreading work; never the identity itself."""
    return F.xxhash64(label_key(labels))


def group_identity(sets: Column) -> Column:
    """A 64-bit hash over an array of label sets."""
    return F.xxhash64(F.transform(sets, label_key))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as ``a`` comes before, with or after ``b``: names and values pairwise, then the shorter set first."""
    x, y = label_key(a), label_key(b)
    return F.when(x < y, -1).when(x == y, 0).otherwise(1)


def merged(group: Column, member: Column) -> Column:
    """The labels of a group member: the group's and its own; of a shared name its own counts."""
    return F.map_concat(F.map_filter(group, lambda k, _: ~F.map_contains_key(member, k)), member)


def merged_key(group: Column, member: Column) -> Column:
    """As :func:`merged`, but as entries, with both values of a shared name, the group's first."""
    return F.concat(label_key(group), label_key(member))
