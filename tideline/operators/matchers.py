"""Label matchers as predicates on a series' label map.

A matcher is anything with ``column(labels) -> Column``; plain callables of that kind are accepted too. An equality
on a non-empty value needs the label to be there. A matcher that accepts the empty string also accepts
series without the label, because a missing label reads as ``""``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.sql import Column
from pyspark.sql import functions as F


def _value(labels: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(labels, F.lit(name)), F.lit(""))


@dataclass(frozen=True)
class Eq:
    """The value of ``name`` is ``value``, byte for byte."""

    name: str
    value: str

    def column(self, labels: Column) -> Column:
        return _value(labels, self.name) == self.value


def valid_pattern(pattern: str) -> bool:
    """Whether the pattern can be compiled here and by the engine; Java's compiler decides where one is running."""
    from pyspark import SparkContext
    from pyspark.errors import PySparkException

    if SparkContext._active_spark_context is not None:
        try:
            SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
            return True
        except (PySparkException, Py4JError):
            return False
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


@dataclass(frozen=True)
class Re:
    """The whole value of ``name`` matches ``pattern``. An invalid pattern matches nothing."""

    name: str
    pattern: str

    def column(self, labels: Column) -> Column:
        if not valid_pattern(self.pattern):
            return F.lit(False)
        return _value(labels, self.name).rlike(rf"\A(?:{self.pattern})\z")


@dataclass(frozen=True)
class Not:
    """The inner matcher does not match; so a missing label passes unless the inner one accepts ``""``."""

    inner: Eq | Re

    def column(self, labels: Column) -> Column:
        return ~self.inner.column(labels)


Matcher = Eq | Re | Not | Callable[[Column], Column]


def predicate(matcher: Matcher, labels: Column) -> Column:
    return matcher.column(labels) if hasattr(matcher, "column") else matcher(labels)


def conjunction(matchers: Iterable[Matcher], labels: Column) -> Column:
    """All matchers together. None at all is an error: selecting everything must be asked for by ``select_all``."""
    columns = [predicate(m, labels) for m in matchers]
    if not columns:
        raise ValueError("a selection needs at least one matcher")
    return reduce(lambda a, b: a & b, columns)


def member_conjunction(matchers: Iterable[Matcher], group: Column, member: Column) -> Column:
    """A group member is selected if each matcher holds for the group's labels or for its own."""
    columns = [predicate(m, group) | predicate(m, member) for m in matchers]
    if not columns:
        raise ValueError("a selection needs at least one matcher")
    return reduce(lambda a, b: a & b, columns)
