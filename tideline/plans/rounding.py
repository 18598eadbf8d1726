"""Numbers to so many significant digits, in both engines: sums depend on their order by less."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(column: str, n: int) -> Column:
    """The column to ``n`` significant digits; 0, NULL, NaN and infinite values as they are."""
    scale = f"pow(10D, floor(log10(abs({column}))))"
    return F.expr(f"CASE WHEN abs({column}) < double('infinity') AND {column} <> 0 THEN round({column} / {scale}, {n - 1}) * {scale} ELSE {column} END")


def digits_sql(expression: str, n: int) -> str:
    """The same for the other engine, NaN as NULL."""
    scale = f"pow(10, floor(log10(abs({expression}))))"
    return f"CASE WHEN isfinite({expression}) AND {expression} <> 0 THEN round({expression} / {scale}, {n - 1}) * {scale} WHEN NOT isnan({expression}) THEN {expression} END"
