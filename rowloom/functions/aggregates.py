"""Aggregates of a numeric column, with the engine's results for no rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.schema import Column as Definition
from rowloom.schema import col


def sum_of(name: str, c: Definition) -> Column:
    """0 for no rows.  Integers are exact; floats add up as doubles, in no fixed order."""
    return F.coalesce(F.sum(col(name).cast("long")), F.lit(0)) if c.is_integer else F.coalesce(F.sum(col(name).cast("double")), F.lit(0.0))


def avg_of(name: str) -> Column:
    return F.avg(col(name).cast("double"))


AGGREGATES = {"sum": sum_of, "avg": lambda n, c: avg_of(n), "min": lambda n, c: F.min(col(n)), "max": lambda n, c: F.max(col(n)), "count": lambda n, c: F.count(F.lit(1))}
