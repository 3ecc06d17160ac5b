"""Typed, ordered, mutable tables on Spark DataFrames."""

from rowloom.errors import EngineError
from rowloom.operators.query import Query
from rowloom.operators.table import Table, from_rows, table
from rowloom.plans.filters import UNSET
from rowloom.schema import column

__all__ = ["UNSET", "EngineError", "Query", "Table", "column", "from_rows", "table"]
