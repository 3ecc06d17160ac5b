"""Structured predicates: validation, object syntax, and Spark columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from rowloom.errors import EngineError
from rowloom.schema import Schema, check_column, col

EQUALITY, RANGES, LISTS = ("=", "!="), (">", ">=", "<", "<="), ("in", "not in")
#: Names of the conditions of an object predicate.
CONDITIONS = {"eq": "=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "in": "in"}
#: Order in which predicates are listed by a plan.
COST = {"=": 0, "!=": 1, ">": 2, ">=": 2, "<": 2, "<=": 2, "in": 3, "not in": 4}


class _Unset:
    """Marks a condition of an object predicate as absent."""

    def __repr__(self) -> str:
        return "UNSET"


UNSET = _Unset()


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any

    def to_column(self) -> SparkColumn:
        """Literals stay as they are: a float32 column is compared as a double."""
        c = col(self.column)
        if self.op == "in":
            return c.isin(list(self.value))
        if self.op == "not in":
            return ~c.isin(list(self.value))
        lit = F.lit(self.value)
        return {"=": c == lit, "!=": c != lit, ">": c > lit, ">=": c >= lit, "<": c < lit, "<=": c <= lit}[self.op]


def make_filter(schema: Schema, name: Any, op: Any, value: Any) -> Filter:
    """Checks the column, the operator, whether the column has it, the shape, then each value."""
    c = check_column(schema, name, "where")
    if op not in COST:
        raise EngineError("INVALID_OPERATOR", f"No operator {op!r}.")
    if op in RANGES and c.kind != "numeric":
        raise EngineError("INVALID_OPERATOR", f'Operator {op} needs a numeric column, "{name}" is not.')
    if op in LISTS:
        if not isinstance(value, (list, tuple, set, frozenset)) or not value:
            raise EngineError("TYPE_MISMATCH", f"Operator {op} takes a non-empty list.")
        return Filter(name, op, tuple(c.check(v, name) for v in value))
    if isinstance(value, (list, tuple, set, frozenset)):
        raise EngineError("TYPE_MISMATCH", f"Operator {op} expects a single value.")
    return Filter(name, op, c.check(value, name))


def object_filters(schema: Schema, predicate: Any) -> list[Filter]:
    """Filters of {column: value} or {column: {condition: value, ...}}."""
    if not isinstance(predicate, dict) or not predicate:
        raise EngineError("INVALID_PREDICATE", "An object predicate has at least one condition.")
    out: list[Filter] = []
    for name, condition in predicate.items():
        c = check_column(schema, name, "where")
        if condition is UNSET:
            continue
        if not isinstance(condition, dict):
            out.append(make_filter(schema, name, "=", condition))
            continue
        if not condition:
            raise EngineError("INVALID_PREDICATE", f'Column "{name}" has an empty condition.')
        for key in condition:
            if key not in CONDITIONS:
                raise EngineError("INVALID_PREDICATE", f"No condition {key!r}.")
            if CONDITIONS[key] in RANGES and c.kind != "numeric" and condition[key] is not UNSET:
                raise EngineError("INVALID_PREDICATE", f'Condition {key} needs a numeric column, "{name}" is not.')
        out += [make_filter(schema, name, CONDITIONS[k], v) for k, v in condition.items() if v is not UNSET]
    if not out:
        raise EngineError("INVALID_PREDICATE", "An object predicate has at least one condition.")
    return out


def by_cost(filters: tuple[Filter, ...]) -> list[Filter]:
    return sorted(filters, key=lambda f: COST[f.op])


def conjunction(filters: tuple[Filter, ...]) -> SparkColumn | None:
    return reduce(lambda a, b: a & b, [f.to_column() for f in filters]) if filters else None
