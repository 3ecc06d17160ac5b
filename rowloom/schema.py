"""Logical column types, their validation, and the Spark types that store them."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.errors import EngineError

#: Hidden column: the place of a row in its table.
POS = "__pos"

#: Integer types: least and greatest value, Spark type, numpy type of a snapshot.
INTEGERS: dict[str, tuple[int, int, T.DataType, str]] = {
    "int16": (-(1 << 15), (1 << 15) - 1, T.ShortType(), "<i2"),
    "int32": (-(1 << 31), (1 << 31) - 1, T.IntegerType(), "<i4"),
    "uint8": (0, (1 << 8) - 1, T.ShortType(), "|u1"),
    "uint16": (0, (1 << 16) - 1, T.IntegerType(), "<u2"),
    "uint32": (0, (1 << 32) - 1, T.LongType(), "<u4"),
}
FLOATS: dict[str, tuple[T.DataType, str]] = {"float32": (T.FloatType(), "<f4"), "float64": (T.DoubleType(), "<f8")}


@dataclass(frozen=True)
class Column:
    """Definition of a column: kind numeric, boolean or dictionary."""

    kind: str
    type: str = ""
    values: tuple[str, ...] = ()

    @property
    def spark_type(self) -> T.DataType:
        if self.kind == "dictionary":
            return T.StringType()
        if self.kind == "boolean":
            return T.BooleanType()
        return INTEGERS[self.type][2] if self.type in INTEGERS else FLOATS[self.type][0]

    @property
    def is_integer(self) -> bool:
        return self.kind == "numeric" and self.type in INTEGERS

    def check(self, value: Any, name: str) -> Any:
        """The value as it is stored, or an error."""
        if self.kind == "boolean":
            if not isinstance(value, bool):
                raise EngineError("TYPE_MISMATCH", f'Column "{name}" takes a boolean, not {value!r}.')
            return value
        if self.kind == "dictionary":
            if not isinstance(value, str) or value not in self.values:
                raise EngineError("UNKNOWN_VALUE", f'Column "{name}" has no value {value!r}.', {"column": name})
            return value
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
            raise EngineError("TYPE_MISMATCH", f'Column "{name}" takes a finite number, not {value!r}.')
        if self.type in FLOATS:
            return float(value)
        if value != int(value):
            raise EngineError("TYPE_MISMATCH", f'Column "{name}" takes an integer, not {value!r}.')
        least, most = INTEGERS[self.type][:2]
        if not least <= value <= most:
            raise EngineError("OUT_OF_RANGE", f'Column "{name}" takes {least} to {most}, not {value!r}.')
        return int(value)


class _Columns:
    """Constructors of column definitions."""

    def __getattr__(self, name: str):
        alias = {"smallint": "int16", "integer": "int32", "real": "float32", "doublePrecision": "float64", "double_precision": "float64"}.get(name, name)
        if alias in INTEGERS or alias in FLOATS:
            return lambda: Column("numeric", alias)
        raise AttributeError(name)

    def boolean(self) -> Column:
        return Column("boolean")

    def dictionary(self, values: list[str] | tuple[str, ...]) -> Column:
        if not isinstance(values, (list, tuple)) or not values:
            raise EngineError("INVALID_SCHEMA", "A dictionary column needs at least one value.")
        if any(not isinstance(v, str) for v in values):
            raise EngineError("INVALID_SCHEMA", "Dictionary values are strings.")
        if len(set(values)) < len(values):
            raise EngineError("DUPLICATE_COLUMN", "Dictionary values are distinct.")
        return Column("dictionary", values=tuple(values))


column = _Columns()
Schema = dict[str, Column]


def quoted(name: str) -> str:
    """A column's name as Spark reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> SparkColumn:
    """The column of that name."""
    return F.col(quoted(name))


def check_schema(schema: Any) -> Schema:
    """A schema as a dict.  Spark finds columns without regard to case, so names that differ in case only are refused."""
    if not isinstance(schema, dict) or not schema:
        raise EngineError("INVALID_SCHEMA", "A schema maps at least one name to a column.")
    folded: set[str] = set()
    for name, c in schema.items():
        if not isinstance(name, str) or not name or name == POS:
            raise EngineError("INVALID_COLUMN", f"A column name is a non-empty string other than {POS}.")
        if name.lower() in folded or name.lower() == POS:
            raise EngineError("INVALID_COLUMN", f"Column {name!r} differs from another in case only.", {"column": name})
        folded.add(name.lower())
        if not isinstance(c, Column) or c.kind not in ("numeric", "boolean", "dictionary"):
            raise EngineError("INVALID_COLUMN_TYPE", f'Column "{name}" is not a column definition.')
        if c.kind == "numeric" and c.type not in INTEGERS and c.type not in FLOATS:
            raise EngineError("INVALID_COLUMN_TYPE", f'Column "{name}" has an unknown numeric type.')
    return dict(schema)


def check_column(schema: Schema, name: Any, where: str) -> Column:
    if not isinstance(name, str) or name not in schema:
        raise EngineError("INVALID_COLUMN", f"{where}: no column {name!r}.", {"column": name})
    return schema[name]


def check_numeric(schema: Schema, name: Any, where: str) -> Column:
    c = check_column(schema, name, where)
    if c.kind != "numeric":
        raise EngineError("INVALID_COLUMN_TYPE", f'{where}: column "{name}" is not numeric.')
    return c


def check_count(n: Any, suffix: str, least: int = 0) -> int:
    if isinstance(n, bool) or not isinstance(n, (int, float)) or not math.isfinite(n) or n != int(n) or n < least:
        raise EngineError(suffix, f"Expected an integer from {least} on, not {n!r}.")
    return int(n)


def check_row_index(i: Any, rows: int) -> int:
    if isinstance(i, bool) or not isinstance(i, (int, float)) or not math.isfinite(i) or i != int(i) or not 0 <= i < rows:
        raise EngineError("INVALID_ROW_INDEX", f"Row index {i!r} is not among {rows} rows.")
    return int(i)


def check_row(schema: Schema, row: Any) -> dict[str, Any]:
    """A full row: shape, missing columns, unknown columns, then values."""
    if not isinstance(row, dict):
        raise EngineError("TYPE_MISMATCH", "A row is a dict.")
    for name in schema:
        if name not in row:
            raise EngineError("MISSING_VALUE", f'Column "{name}" has no value.', {"column": name})
    for name in row:
        check_column(schema, name, "row")
    return {name: c.check(row[name], name) for name, c in schema.items()}


def check_patch(schema: Schema, patch: Any) -> dict[str, Any]:
    """The changed columns of an update; at least one."""
    if not isinstance(patch, dict):
        raise EngineError("TYPE_MISMATCH", "An update is a dict.")
    if not patch:
        raise EngineError("MISSING_VALUE", "An update changes at least one column.")
    for name in patch:
        check_column(schema, name, "update")
    return {name: schema[name].check(value, name) for name, value in patch.items()}


def spark_schema(schema: Schema) -> T.StructType:
    """Fields in order of declaration, and the hidden place; the logical type is in the metadata."""
    fields = [T.StructField(n, c.spark_type, False, {"lt": c.type or c.kind, "dict": list(c.values)}) for n, c in schema.items()]
    return T.StructType([*fields, T.StructField(POS, T.LongType(), False)])
