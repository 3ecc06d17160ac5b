"""Binary snapshots: magic, header length, JSON header, aligned column payloads.

Layout: 8 bytes of magic, the header's length as an unsigned 32-bit little-endian
number, the header, then each column's payload at its offset.  Payloads are
sized by the table's capacity and padded with zeros; booleans are bits, least
significant first; dictionary columns are codes of 1, 2 or 4 bytes.  A writer of
the same layout with another magic is read and written through ``magic``.
"""

from __future__ import annotations

import json
import math
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rowloom.errors import EngineError
from rowloom.schema import FLOATS, INTEGERS, Column, Schema

MAGIC = b"ROWLM003"
PREFIX, VERSION = 12, 1


def _code_type(values: int) -> str:
    return "|u1" if values <= 255 else "<u2" if values <= 65_535 else "<u4"


def _array_type(c: Column) -> str:
    if c.kind == "dictionary":
        return _code_type(len(c.values))
    return INTEGERS[c.type][3] if c.type in INTEGERS else FLOATS[c.type][1]


def _payload(c: Column, data: pa.ChunkedArray, capacity: int) -> bytes:
    if c.kind == "boolean":
        bits = np.zeros(-(-capacity // 8) * 8, bool)
        bits[: len(data)] = data.to_numpy()
        return np.packbits(bits, bitorder="little").tobytes()
    out = np.zeros(capacity, _array_type(c))
    if c.kind == "dictionary":
        out[: len(data)] = pc.index_in(data, pa.array(c.values)).to_numpy()
    else:
        out[: len(data)] = data.to_numpy()
    return out.tobytes()


def _aligned(at: int, by: int) -> int:
    return -(-at // by) * by


def encode(schema: Schema, rows: pa.Table, capacity: int, magic: bytes = MAGIC) -> bytes:


    columns, payloads = [], []
    for name, c in schema.items():
        data = _payload(c, rows[name], capacity)
        detail = {"type": c.type} if c.kind == "numeric" else {"values": list(c.values)} if c.kind == "dictionary" else {}
        align = 1 if c.kind == "boolean" else np.dtype(_array_type(c)).itemsize
        columns.append({"name": name, "kind": c.kind, **detail, "byteLength": len(data), "alignment": align, "byteOffset": 0})
        payloads.append(data)
    while True:
        # Offsets are part of the header, and its length moves them.
        head = json.dumps({"version": VERSION, "rowCount": rows.num_rows, "capacity": capacity, "columns": columns}, separators=(",", ":"), ensure_ascii=False).encode()
        at = PREFIX + len(head)
        placed = []
        for c in columns:
            at = _aligned(at, c["alignment"])
            placed.append(c | {"byteOffset": at})
            at += c["byteLength"]
        if placed == columns:
            break
        columns = placed
    out = bytearray(max([PREFIX + len(head), *(c["byteOffset"] + c["byteLength"] for c in columns)]))
    out[:8], out[8:12], out[12 : 12 + len(head)] = magic, len(head).to_bytes(4, "little"), head
    for c, data in zip(columns, payloads, strict=True):
        out[c["byteOffset"] : c["byteOffset"] + len(data)] = data
    return bytes(out)


def _fail(message: str) -> EngineError:
    return EngineError("INVALID_SERIALIZED_DATA", message)


def _whole(value: Any, least: int = 0) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and value == int(value) and value >= least


def _header(data: bytes, magic: bytes) -> tuple[dict[str, Any], int]:
    if len(data) < PREFIX:
        raise _fail("The data is too short.")
    if data[:8] != magic:
        raise _fail("The data does not start as a snapshot does.")
    size = int.from_bytes(data[8:12], "little")
    if PREFIX + size > len(data):
        raise _fail("The header is longer than the data.")
    try:
        head = json.loads(data[PREFIX : PREFIX + size].decode())
    except ValueError as e:
        raise _fail("The header is not JSON.") from e
    if not isinstance(head, dict):
        raise _fail("The header is not an object.")
    if "indexes" in head:
        raise _fail("Snapshots hold no indexes.")
    if not _whole(head.get("version")) or head["version"] != VERSION:
        raise _fail(f"Version {head.get('version')!r} is not known.")
    if not _whole(head.get("rowCount")):
        raise _fail("rowCount is not a count.")
    if not _whole(head.get("capacity"), 1):
        raise _fail("capacity is not a positive count.")
    if head["rowCount"] > head["capacity"]:
        raise _fail("There are more rows than the capacity.")
    if not isinstance(head.get("columns"), list) or not head["columns"]:
        raise _fail("There are no columns.")
    return head, PREFIX + size


def _definition(meta: Any) -> Column:
    if meta.get("kind") == "boolean":
        return Column("boolean")
    if meta.get("kind") == "numeric":
        if meta.get("type") not in INTEGERS and meta.get("type") not in FLOATS:
            raise _fail(f"Numeric type {meta.get('type')!r} is not known.")
        return Column("numeric", meta["type"])
    if meta.get("kind") == "dictionary":
        values = meta.get("values")
        if not isinstance(values, list) or not values or any(not isinstance(v, str) for v in values) or len(set(values)) < len(values):
            raise _fail("Dictionary values are distinct strings, at least one.")
        return Column("dictionary", values=tuple(values))
    raise _fail(f"Column kind {meta.get('kind')!r} is not known.")


def decode(data: Any, magic: bytes = MAGIC) -> tuple[Schema, pa.Table, int]:
    """Schema, rows and capacity of a snapshot; anything unsound is rejected."""
    if not isinstance(data, (bytes, bytearray, memoryview)):
        raise _fail("A snapshot is bytes.")
    data = bytes(data)
    head, begin = _header(data, magic)
    rows, capacity = int(head["rowCount"]), int(head["capacity"])
    schema: Schema = {}
    arrays, spans = [], []
    for meta in head["columns"]:
        if not isinstance(meta, dict) or not isinstance(meta.get("name"), str) or not meta["name"] or meta["name"] in schema:
            raise _fail("Column names are distinct non-empty strings.")
        name, c = meta["name"], _definition(meta)
        align = 1 if c.kind == "boolean" else np.dtype(_array_type(c)).itemsize
        size = -(-capacity // 8) if c.kind == "boolean" else capacity * align
        if not _whole(meta.get("byteLength")) or meta["byteLength"] != size:
            raise _fail(f'Column "{name}": byteLength does not fit.')
        if not _whole(meta.get("alignment"), 1) or meta["alignment"] != align:
            raise _fail(f'Column "{name}": alignment does not fit.')
        if not _whole(meta.get("byteOffset")) or meta["byteOffset"] < begin or meta["byteOffset"] % align:
            raise _fail(f'Column "{name}": byteOffset does not fit.')
        at = int(meta["byteOffset"])
        if at + size > len(data):
            raise _fail(f'Column "{name}" is longer than the data.')
        spans.append((at, at + size))
        schema[name] = c
        arrays.append(_restored(name, c, data[at : at + size], rows))
    spans.sort()
    if any(b[0] < a[1] for a, b in zip(spans, spans[1:])):
        raise _fail("Payloads overlap.")
    return schema, pa.table(arrays, list(schema)), capacity


def _restored(name: str, c: Column, data: bytes, rows: int) -> pa.Array:
    if c.kind == "boolean":
        return pa.array(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:rows].astype(bool))
    values = np.frombuffer(data, _array_type(c))[:rows]
    if c.kind == "dictionary":
        if rows and int(values.max()) >= len(c.values):
            raise _fail(f'Column "{name}" has a code without a value.')
        return pa.array(c.values, pa.string()).take(pa.array(values))
    if c.type in FLOATS and not np.isfinite(values).all():
        raise _fail(f'Column "{name}": failed to restore column, a number is not finite.')
    return pa.array(values)
