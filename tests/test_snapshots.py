import json
import struct

import pytest

from rowloom import Table, column
from rowloom.sources import snapshot
from tests.helpers import fails, make, shipments

ALL = {
    "a": column.int16(), "b": column.int32(), "c": column.uint8(), "d": column.uint16(), "e": column.uint32(),
    "f": column.float32(), "g": column.float64(), "h": column.boolean(), "i": column.dictionary(["ä", "b"]),
}
ROW = {"a": -123, "b": -123456, "c": 255, "d": 65535, "e": 4_000_000_000, "f": 1.5, "g": 3.141592653589793, "h": True, "i": "b"}


def test_roundtrip(spark):
    rows = [ROW, ROW | {"h": False, "i": "ä", "a": 5}]
    t = Table(spark, ALL, 3).insert_many(rows)
    back = Table.deserialize(spark, t.serialize())
    assert back.to_array() == rows and back.capacity == 3 and back.schema == ALL
    back.insert(ROW)
    assert back.row_count == 3 and back.get(2) == ROW
    assert Table.deserialize(spark, make(spark, []).serialize()).is_empty()


def test_layout(spark):
    """Bytes put together by hand."""
    t = Table(spark, {"x": column.uint16(), "y": column.boolean(), "z": column.dictionary(["p", "q"])}, 4)
    t.insert_many([{"x": 513, "y": True, "z": "q"}, {"x": 2, "y": False, "z": "p"}, {"x": 3, "y": True, "z": "q"}])
    data = t.serialize()
    size = struct.unpack("<I", data[8:12])[0]
    head = json.loads(data[12 : 12 + size])
    assert data[:8] == snapshot.MAGIC and list(head) == ["version", "rowCount", "capacity", "columns"]
    assert list(head["columns"][0]) == ["name", "kind", "type", "byteLength", "alignment", "byteOffset"]
    x, y, z = (c["byteOffset"] for c in head["columns"])
    assert x % 2 == 0 and x - (12 + size) in (0, 1) and (y, z) == (x + 8, x + 9) and len(data) == z + 4
    assert data[x:] == bytes([1, 2, 2, 0, 3, 0, 0, 0, 0b101, 1, 0, 1, 0])


def broken(data: bytes, change) -> bytes:
    size = struct.unpack("<I", data[8:12])[0]
    head = json.loads(data[12 : 12 + size])
    change(head)
    text = json.dumps(head, separators=(",", ":")).encode().ljust(size)
    return data[:8] + struct.pack("<I", len(text)) + text + data[12 + size :]


@pytest.fixture(scope="module")
def data(spark):
    return make(spark, shipments(3)).serialize()


@pytest.mark.parametrize(
    "change",
    [
        lambda h: h.update(version=2),
        lambda h: h.update(version="1"),
        lambda h: h.update(rowCount=-1),
        lambda h: h.update(rowCount=99999),
        lambda h: h.update(capacity=0),
        lambda h: h.update(columns=[]),
        lambda h: h.update(indexes=[]),
        lambda h: h["columns"][0].update(name=""),
        lambda h: h["columns"][1].update(name="id"),
        lambda h: h["columns"][0].update(type="int99"),
        lambda h: h["columns"][0].update(kind="text"),
        lambda h: h["columns"][0].update(byteLength=3),
        lambda h: h["columns"][0].update(alignment=2),
        lambda h: h["columns"][0].update(byteOffset=2),
        lambda h: h["columns"][0].update(byteOffset=4_000_000),
        lambda h: h["columns"][2].update(byteOffset=h["columns"][0]["byteOffset"]),
        lambda h: h["columns"][3].update(values=[]),
        lambda h: h["columns"][3].update(values=["a", "a", "b"]),
    ],
)
def test_rejections(spark, data, change):
    fails("INVALID_SERIALIZED_DATA", lambda: Table.deserialize(spark, broken(data, change)))


def test_rejected_bytes(spark, data):
    size = struct.unpack("<I", data[8:12])[0]
    for bad in ("text", b"", b"x" * 12, b"OTHER003" + data[8:], data[:8] + struct.pack("<I", 10**9) + data[12:], data[:12] + b"{" * size + data[12 + size :], data[:-2000]):
        fails("INVALID_SERIALIZED_DATA", lambda bad=bad: Table.deserialize(spark, bad))
    at = json.loads(data[12 : 12 + size])["columns"][3]["byteOffset"]
    fails("INVALID_SERIALIZED_DATA", lambda: Table.deserialize(spark, data[:at] + b"\x09" + data[at + 1 :]))
    other = make(spark, shipments(3)).serialize(magic=b"OTHER003")
    assert Table.deserialize(spark, other, magic=b"OTHER003").to_array() == shipments(3)


def test_float32_overflow_is_stored_but_not_restored(spark):
    t = Table.from_rows(spark, {"x": column.float32()}, [{"x": 1e300}])
    assert t.first()["x"] == float("inf")
    fails("INVALID_SERIALIZED_DATA", lambda: Table.deserialize(spark, t.serialize()))


def test_dictionary_widths(spark):
    for n, width in ((2, 1), (256, 2), (70_000, 4)):
        c = column.dictionary([f"v{i}" for i in range(n)])
        t = Table(spark, {"x": c}, 2).insert({"x": f"v{n - 1}"})
        data = t.serialize()
        size = struct.unpack("<I", data[8:12])[0]
        assert json.loads(data[12 : 12 + size])["columns"][0]["byteLength"] == 2 * width
        assert Table.deserialize(spark, data).first() == {"x": f"v{n - 1}"}
