"""A list-of-dicts oracle, generators and small helpers of the engine's tests."""

from __future__ import annotations

import pytest

from rowloom import EngineError, Table, column

OPS = {
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "in": lambda a, b: a in b,
    "not in": lambda a, b: a not in b,
}

SHIPMENTS = {"id": column.uint32(), "weight": column.uint8(), "price": column.uint32(), "zone": column.dictionary(["north", "south", "west"]), "paid": column.boolean()}


def shipments(n: int) -> list[dict]:
    """Rows drawn from a seed: tied prices, weights and prices at the ends of their ranges, uneven zones."""
    rng, rows = Lcg(0x51A7), []
    for i in range(n):
        weight = [0, 255][rng.below(2)] if rng.below(12) == 0 else 3 + rng.below(92)
        price = rows[rng.below(i)]["price"] if i and rng.below(4) == 0 else [0, (1 << 32) - 1][rng.below(2)] if rng.below(20) == 0 else rng.below(900)
        zone = SHIPMENTS["zone"].values[[0, 0, 0, 1, 1, 2][rng.below(6)]]
        rows.append({"id": i, "weight": weight, "price": price, "zone": zone, "paid": rng.below(5) > 1})
    return rows


def make(spark, rows=None, schema=None, **options) -> Table:
    return Table.from_rows(spark, schema or SHIPMENTS, shipments(80) if rows is None else rows, **options)


class Lcg:
    """x = (1664525 x + 1013904223) mod 2**32."""

    def __init__(self, seed: int) -> None:
        self.state = seed

    def next(self) -> float:
        self.state = (self.state * 1664525 + 1013904223) % (1 << 32)
        return self.state / (1 << 32)

    def below(self, n: int) -> int:
        return int(self.next() * n)


def fails(suffix: str, call) -> EngineError:
    with pytest.raises(EngineError) as e:
        call()
    assert e.value.code == f"ROWLOOM_{suffix}", e.value.code
    return e.value
