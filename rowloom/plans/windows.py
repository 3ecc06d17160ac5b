"""Offsets and limits as ranges of places, so that no task holds all rows before them."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.schema import POS

#: Up to this many rows a sorted take is cheaper than counting first.
TAKEN_ROWS = 10_000
#: Rows of a block of places, at least, and about how many blocks there are at most, as powers of two.
BLOCK_BITS, MOST_BLOCKS_BITS = 16, 20


class Blocks(NamedTuple):
    """Number of rows before each block of 2**bits places, in order; blocks without rows are left out."""

    bits: int
    blocks: np.ndarray
    before: np.ndarray

    @property
    def rows(self) -> int:
        return int(self.before[-1])

    def span(self, at: int) -> tuple[int, int]:
        """First place of the block and of the next one."""
        first = int(self.blocks[at]) << self.bits
        return first, first + (1 << self.bits)


def count_blocks(df: DataFrame, rows: int) -> Blocks:
    """One aggregation; what comes to the driver is a number for each block."""
    bits = max(BLOCK_BITS, rows.bit_length() - MOST_BLOCKS_BITS)
    found = df.groupBy(F.shiftright(F.col(POS), bits).alias("block")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    block, n = found["block"].to_numpy().astype(np.int64), found["n"].to_numpy().astype(np.int64)
    order = np.argsort(block)
    return Blocks(bits, block[order], np.concatenate([[0], np.cumsum(n[order])]))


def nth_place(df: DataFrame, blocks: Blocks, i: int) -> int | None:
    """Place of the i-th row (from 0), read from the one block that holds it; None beyond the last."""
    if i >= blocks.rows:
        return None
    at = int(np.searchsorted(blocks.before, i, side="right")) - 1
    first, after = blocks.span(at)
    rows = df.filter((F.col(POS) >= first) & (F.col(POS) < after)).select(POS)
    return rows.orderBy(POS).offset(i - int(blocks.before[at])).limit(1).collect()[0][0]


def window(df: DataFrame, rows: int, offset: int, limit: int | None) -> DataFrame:
    """The rows of ``df`` in the window, in no order; ``rows`` is about how many there are."""
    blocks = count_blocks(df, rows)
    first = nth_place(df, blocks, offset)
    if first is None:
        return df.limit(0)
    after = None if limit is None else nth_place(df, blocks, offset + limit)
    out = df.filter(F.col(POS) >= first)
    return out if after is None else out.filter(F.col(POS) < after)
