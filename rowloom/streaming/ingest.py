"""Structured Streaming into a table: each micro-batch is one all-or-nothing insert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rowloom.operators.table import Table


def insert_stream(table: Table, stream: DataFrame, order_by: list[str], checkpoint: str, **trigger) -> StreamingQuery:
    """Insert the rows of a stream in the order of some columns; a batch that comes again is not inserted twice.

    The table knows the last batch of each checkpoint it has taken in, and
    ``save`` and ``load`` keep that, so a restarted stream goes on where the
    table's rows end.
    """

    def insert(batch: DataFrame, number: int) -> None:
        if number > table.batches.get(checkpoint, -1):
            if not batch.isEmpty():
                table.insert_frame(batch, order_by)
            table.batches[checkpoint] = number

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
