"""Callback predicates, evaluated batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from rowloom.schema import POS, col


def passing(df: DataFrame, callbacks: tuple[Callable[[dict], object], ...]) -> DataFrame:
    """The rows that all callbacks accept, called in their order, the later ones only for rows that pass the earlier.

    Rows come as Arrow batches and leave as they came, so only the callbacks see
    Python values.  Every callback gets a dict of its own.
    """
    names, kinds = df.columns, df.schema
    # Spark takes this function's columns by plain names only.
    plain = df.select(*(col(n).alias(f"c{i}") for i, n in enumerate(names)))
    seen = [i for i, n in enumerate(names) if n != POS]

    def accepts(values: tuple) -> bool:
        return all(f({names[i]: v for i, v in zip(seen, values, strict=True)}) for f in callbacks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in seen), strict=True)
            yield batch.filter(pa.array(map(accepts, rows), pa.bool_()))

    kept = plain.mapInArrow(run, plain.schema)
    return kept.select(*(col(f"c{i}").alias(f.name, metadata=f.metadata) for i, f in enumerate(kinds)))
