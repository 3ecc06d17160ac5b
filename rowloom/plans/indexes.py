"""Index registry: life cycle, histograms, statistics and the choice of an index.

An index on Spark is what the planner knows about a column: the distinct values
with their counts, in order.  Explain and the statistics read it from the driver
and start no job.  What the driver holds is bounded: beyond MAX_VALUES distinct
values they lie in the shared folder with their counts, in blocks of neighbours,
and the driver keeps the first value and the totals of each block.  An estimate
then reads the one block that its value falls into, without a job.
"""

from __future__ import annotations

import functools
import io
import uuid
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.errors import EngineError
from rowloom.plans.filters import RANGES, Filter
from rowloom.schema import Schema, check_column, col
from rowloom.sources import versions

#: Distinct values of an index on the driver, and about how many of a block beyond that.
MAX_VALUES, BLOCK_VALUES = 1_000_000, 250_000
#: Inserted values that are kept apart before they join the others.
MOST_APART = 10_000
#: An index is refused when it would leave more than this share of the rows.
LARGEST_SHARE = 0.4
KINDS = ("equality", "sorted", "unique")
_ERROR = {"equality": "INDEX", "sorted": "SORTED_INDEX", "unique": "UNIQUE_INDEX"}


class Blocks:
    """Distinct values in order and their counts, as files of neighbours in the shared folder."""

    def __init__(self, grouped: DataFrame) -> None:
        self._spark = spark = grouped.sparkSession
        self.folder = f"{versions.folder(spark)}/index-{uuid.uuid4().hex}"
        grouped.write.parquet(f"{self.folder}/unordered")
        found = spark.read.schema(grouped.schema).parquet(f"{self.folder}/unordered")
        parts = -(-found.count() // BLOCK_VALUES)
        found.repartitionByRange(parts, "v").sortWithinPartitions("v").write.parquet(f"{self.folder}/blocks")
        self._path(f"{self.folder}/unordered", lambda fs, path: fs.delete(path, True))
        blocks = spark.read.schema(grouped.schema).parquet(f"{self.folder}/blocks").groupBy(F.col("_metadata.file_name").alias("name"))
        rows = sorted(blocks.agg(F.min("v").alias("first"), F.sum("n").alias("n"), F.count("v").alias("distinct")).collect(), key=lambda r: r["first"])
        self.names, self.firsts = [r["name"] for r in rows], [r["first"] for r in rows]
        self.before = np.cumsum([0, *(r["n"] for r in rows)])
        self.distinct = sum(r["distinct"] for r in rows)
        self.block = functools.lru_cache(maxsize=4)(self._block)

    def _path(self, path: str, use) -> Any:
        """Applies ``use`` to the store of a path and the path; no job."""
        context = self._spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        return use(target.getFileSystem(context._jsc.hadoopConfiguration()), target)

    def _block(self, at: int) -> tuple[list, np.ndarray]:
        """Values of a block and the number of its rows before each, and in all."""

        def data(fs, path) -> bytes:
            stream = fs.open(path)
            try:
                return bytes(stream.readAllBytes())
            finally:
                stream.close()

        found = pq.read_table(io.BytesIO(self._path(f"{self.folder}/blocks/{self.names[at]}", data)))
        return found["v"].to_pylist(), np.cumsum([0, *found["n"].to_pylist()])

    def below(self, value: Any, also_equal: bool) -> int:
        """Number of rows with smaller values, or those and equal ones."""
        at = bisect_right(self.firsts, value) - 1
        if at < 0:
            return 0
        values, before = self.block(at)
        return int(self.before[at] + before[(bisect_right if also_equal else bisect_left)(values, value)])

    def count(self, value: Any) -> int:
        return self.below(value, True) - self.below(value, False)


@dataclass
class Index:
    kind: str
    column: str
    state: str = "fresh"
    dirty_reason: str | None = None
    generation: int = 0
    rows: int = 0
    #: Distinct values in order and their counts; beyond MAX_VALUES blocks, without counts here.
    values: list | Blocks | None = field(default_factory=list)
    counts: np.ndarray | None = None
    distinct: int = 0
    stale_results: int = 0
    last_error: str | None = None
    #: Whether the rows are also written in the order of the column; that copy, its folder, and the base it was made of.
    clustered: bool = False
    replica: DataFrame | None = None
    replica_path: str = ""
    epoch: int = -1

    def __post_init__(self) -> None:
        #: Rows by value that were inserted since.
        self._more: Counter = Counter()
        self._before: np.ndarray | None = None
        #: The values as numbers, for a sorted index.
        self._numbers: np.ndarray | None = None

    def install(self, values: list | Blocks | None, counts: np.ndarray | None, rows: int, distinct: int) -> None:
        self.values, self.counts, self.rows, self.distinct = values, counts, rows, distinct
        self.state, self.dirty_reason, self.last_error = "fresh", None, None
        self._more = Counter()
        self._before = np.concatenate([[0], np.cumsum(counts)]) if counts is not None else None
        self._numbers = np.array(values, np.float64) if self.kind == "sorted" and isinstance(values, list) else None

    def mark_dirty(self, reason: str) -> None:
        self.state, self.dirty_reason = "dirty", reason
        self.generation += 1

    def add(self, rows: list[dict]) -> None:
        """Take in inserted rows without a job."""
        self.generation += 1
        self.rows += len(rows)
        if self.values is None:
            return
        new = Counter(row[self.column] for row in rows)
        # In order, so that each block is read once.
        self.distinct += sum(v not in self._more and not self._counted(v) for v in sorted(new))
        self._more += new
        if isinstance(self.values, Blocks):
            if len(self._more) > MAX_VALUES:
                self.mark_dirty("insert")
        elif len(self._more) > MOST_APART:
            found = Counter(dict(zip(self.values, self.counts.tolist(), strict=True))) + self._more
            values = sorted(found)
            self.install(values, np.array([found[v] for v in values], np.int64), self.rows, len(values))

    def _counted(self, value: Any) -> int:
        """Rows with the value, but for those inserted since."""
        if isinstance(self.values, Blocks):
            return self.values.count(value)
        i = bisect_left(self.values, value)
        return int(self.counts[i]) if i < len(self.values) and self.values[i] == value else 0

    def estimate(self, f: Filter) -> int | None:
        """Number of rows that the filter leaves, if this index can tell."""
        if self.values is None or (self._before is None and not isinstance(self.values, Blocks)):
            return None
        if self.kind == "equality" and f.op in ("=", "in"):
            return sum(self._counted(v) + self._more[v] for v in sorted({f.value} if f.op == "=" else set(f.value)))
        if self.kind == "sorted" and f.op in RANGES:
            also_equal = f.op in (">", "<=")
            if isinstance(self.values, Blocks):
                below = self.values.below(f.value, also_equal)
            else:
                below = int(self._before[int(np.searchsorted(self._numbers, f.value, side="right" if also_equal else "left"))])
            return below if f.op in ("<", "<=") else self.rows - below
        return None

    def stats(self) -> dict[str, Any]:
        if self.kind == "equality":
            return {"column": self.column, "uniqueValues": self.distinct, "rowCount": self.rows, "memoryBytesApprox": self.rows * 4 + self.distinct * 32}
        if self.kind == "sorted":
            return {"column": self.column, "rowCount": self.rows, "memoryBytesApprox": self.rows * 4, "dirty": self.state != "fresh"}
        return {"column": self.column, "uniqueValues": self.distinct, "rowCount": self.rows, "memoryBytesApprox": self.rows * 4 + self.distinct * 40}

    def snapshot(self) -> dict[str, Any]:
        out = {"kind": self.kind, "column": self.column, "state": self.state, "generation": self.generation, "queued": self.state == "queued", "rebuilding": self.state == "rebuilding", "staleResultsDiscarded": self.stale_results}
        return out | ({"dirtyReason": self.dirty_reason} if self.dirty_reason else {}) | ({"lastErrorMessage": self.last_error} if self.last_error else {})


def histogram(frame: DataFrame, name: str, rows: int, unique: bool) -> tuple[list | Blocks | None, np.ndarray | None, int, int]:
    """Distinct values with counts: partial aggregation on the executors, at most MAX_VALUES rows here, else blocks."""
    grouped = frame.groupBy(col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    if unique:
        # Keys are checked where they are; only their number comes here.
        twice = grouped.filter("n > 1").orderBy("v").limit(1).collect()
        if twice:
            raise EngineError("DUPLICATE_KEY", f'Column "{name}" has the key {twice[0].v!r} more than once.', {"column": name, "key": twice[0].v, "operation": "rebuildUniqueIndex"})
        return None, None, rows, rows
    found = grouped.limit(MAX_VALUES + 1).toArrow()
    if found.num_rows > MAX_VALUES:
        del found
        blocks = Blocks(grouped)
        return blocks, None, rows, blocks.distinct
    pairs = sorted(zip(found["v"].to_pylist(), found["n"].to_pylist(), strict=True))
    return [v for v, _ in pairs], np.array([n for _, n in pairs], np.int64), rows, len(pairs)


class Registry:
    """The indexes of one table."""

    def __init__(self, schema: Schema) -> None:
        self.schema, self.by_kind = schema, {k: {} for k in KINDS}

    def all(self, *kinds: str) -> list[Index]:
        return [i for k in kinds or KINDS for i in self.by_kind[k].values()]

    def check_new(self, kind: str, name: Any) -> None:
        c = check_column(self.schema, name, f"create {kind} index")
        if kind == "sorted" and c.kind != "numeric":
            raise EngineError("SORTED_INDEX_UNSUPPORTED_COLUMN", f'Column "{name}" is not numeric.')
        if c.kind == "boolean":
            raise EngineError("INDEX_UNSUPPORTED_COLUMN" if kind == "equality" else "UNIQUE_INDEX_UNSUPPORTED", f'Column "{name}" is boolean.')
        if name in self.by_kind[kind]:
            raise EngineError(f"{_ERROR[kind]}_EXISTS", f'Column "{name}" has a {kind} index.')

    def get(self, kind: str, name: Any) -> Index:
        check_column(self.schema, name, f"{kind} index")
        if name not in self.by_kind[kind]:
            raise EngineError(f"{_ERROR[kind]}_NOT_FOUND", f'Column "{name}" has no {kind} index.')
        return self.by_kind[kind][name]

    def after_insert(self, rows: list[dict] | None) -> None:
        """``rows`` None: loaded in bulk, nothing is known of the values."""
        for i in self.all("equality"):
            if rows is None or i.state != "fresh":
                i.mark_dirty("insert") if i.state == "fresh" else None
            else:
                i.add(rows)
        for i in self.all("sorted"):
            i.mark_dirty("insert")
        for i in self.all("unique"):
            if i.state == "fresh":
                n = len(rows) if rows is not None else 0
                i.rows, i.distinct, i.generation = i.rows + n, i.distinct + n, i.generation + 1
                if rows is None:
                    i.mark_dirty("insert")

    def after_update(self, columns) -> None:
        for i in self.all():
            if i.column in columns:
                i.mark_dirty("update")

    def after_delete(self, single: bool) -> None:
        for i in self.all():
            if single and i.kind == "unique" and i.state == "fresh":
                i.rows, i.distinct, i.generation = i.rows - 1, i.distinct - 1, i.generation + 1
            else:
                i.mark_dirty("delete")


def _index_for(registry: Registry, f: Filter) -> Index | None:
    kind = "equality" if f.op in ("=", "in") else "sorted" if f.op in RANGES else None
    return registry.by_kind[kind].get(f.column) if kind else None


def plan(registry: Registry, filters: tuple[Filter, ...], rows: int) -> dict[str, Any]:
    """Which index a query would use: mode, source, column, candidates, state and reason.  No job."""
    if not filters:
        return {"mode": "scan", "reasonCode": "NO_PREDICATES"}
    matching = [(f, i) for f in filters if (i := _index_for(registry, f))]
    for _, i in matching:
        if i.state == "dirty":
            return {"mode": "index", "source": i.kind, "column": i.column, "indexState": "dirty", "fallbackReason": "dirty-index", "reasonCode": "INDEX_DIRTY_WOULD_REBUILD_ON_EXECUTION"}
    best: tuple[int, Index] | None = None
    for f, i in matching:
        n = i.estimate(f) if i.state == "fresh" else None
        if n is not None and (best is None or n < best[0]):
            best = (n, i)
    if best and best[0] > LARGEST_SHARE * rows:
        return {"mode": "scan", "candidateRows": best[0], "reasonCode": "INDEX_CANDIDATE_SET_TOO_LARGE"}
    if best:
        return {"mode": "index", "source": best[1].kind, "column": best[1].column, "candidateRows": best[0], "indexState": "fresh"}
    if any(f.op in ("!=", "not in") for f in filters):
        code = "UNSUPPORTED_INDEX_OPERATOR"
    elif any(f.op in RANGES and f.column not in registry.by_kind["sorted"] for f in filters):
        code = "RANGE_QUERY_WITHOUT_SORTED_INDEX"
    else:
        code = "NO_INDEX_FOR_COLUMN"
    out: dict[str, Any] = {"mode": "scan", "reasonCode": code}
    for _, i in matching:
        if i.state in ("queued", "rebuilding", "failed"):
            return out | {"indexState": i.state, "fallbackReason": f"{i.state}-index", "backgroundRebuildState": i.state}
    return out


REASONS = {
    "NO_PREDICATES": "There is no structured predicate; all rows are read in order.",
    "NO_INDEX_FOR_COLUMN": "No equality index serves the predicates.",
    "RANGE_QUERY_WITHOUT_SORTED_INDEX": "A range predicate is served by a sorted index only.",
    "INDEX_CANDIDATE_SET_TOO_LARGE": "The best index leaves so many rows that reading all is cheaper.",
    "CALLBACK_PREDICATE_REQUIRES_FULL_SCAN": "Indexes cannot serve callbacks; all rows are read.",
    "INDEX_DIRTY_WOULD_REBUILD_ON_EXECUTION": "The index is dirty; running the query would rebuild it first.",
    "UNSUPPORTED_INDEX_OPERATOR": "No index serves the predicate's operator.",
}
