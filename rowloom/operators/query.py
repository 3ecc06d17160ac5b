"""Immutable lazy queries over a table.

A query is a declaration: filters, callbacks, offset, limit, selection.  It is
compiled at the terminal operation, always in that order, against the table's
version at that moment.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.errors import EngineError
from rowloom.functions.aggregates import AGGREGATES
from rowloom.functions.callbacks import passing
from rowloom.plans import indexes, windows
from rowloom.plans.filters import Filter, by_cost, conjunction, make_filter, object_filters
from rowloom.schema import POS, check_column, check_count, check_numeric, col

if TYPE_CHECKING:
    from rowloom.operators.table import Table


@dataclass(frozen=True)
class Query:
    table: Table
    filters: tuple[Filter, ...] = ()
    callbacks: tuple[Callable[[dict], object], ...] = ()
    columns: tuple[str, ...] | None = None
    limit_rows: int | None = None
    offset_rows: int = 0

    # Builders

    def where(self, name: Any, op: Any = None, value: Any = None) -> Query:
        if op is None and isinstance(name, dict):
            more = object_filters(self.table.schema, name)
        elif op is None and not isinstance(name, str):
            raise EngineError("INVALID_PREDICATE", "where() takes a dict, or a column, an operator and a value.")
        else:
            more = [make_filter(self.table.schema, name, op, value)]
        return replace(self, filters=(*self.filters, *more))

    def where_in(self, name: str, values: Any) -> Query:
        return self.where(name, "in", values)

    def where_not_in(self, name: str, values: Any) -> Query:
        return self.where(name, "not in", values)

    def filter(self, callback: Callable[[dict], object]) -> Query:
        if not callable(callback):
            raise EngineError("INVALID_PREDICATE", "filter() takes a function.")
        return replace(self, callbacks=(*self.callbacks, callback))

    def select(self, columns: Any) -> Query:
        if not isinstance(columns, (list, tuple)) or not columns:
            raise EngineError("INVALID_COLUMN", "select() takes a non-empty list of columns.")
        for c in columns:
            check_column(self.table.schema, c, "select")
        if len(set(columns)) < len(columns):
            raise EngineError("DUPLICATE_COLUMN", "select() takes each column once.")
        return replace(self, columns=tuple(columns))

    def limit(self, n: int) -> Query:
        return replace(self, limit_rows=check_count(n, "INVALID_LIMIT"))

    def offset(self, n: int) -> Query:
        return replace(self, offset_rows=check_count(n, "INVALID_OFFSET"))

    # Plans

    @property
    def windowed(self) -> bool:
        return self.limit_rows is not None or self.offset_rows > 0

    @property
    def output(self) -> list[str]:
        return list(self.columns or self.table.schema)

    def _matches(self) -> DataFrame:
        """Rows that pass all predicates, in no order, with their place."""
        df = self._source()
        if self.filters:
            df = df.filter(conjunction(self.filters))
        return passing(df, self.callbacks) if self.callbacks else df

    def _source(self) -> DataFrame:
        """The table, or its copy in the order of the chosen index, of which a scan reads the matching ranges only."""
        if self.filters and not self.callbacks and self.table.has_replicas():
            plan = self._plan()
            if plan["mode"] == "index" and plan["indexState"] == "fresh":
                found = self.table.clustered(plan["source"], plan["column"])
                if found is not None:
                    return found
        return self.table.frame()

    def rows(self) -> DataFrame:
        """Rows of the query with their place.

        A small window is a sorted take; any other is a range of places, found
        by counting where the places have gaps or predicates leave some.
        """
        df = self._matches()
        if not self.windowed:
            return df
        if self.limit_rows == 0:
            return df.limit(0)
        if self.table.dense and not self.filters and not self.callbacks:
            df = df.filter(F.col(POS) >= self.offset_rows)
            return df if self.limit_rows is None else df.filter(F.col(POS) < self.offset_rows + self.limit_rows)
        if self._small_window:
            return df.orderBy(POS).offset(self.offset_rows).limit(self.limit_rows)
        return windows.window(df, self.table.row_count, self.offset_rows, self.limit_rows)

    @property
    def _small_window(self) -> bool:
        return self.limit_rows is not None and self.offset_rows + self.limit_rows <= windows.TAKEN_ROWS

    def frame(self) -> DataFrame:
        """The result as a DataFrame of the selected columns; in row order where offset or limit are set.

        Lazy, but for the counts that a large window over predicates needs.
        """
        df = self.rows()
        return (df.orderBy(POS) if self.windowed else df).select(*map(col, self.output))

    def top_frame(self, n: int, name: str, largest: bool = True) -> DataFrame:
        n = check_count(n, "INVALID_LIMIT", 1)
        check_numeric(self.table.schema, name, "top" if largest else "bottom")
        return self.rows().orderBy(col(name).desc() if largest else col(name).asc(), POS).limit(n).select(*map(col, self.output))

    def aggregate_frame(self, wanted: dict[str, tuple[str, str]]) -> DataFrame:
        """One row of aggregates in one pass: {alias: (sum, avg, min, max or count, column)}."""
        out = []
        for alias, (kind, name) in wanted.items():
            c = None if kind == "count" else check_numeric(self.table.schema, name, kind)
            out.append(AGGREGATES[kind](name, c).alias(alias))
        return self.rows().agg(*out)

    def count_frame(self, alias: str = "count") -> DataFrame:
        """Number of rows as one row; offset and limit are arithmetic, so nothing is sorted."""
        n = self._matches().agg(F.count(F.lit(1)).alias("n"))
        left = F.greatest(F.col("n") - F.lit(self.offset_rows), F.lit(0))
        return n.select((left if self.limit_rows is None else F.least(left, F.lit(self.limit_rows))).cast("long").alias(alias))

    def _plan(self) -> dict[str, Any]:
        if self.callbacks:
            return {"mode": "scan", "reasonCode": "CALLBACK_PREDICATE_REQUIRES_FULL_SCAN"}
        return indexes.plan(self.table.registry, self.filters, self.table.row_count)

    def explain(self) -> dict[str, Any]:
        """Which access path the query would take.  Starts no job and rebuilds nothing."""
        plan = self._plan()
        used = f"{plan['source']}:{plan['column']}" if plan["mode"] == "index" else None
        out: dict[str, Any] = {"scanType": "index" if used else "full", "indexesUsed": [used] if used else []}
        if used:
            out["selectedIndex"] = used
        out |= {"predicates": len(self.filters) + len(self.callbacks), "predicateOrder": [f"{f.column} {f.op}" for f in by_cost(self.filters)], "projectionPushdown": self.columns is not None}
        out |= {k: plan[k] for k in ("candidateRows", "indexState") if k in plan}
        if "backgroundRebuildState" in plan:
            out |= {"backgroundIndexing": "sync", "backgroundRebuildState": plan["backgroundRebuildState"]}
        out |= {k: plan[k] for k in ("fallbackReason", "reasonCode") if k in plan}
        return out | ({"reason": indexes.REASONS[plan["reasonCode"]]} if "reasonCode" in plan else {})

    def debug_plan(self) -> dict[str, Any]:
        """The planner's own view; unstable."""
        return indexes.plan(self.table.registry, () if self.callbacks else self.filters, self.table.row_count)

    # Running

    def _run(self, operation: Callable[[dict[str, Any]], Any], counted: Callable[[Any], int] | None = None) -> Any:
        table, plan = self.table, self._plan()
        before = table.scanned_row_count, table.materialized_row_count
        start = time.perf_counter()
        ready = self._prepare()
        result = operation(ready)
        duration = (time.perf_counter() - start) * 1000
        if table.on_query:
            used = plan["mode"] == "index"
            rebuilt = used and plan.get("reasonCode") == "INDEX_DIRTY_WOULD_REBUILD_ON_EXECUTION"
            info: dict[str, Any] = {"duration": duration, "durationMs": duration, "rowsScanned": table.scanned_row_count - before[0], "indexUsed": used, "scanType": "index" if used else "full"}
            info |= {"selectedIndex": f"{plan['source']}:{plan['column']}"} if used else {}
            if not self.callbacks:
                info |= {k: plan[k] for k in ("indexState", "fallbackReason", "backgroundRebuildState", "reasonCode", "candidateRows") if k in plan}
            info |= {"backgroundRebuildScheduled": False, "materializedRows": table.materialized_row_count - before[1]}
            info |= {"resultCount": counted(result)} if counted else {}
            info |= {"projectionPushdown": self.columns is not None, "dirtyIndexRebuildPaid": rebuilt} | ({"dirtyIndexReason": plan["source"]} if rebuilt else {})
            table.on_query(info)
        return result

    def _prepare(self) -> dict[str, Any]:
        """Rebuild the dirty indexes that a planned query rebuilds, and plan again."""
        if self.callbacks:
            return self._plan()
        asked = {f.column for f in self.filters if f.op in (">", ">=", "<", "<=")}
        for i in self.table.registry.all("equality", "sorted"):
            if i.state == "dirty" and (i.kind == "equality" or i.column in asked):
                self.table.refresh(i)
        return self._plan()

    def _scan(self, ready: dict[str, Any], last: int | None = None) -> None:
        """Logical count of examined rows: all candidates, or up to the place where a limit was reached."""
        rows = ready["candidateRows"] if ready["mode"] == "index" else self.table.row_count
        if self.limit_rows == 0:
            rows = 0
        elif last is not None and ready["mode"] == "scan":
            rows = self.table.row_of_place(last) + 1
        self.table.scanned_row_count += rows
        if self.callbacks:
            self.table.materialized_row_count += rows

    def _nothing(self, ready: dict[str, Any]) -> bool:
        """Whether a fresh index, or the window, already shows that no row is left."""
        return self.limit_rows == 0 or (ready["mode"] == "index" and ready.get("candidateRows") == 0)

    def _collected(self, ready: dict[str, Any], limit: int | None = None) -> list[dict[str, Any]]:
        q = self if limit is None else replace(self, limit_rows=limit)
        if q._nothing(ready):
            q._scan(ready)
            return []
        found = q.rows().orderBy(POS).select(*map(col, q.output), POS).collect()
        full = q.limit_rows is not None and len(found) == q.limit_rows
        q._scan(ready, found[-1][POS] if full and found else None)
        self.table.materialized_row_count += len(found)
        return [{k: r[k] for k in q.output} for r in found]

    def to_array(self) -> list[dict[str, Any]]:
        return self._run(self._collected, len)

    def first(self) -> dict[str, Any] | None:
        """The first row, or None; a limit of 0 leaves none."""

        def run(ready: dict[str, Any]) -> dict[str, Any] | None:
            found = self._collected(ready, 1 if self.limit_rows is None else min(1, self.limit_rows))
            return found[0] if found else None

        return self._run(run, lambda r: int(r is not None))

    def count(self) -> int:
        def run(ready: dict[str, Any]) -> int:
            if self._nothing(ready):
                n = None
                out = 0
            elif not self.filters and not self.callbacks:
                n = self.table.row_count
            elif len(self.filters) == 1 and not self.callbacks and ready.get("candidateRows") is not None:
                n = ready["candidateRows"]
            else:
                n = None
                out = int(self.count_frame().collect()[0][0])
            if n is not None:
                out = max(0, n - self.offset_rows)
                out = out if self.limit_rows is None else min(out, self.limit_rows)
            self._scan(ready)
            return out

        return self._run(run, lambda n: n)

    size = count

    def is_empty(self) -> bool:
        def run(ready: dict[str, Any]) -> bool:
            if self._nothing(ready):
                self._scan(ready)
                return True
            df = self._matches() if not self.offset_rows else self.rows()
            out = df.limit(1).isEmpty()
            self._scan(ready)
            return out

        return self._run(run)

    def _aggregate(self, kind: str, name: str) -> Any:
        check_numeric(self.table.schema, name, kind)

        def run(ready: dict[str, Any]) -> Any:
            self._scan(ready)
            if self._nothing(ready):
                return 0 if kind == "sum" else None
            return self.aggregate_frame({"x": (kind, name)}).collect()[0][0]

        return self._run(run)

    def sum(self, name: str) -> int | float:
        return self._aggregate("sum", name)

    def avg(self, name: str) -> float | None:
        return self._aggregate("avg", name)

    def min(self, name: str) -> int | float | None:
        return self._aggregate("min", name)

    def max(self, name: str) -> int | float | None:
        return self._aggregate("max", name)

    def aggregate(self, wanted: dict[str, tuple[str, str]]) -> dict[str, Any]:
        """Several aggregates in one pass; an addition to the single ones."""
        return self.aggregate_frame(wanted).collect()[0].asDict()

    def _ranked(self, n: int, name: str, largest: bool) -> list[dict[str, Any]]:
        df = self.top_frame(n, name, largest)

        def run(ready: dict[str, Any]) -> list[dict[str, Any]]:
            self._scan(ready)
            found = [] if self._nothing(ready) else [r.asDict() for r in df.collect()]
            self.table.materialized_row_count += len(found)
            return found

        return self._run(run, len)

    def top(self, n: int, name: str) -> list[dict[str, Any]]:
        """The n rows with the largest values; ties in row order."""
        return self._ranked(n, name, True)

    def bottom(self, n: int, name: str) -> list[dict[str, Any]]:
        return self._ranked(n, name, False)

    def for_each(self, callback: Callable[[dict, int], object]) -> None:
        def run(ready: dict[str, Any]) -> None:
            n = 0
            for n, row in enumerate(self._streamed(), 1):
                callback(row, n - 1)
            self._scan(ready)

        self._run(run)

    def _streamed(self) -> Iterator[dict[str, Any]]:
        for r in self.rows().orderBy(POS).select(*map(col, self.output)).toLocalIterator(prefetchPartitions=True):
            self.table.materialized_row_count += 1
            yield r.asDict()

    def stream(self) -> Iterator[dict[str, Any]]:
        """Rows one by one in order, partition after partition; no hook."""
        if self.limit_rows != 0:
            yield from self._streamed()

    __iter__ = stream

    def update(self, patch: dict[str, Any]) -> dict[str, int]:
        return self._run(lambda ready: self.table.update_matching(self, patch, ready), lambda r: r["affectedRows"])

    def delete(self) -> dict[str, int]:
        return self._run(lambda ready: self.table.delete_matching(self, ready), lambda r: r["affectedRows"])

    whereIn, whereNotIn, toArray, isEmpty, forEach, debugPlan = where_in, where_not_in, to_array, is_empty, for_each, debug_plan  # noqa: N815
