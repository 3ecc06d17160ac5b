"""Index rebuilds beside the queries, installed only where nothing changed meanwhile.

Spark does the work; a small pool of driver threads submits it.  A finished
rebuild is installed when the index still exists in its queued or rebuilding
state, with the generation it was queued at, and the table has the same version;
otherwise the result is stale and is dropped.
"""

from __future__ import annotations

import os
from concurrent.futures import Future, ThreadPoolExecutor
from typing import TYPE_CHECKING

from rowloom.errors import EngineError
from rowloom.plans import indexes

if TYPE_CHECKING:
    from rowloom.operators.table import Table

MOST_JOBS = 64


class Rebuilds:
    def __init__(self, table: Table, workers: int | None = None) -> None:
        self.table = table
        self.workers = workers or max(1, min(4, (os.cpu_count() or 2) - 1))
        self._pool: ThreadPoolExecutor | None = None
        self._open: set[Future] = set()

    def submit(self, kind: str, name: str) -> Future:
        """Queue the rebuild of an index; the result says whether it was installed."""
        index = self.table.registry.get(kind, name)
        self._open = {f for f in self._open if not f.done()}
        if len(self._open) >= MOST_JOBS:
            raise EngineError("BACKGROUND_REBUILD_FAILED", f"{MOST_JOBS} rebuilds are waiting.")
        frame, rows, ticket = self.table.frame(), self.table.row_count, (index.generation, self.table.version)
        index.state = "queued"
        self._pool = self._pool or ThreadPoolExecutor(self.workers)
        future = self._pool.submit(self._work, index, frame, rows, ticket)
        self._open.add(future)
        return future

    def _current(self, index: indexes.Index, ticket: tuple[int, int]) -> bool:
        kept = self.table.registry.by_kind[index.kind].get(index.column) is index
        return kept and index.state in ("queued", "rebuilding") and ticket == (index.generation, self.table.version)

    def _work(self, index: indexes.Index, frame, rows: int, ticket: tuple[int, int]) -> bool:
        if self._current(index, ticket):
            index.state = "rebuilding"
        try:
            found = indexes.histogram(frame, index.column, rows, index.kind == "unique")
        except Exception as e:
            if self._current(index, ticket):
                index.state, index.last_error = "failed", str(e)
                index.generation += 1
            raise EngineError("BACKGROUND_REBUILD_FAILED", str(e)) from e
        if not self._current(index, ticket):
            index.stale_results += 1
            return False
        index.install(*found)
        return True
