"""Typed, ordered, mutable tables over immutable DataFrame versions.

A table is a DataFrame with a hidden place for each row, a number of rows, and an
index registry, all on the driver.  A mutation plans the next version from the
current one, writes it to the shared folder while it counts the affected rows,
and then takes its place; a failed mutation leaves the table as it was.  Small
inserts wait on the driver and join the frame at the next read; changes of one
row wait there too, as the changed row beside a version without it, until there
are MOST_HELD.  The files of a version go when KEPT_VERSIONS newer ones have
come, so a frame stays readable for that long.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rowloom.errors import EngineError
from rowloom.operators.background import Rebuilds
from rowloom.operators.query import Query
from rowloom.plans import indexes, windows
from rowloom.plans.filters import Filter, conjunction, make_filter
from rowloom.schema import POS, Column, Schema, col, check_column, check_count, check_numeric, check_patch, check_row, check_row_index, check_schema, spark_schema
from rowloom.sources import frames, snapshot, versions

CAPACITY = 1024
#: Frames that may be joined to a version before it is written anew.
MOST_PARTS = 8
#: Changed rows that may wait on the driver, and earlier versions whose files stay.
MOST_HELD, KEPT_VERSIONS = 500, 2
#: A cached table of fewer rows stays in the partitions it has.
ROWS_PER_CORE = 10_000


class Table:
    def __init__(self, spark: SparkSession, schema: Schema, capacity: int = CAPACITY, on_query: Callable[[dict], object] | None = None) -> None:
        self.spark, self.schema = spark, check_schema(schema)
        self.capacity = check_count(capacity, "INVALID_LIMIT", 1)
        self.on_query = on_query
        self._rows: int | None = 0
        self.version = self._next = 0
        self.registry = indexes.Registry(self.schema)
        self.scanned_row_count = self.materialized_row_count = 0
        self._base: DataFrame | None = None
        self._parts = 0
        self._waiting: list[dict[str, Any]] = []
        #: Whether places are 0, 1, 2, ...; no longer after a delete.
        self.dense = True
        #: Places that count no more in the base, and the rows that stand for some of them.
        self._gone: set[int] = set()
        self._kept: dict[int, dict[str, Any]] = {}
        self._view: DataFrame | None = None
        self._blocks: windows.Blocks | None = None
        #: Folders of the base, and of the versions before it.
        self._folders: set[str] = set()
        self._retired: deque[set[str]] = deque()
        self._cached: DataFrame | None = None
        #: Number of the base; changed rows do not make another.
        self._epoch = 0
        self.rebuilds = Rebuilds(self)
        #: The last batch that each stream, by its checkpoint, has inserted.
        self.batches: dict[str, int] = {}

    # Sources

    @classmethod
    def from_rows(cls, spark: SparkSession, schema: Schema, rows: list[dict], **options: Any) -> Table:
        return cls(spark, schema, **options).insert_many(rows)

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str, schema: Schema, check: bool = True, prepare: Callable[[DataFrame], DataFrame] | None = None, **options: Any) -> Table:
        """Rows of Parquet files in file order; ``prepare`` may derive columns.  The files stay the storage."""
        df = frames.numbered(spark, path)
        return cls._of(spark, schema, prepare(df) if prepare else df, check, **options)

    @classmethod
    def from_frame(cls, df: DataFrame, schema: Schema, order_by: list[str], check: bool = True, **options: Any) -> Table:
        """Rows of a DataFrame in the order of some columns; written once, range-partitioned by them."""
        ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn(POS, F.monotonically_increasing_id())
        table = cls(df.sparkSession, schema, **options)
        settled = versions.settle(ordered, versions.PART_ROWS * df.rdd.getNumPartitions())
        table._folders = {settled.path}
        return table._load(settled.frame, check, dense=False)

    @classmethod
    def _of(cls, spark: SparkSession, schema: Schema, df: DataFrame, check: bool, **options: Any) -> Table:
        return cls(spark, schema, **options)._load(df, check, dense=len(df.inputFiles()) <= 1)

    def _load(self, df: DataFrame, check: bool, dense: bool) -> Table:
        """Take over a frame with places; unchecked rows are counted when their number is first asked for."""
        self._rows = frames.check_frame(df, self.schema) if check else None
        self._base, self.dense = frames.conform(df, self.schema), dense
        if check:
            self._counted()
        return self

    def _counted(self) -> None:
        self._next = self._rows if self.dense else 1 << 62
        self._grow(self._rows)

    @property
    def row_count(self) -> int:
        if self._rows is None:
            self._rows = self._base.count()
            self._counted()
        return self._rows

    @row_count.setter
    def row_count(self, rows: int) -> None:
        self._rows = rows

    def _grow(self, rows: int) -> None:
        while self.capacity < rows:
            self.capacity *= 2

    def get_schema(self) -> Schema:
        return dict(self.schema)

    def cache(self) -> Table:
        """Keep the current version in executor memory, in ranges of places for all cores."""
        df = self.frame()
        if self.row_count > ROWS_PER_CORE:
            df = df.repartitionByRange(self.spark.sparkContext.defaultParallelism, POS).sortWithinPartitions(POS)
        self._adopt(df.cache(), self._folders)
        self._cached = self._base
        self._base.count()
        return self

    # The current version

    def frame(self) -> DataFrame:
        """The current version with its hidden place column."""
        if self._waiting:
            df = self._local(self._waiting)
            self._base = df if self._base is None else self._base.unionByName(df)
            self._waiting, self._parts, self._view, self._epoch = [], self._parts + 1, None, self._epoch + 1
            if self._parts >= MOST_PARTS:
                self._settle_view()
        if self._base is None:
            return self.spark.createDataFrame([], spark_schema(self.schema))
        return self._overlaid()

    def _local(self, rows: list[dict[str, Any]]) -> DataFrame:
        """Rows of the driver, with their places, as a frame."""
        columns = {n: [r[n] for r in rows] for n in (*self.schema, POS)}
        kinds = {"ShortType": pa.int16(), "IntegerType": pa.int32(), "LongType": pa.int64(), "FloatType": pa.float32(), "DoubleType": pa.float64(), "BooleanType": pa.bool_(), "StringType": pa.string()}
        fields = spark_schema(self.schema)
        table = pa.table({f.name: pa.array(columns[f.name], kinds[type(f.dataType).__name__]) for f in fields})
        return self.spark.createDataFrame(table, fields)

    def _overlaid(self) -> DataFrame:
        """The base with the changed rows; filters reach both."""
        if self._view is None:
            self._view = self._with_changes(self._base)
        return self._view

    def _with_changes(self, base: DataFrame) -> DataFrame:
        df = base.filter(~F.col(POS).isin(sorted(self._gone))) if self._gone else base
        return df.unionByName(self._local([row | {POS: place} for place, row in self._kept.items()])) if self._kept else df

    def has_replicas(self) -> bool:
        return any(i.clustered for i in self.registry.all("equality", "sorted"))

    def clustered(self, kind: str, name: str) -> DataFrame | None:
        """The current rows from the copy in the order of an index, if there is one of this base."""
        self.frame()
        index = self.registry.by_kind[kind][name]
        return self._with_changes(index.replica) if index.replica is not None and index.epoch == self._epoch else None

    def _cluster(self, index: indexes.Index) -> None:
        """Write the base in the order of the index; equal values are split by place, so none is too many for a task."""
        self.frame()
        if self._base is None or index.epoch == self._epoch:
            return
        ordered = self._base.repartitionByRange(versions.parts(self.row_count), col(index.column), POS).sortWithinPartitions(col(index.column), POS)
        settled = versions.settle(ordered, self.row_count)
        if index.replica_path:
            self._retired.append({index.replica_path})
        index.replica, index.replica_path, index.epoch = settled.frame, settled.path, self._epoch

    def _settle_view(self) -> None:
        settled = versions.settle(self._overlaid(), self.row_count)
        self._adopt(settled.frame, {settled.path})

    def _adopt(self, df: DataFrame, folders: set[str]) -> None:
        """A new base that holds every change; files of versions long past go."""
        old = self._folders - folders
        self._base, self._folders, self._parts, self._epoch = df, folders, 0, self._epoch + 1
        self._gone, self._kept, self._view, self._blocks = set(), {}, None, None
        if self._cached is not None:
            self._cached.unpersist()
            self._cached = None
        if old:
            self._retired.append(old)
        while len(self._retired) > KEPT_VERSIONS:
            for path in self._retired.popleft():
                versions.discard(self.spark, path)

    def _replace(self, settled: versions.Version, rows: int) -> None:
        self._adopt(settled.frame, {settled.path})
        self.row_count = rows
        self.version += 1

    def release(self) -> None:
        """Delete the files of all versions; the table and its frames cannot be read any more."""
        replicas = {i.replica_path for i in self.registry.all() if i.replica_path}
        for path in replicas.union(self._folders, *self._retired):
            versions.discard(self.spark, path)
        self._folders = set()
        self._retired.clear()

    def _change(self, place: int, row: dict[str, Any] | None) -> None:
        """Another row, or none, at a place."""
        if row is None:
            self.row_count -= 1
            self.dense = False
        self._gone.add(place)
        self._kept.pop(place, None)
        if row is not None:
            self._kept[place] = row
        self._view = self._blocks = None
        self.version += 1
        if len(self._gone) > MOST_HELD:
            self._settle_view()

    def _counts(self) -> windows.Blocks:
        if self._blocks is None:
            self._blocks = windows.count_blocks(self.frame(), self.row_count)
        return self._blocks

    def row_of_place(self, place: int) -> int:
        """Row index of a place."""
        if self.dense:
            return place
        blocks = self._counts()
        at = int(blocks.blocks.searchsorted(place >> blocks.bits))
        if at == len(blocks.blocks):
            return blocks.rows
        first, _ = blocks.span(at)
        return int(blocks.before[at]) + (self.frame().filter((F.col(POS) >= first) & (F.col(POS) < place)).count() if first < place else 0)

    def _place_of_row(self, i: int) -> int:
        return i if self.dense else windows.nth_place(self.frame(), self._counts(), i)

    def _row_at(self, place: int) -> dict[str, Any]:
        if place in self._kept:
            return dict(self._kept[place])
        return self._bare(self.frame().filter(F.col(POS) == place).collect()[0])

    # Inserts

    def insert(self, row: dict[str, Any]) -> Table:
        values = check_row(self.schema, row)
        self._check_keys([values], None)
        return self._append([values])

    def insert_many(self, rows: Any) -> Table:
        """All rows or none: every row is checked before any is written."""
        if not isinstance(rows, (list, tuple)):
            raise EngineError("TYPE_MISMATCH", "insert_many() takes a list of rows.")
        checked = []
        for i, row in enumerate(rows):
            try:
                checked.append(check_row(self.schema, row))
            except EngineError as e:
                raise EngineError(e.code.removeprefix("ROWLOOM_"), f"Invalid row at index {i}: {e.message}", e.details) from e
        self._check_keys(checked, "insertMany")
        return self._append(checked) if checked else self

    def _append(self, rows: list[dict[str, Any]]) -> Table:
        more = self.row_count + len(rows)
        for row in rows:
            self._waiting.append(row | {POS: self._next})
            self._next += 1
        self.row_count = more
        self._blocks = None
        self._grow(more)
        self.version += 1
        self.registry.after_insert(rows)
        return self

    def insert_frame(self, df: DataFrame, order_by: list[str]) -> Table:
        """Insert the rows of a DataFrame, all or none, in the order of some columns."""
        ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn(POS, F.monotonically_increasing_id())
        settled, before = versions.settle(ordered, versions.PART_ROWS * 8), self.row_count
        try:
            rows = frames.check_frame(settled.frame, self.schema)
            more = frames.conform(settled.frame, self.schema).withColumn(POS, F.col(POS) + F.lit(self._next))
            for index in self.registry.all("unique"):
                keys = self.frame().select(col(index.column)).unionByName(more.select(col(index.column)))
                indexes.histogram(keys, index.column, before + rows, True)
        except EngineError:
            versions.discard(self.spark, settled.path)
            raise
        if rows == 0:
            versions.discard(self.spark, settled.path)
            return self
        parts = self._parts + 1
        self._adopt(self.frame().unionByName(more), self._folders | {settled.path})
        self.row_count, self._parts = before + rows, parts
        self.version += 1
        if parts >= MOST_PARTS:
            self._settle_view()
        self._next, self.dense = self._next + (1 << 53), False
        self._grow(self.row_count)
        self.registry.after_insert(None)
        return self

    def _check_keys(self, rows: list[dict[str, Any]], operation: str | None) -> None:
        for index in self.registry.all("unique"):
            name = index.column
            keys = [r[name] for r in rows]
            there = {r[0]: r[1] for r in self.frame().filter(col(name).isin(keys)).select(col(name), POS).collect()} if keys else {}
            seen: dict[Any, int] = {}
            for i, key in enumerate(keys):
                detail = {"column": name, "key": key, "operation": operation or "insert"} | ({"inputIndex": i} if operation else {})
                if key in there:
                    raise EngineError("DUPLICATE_KEY", f'Column "{name}" already has the key {key!r}.', detail | {"existingRowIndex": self.row_of_place(there[key])})
                if key in seen:
                    raise EngineError("DUPLICATE_KEY", f'Column "{name}" gets the key {key!r} twice.', detail | {"conflictingInputIndex": seen[key]})
                seen[key] = i

    # Queries

    def query(self) -> Query:
        return Query(self)

    def where(self, name: Any, op: Any = None, value: Any = None) -> Query:
        return Query(self).where(name, op, value)

    def where_in(self, name: str, values: Any) -> Query:
        return Query(self).where_in(name, values)

    def where_not_in(self, name: str, values: Any) -> Query:
        return Query(self).where_not_in(name, values)

    def filter(self, callback: Callable[[dict], object]) -> Query:
        return Query(self).filter(callback)

    def select(self, columns: list[str]) -> Query:
        return Query(self).select(columns)

    def limit(self, n: int) -> Query:
        return Query(self).limit(n)

    def offset(self, n: int) -> Query:
        return Query(self).offset(n)

    def to_array(self) -> list[dict[str, Any]]:
        return Query(self).to_array()

    def first(self) -> dict[str, Any] | None:
        return Query(self).first()

    def count(self) -> int:
        return Query(self).count()

    size = count

    def is_empty(self) -> bool:
        return self.row_count == 0

    def sum(self, name: str) -> int | float:
        return Query(self).sum(name)

    def avg(self, name: str) -> float | None:
        return Query(self).avg(name)

    def min(self, name: str) -> int | float | None:
        return Query(self).min(name)

    def max(self, name: str) -> int | float | None:
        return Query(self).max(name)

    def top(self, n: int, name: str) -> list[dict[str, Any]]:
        return Query(self).top(n, name)

    def bottom(self, n: int, name: str) -> list[dict[str, Any]]:
        return Query(self).bottom(n, name)

    def for_each(self, callback: Callable[[dict, int], object]) -> None:
        Query(self).for_each(callback)

    def stream(self) -> Iterator[dict[str, Any]]:
        return Query(self).stream()

    __iter__ = stream

    def _predicate(self, args: tuple) -> Query:
        if len(args) == 1 and callable(args[0]):
            return Query(self).filter(args[0])
        return Query(self).where(*args)

    def first_where(self, *predicate: Any) -> dict[str, Any] | None:
        """Takes a dict, a column with operator and value, or a function."""
        return self._predicate(predicate).first()

    def count_where(self, *predicate: Any) -> int:
        return self._predicate(predicate).count()

    def exists(self, *predicate: Any) -> bool:
        return not self._predicate(predicate).limit(1).is_empty()

    # Rows by position

    def get(self, row_index: int) -> dict[str, Any]:
        i = check_row_index(row_index, self.row_count)
        self.materialized_row_count += 1
        return self._row_at(self._place_of_row(i))

    def _bare(self, row: Any) -> dict[str, Any]:
        return {n: row[n] for n in self.schema}

    def get_value(self, row_index: int, name: str) -> Any:
        check_column(self.schema, name, "get_value")
        return self.get(row_index)[name]

    def get_comparable_value(self, row_index: int, name: str) -> Any:
        """As get_value; for a dictionary column the code of the value."""
        value = self.get_value(row_index, name)
        c = self.schema[name]
        return c.values.index(value) if c.kind == "dictionary" else value

    def get_numeric_value(self, row_index: int, name: str) -> int | float:
        check_numeric(self.schema, name, "get_numeric_value")
        return self.get_value(row_index, name)

    # Mutations

    def update(self, row_index: int, patch: dict[str, Any]) -> dict[str, int]:
        place = self._place_of_row(check_row_index(row_index, self.row_count))
        return self._update_one(place, check_patch(self.schema, patch), "update")

    def _update_one(self, place: int, values: dict[str, Any], operation: str) -> dict[str, int]:
        self._check_update(F.col(POS) == place, values, 1, operation, None)
        self._change(place, self._row_at(place) | values)
        self.registry.after_update(values)
        return {"affectedRows": 1}

    def update_matching(self, query: Query, patch: Any, ready: dict[str, Any]) -> dict[str, int]:
        """Rows that match now get the patch; selection is ignored."""
        query._scan(ready)
        if not query.windowed and not query.callbacks:
            values = check_patch(self.schema, patch)
            if query._nothing(ready):
                return {"affectedRows": 0}
            return self._update(conjunction(query.filters) if query.filters else F.lit(True), values, None, "updateMany")
        settled = versions.settle(query.rows().select(F.col(POS).alias("__hit")), self.row_count)
        try:
            places = settled.frame
            n = places.count()
            values = check_patch(self.schema, patch)
            if n:
                self._check_update(F.col("__hit").isNotNull(), values, n, "updateMany", places)
                df = self.frame().join(places, F.col(POS) == F.col("__hit"), "left")
                self._settle_update(df, F.col("__hit").isNotNull(), values)
            return {"affectedRows": n}
        finally:
            versions.discard(self.spark, settled.path)

    def _update(self, hit: Any, values: dict[str, Any], n: int | None, operation: str) -> dict[str, int]:
        if any(i.column in values for i in self.registry.all("unique")):
            n = self.frame().filter(hit).count() if n is None else n
            if n:
                self._check_update(hit, values, n, operation, None)
        elif n is None:
            # Nothing is written where nothing matches.
            n = 0 if self.frame().filter(hit).limit(1).isEmpty() else None
        return {"affectedRows": 0 if n == 0 else self._settle_update(self.frame(), hit, values)}

    def _settle_update(self, df: DataFrame, hit: Any, values: dict[str, Any]) -> int:
        """Write the next version and count its changes in one job."""
        seen = Observation()
        df = df.observe(seen, F.coalesce(F.sum(F.when(hit, 1).otherwise(0).cast("long")), F.lit(0)).alias("n"))
        changed = [F.when(hit, F.lit(values[n]).cast(c.spark_type)).otherwise(col(n)).alias(n) if n in values else col(n) for n, c in self.schema.items()]
        settled = versions.settle(df.select(*changed, POS), self.row_count)
        self._replace(settled, self.row_count)
        self.registry.after_update(values)
        return int(seen.get["n"])

    def _check_update(self, hit: Any, values: dict[str, Any], n: int, operation: str, places: DataFrame | None) -> None:
        """A patch gives all its rows one key: more than one row, or another row that has it, is a duplicate."""
        for index in self.registry.all("unique"):
            if index.column not in values:
                continue
            key = values[index.column]
            df = self.frame() if places is None else self.frame().join(places, F.col(POS) == F.col("__hit"), "left")
            if n > 1 or not df.filter((col(index.column) == F.lit(key)) & ~hit).limit(1).isEmpty():
                raise EngineError("DUPLICATE_KEY", f'Column "{index.column}" would have the key {key!r} more than once.', {"column": index.column, "key": key, "operation": operation})

    def update_where(self, name: str, op: str, value: Any, patch: dict[str, Any]) -> dict[str, int]:
        return self.where(name, op, value).update(patch)

    def update_many(self, predicate: dict[str, Any], patch: dict[str, Any]) -> dict[str, int]:
        return self.where(predicate).update(patch)

    def delete(self, row_index: int) -> Table:
        self._change(self._place_of_row(check_row_index(row_index, self.row_count)), None)
        self.registry.after_delete(True)
        return self

    def delete_matching(self, query: Query, ready: dict[str, Any]) -> dict[str, int]:
        query._scan(ready)
        if query._nothing(ready):
            return {"affectedRows": 0}
        seen, places = Observation(), None
        if not query.windowed and not query.callbacks:
            hit = conjunction(query.filters) if query.filters else F.lit(True)
            nothing, left = self.frame().filter(hit).limit(1).isEmpty(), self.frame().filter(~hit)
        else:
            # Written first: the same rows must be taken out that were matched.
            places = versions.settle(query.rows().select(F.col(POS).alias("__hit")), self.row_count)
            nothing, left = places.frame.isEmpty(), self.frame().join(places.frame, F.col(POS) == F.col("__hit"), "left_anti")
        n = 0
        if not nothing:
            settled = versions.settle(left.observe(seen, F.count(F.lit(1)).alias("n")), self.row_count)
            n = self.row_count - int(seen.get["n"])
            self._replace(settled, self.row_count - n)
            self.dense = False
            self.registry.after_delete(False)
        if places is not None:
            versions.discard(self.spark, places.path)
        return {"affectedRows": n}

    def delete_many(self, predicate: dict[str, Any]) -> dict[str, int]:
        return self.where(predicate).delete()

    def delete_where(self, name: str, op: str, value: Any) -> dict[str, int]:
        return self.where(name, op, value).delete()

    # Rows by unique key

    def _by_key(self, name: str, value: Any) -> Any | None:
        index = self.registry.get("unique", name)
        key = self.schema[name].check(value, name)
        if index.state != "fresh":
            self.refresh(index)
        found = self.frame().filter(col(name) == F.lit(key)).limit(1).collect()
        return found[0] if found else None

    def find_by(self, name: str, value: Any) -> dict[str, Any] | None:
        row = self._by_key(name, value)
        return None if row is None else self._bare(row)

    def update_by(self, name: str, value: Any, patch: dict[str, Any]) -> dict[str, int]:
        row = self._by_key(name, value)
        values = check_patch(self.schema, patch)
        return {"affectedRows": 0} if row is None else self._update_one(row[POS], values, "updateBy")

    def delete_by(self, name: str, value: Any) -> dict[str, int]:
        row = self._by_key(name, value)
        if row is None:
            return {"affectedRows": 0}
        self._change(row[POS], None)
        self.registry.after_delete(True)
        return {"affectedRows": 1}

    # Indexes

    def refresh(self, index: indexes.Index) -> None:
        index.install(*indexes.histogram(self.frame(), index.column, self.row_count, index.kind == "unique"))
        if index.clustered:
            self._cluster(index)

    def _create(self, kind: str, name: str, clustered: bool = False) -> Table:
        self.registry.check_new(kind, name)
        index = indexes.Index(kind, name, clustered=clustered)
        self.refresh(index)
        self.registry.by_kind[kind][name] = index
        return self

    def _drop(self, kind: str, name: str) -> Table:
        index = self.registry.get(kind, name)
        if index.replica_path:
            self._retired.append({index.replica_path})
        del self.registry.by_kind[kind][name]
        return self

    def _rebuild(self, kind: str, name: str) -> Table:
        self.refresh(self.registry.get(kind, name))
        return self

    def _has(self, kind: str, name: str) -> bool:
        check_column(self.schema, name, "index")
        return name in self.registry.by_kind[kind]

    def create_index(self, name: str, clustered: bool = False) -> Table:
        """``clustered`` also writes the rows in the order of the column; queries that use the index then read from there."""
        return self._create("equality", name, clustered)

    def drop_index(self, name: str) -> Table:
        return self._drop("equality", name)

    def has_index(self, name: str) -> bool:
        return self._has("equality", name)

    def indexes(self) -> list[str]:
        return list(self.registry.by_kind["equality"])

    def index_stats(self) -> list[dict[str, Any]]:
        return [i.stats() for i in self.registry.all("equality")]

    def rebuild_index(self, name: str) -> Table:
        return self._rebuild("equality", name)

    def create_sorted_index(self, name: str, clustered: bool = False) -> Table:
        """See ``create_index``."""
        return self._create("sorted", name, clustered)

    def drop_sorted_index(self, name: str) -> Table:
        return self._drop("sorted", name)

    def has_sorted_index(self, name: str) -> bool:
        return self._has("sorted", name)

    def sorted_indexes(self) -> list[str]:
        return list(self.registry.by_kind["sorted"])

    def sorted_index_stats(self) -> list[dict[str, Any]]:
        return [i.stats() for i in self.registry.all("sorted")]

    def rebuild_sorted_index(self, name: str) -> Table:
        return self._rebuild("sorted", name)

    def create_unique_index(self, name: str) -> Table:
        return self._create("unique", name)

    def drop_unique_index(self, name: str) -> Table:
        return self._drop("unique", name)

    def has_unique_index(self, name: str) -> bool:
        return self._has("unique", name)

    def unique_indexes(self) -> list[str]:
        return list(self.registry.by_kind["unique"])

    def unique_index_stats(self) -> list[dict[str, Any]]:
        for i in self.registry.all("unique"):
            if i.state != "fresh":
                self.refresh(i)
        return [i.stats() for i in self.registry.all("unique")]

    def rebuild_unique_index(self, name: str) -> Table:
        return self._rebuild("unique", name)

    def rebuild_unique_indexes(self) -> Table:
        for i in self.registry.all("unique"):
            self.refresh(i)
        return self

    def rebuild_indexes(self) -> Table:
        for i in self.registry.all("equality", "sorted"):
            self.refresh(i)
        return self

    def debug_index_diagnostics(self) -> list[dict[str, Any]]:
        return [i.snapshot() for i in self.registry.all()]

    def get_index_debug_plan(self, filters: tuple[Filter, ...]) -> dict[str, Any]:
        """The planner's view of filters; unstable."""
        return indexes.plan(self.registry, tuple(filters), self.row_count)

    def get_indexed_candidate_plan(self, filters: tuple[Filter, ...]) -> dict[str, Any] | None:
        """The plan of an index that would be used, with the places of its candidates as a lazy frame; else None."""
        plan = self.get_index_debug_plan(filters)
        if plan["mode"] != "index" or plan["indexState"] != "fresh":
            return None
        kind, name = plan["source"], plan["column"]
        served = [f for f in filters if f.column == name and self.registry.by_kind[kind][name].estimate(f) == plan["candidateRows"]]
        return plan | {"operator": served[0].op, "places": self.frame().filter(served[0].to_column()).select(POS)}

    def create_filter(self, name: str, op: str, value: Any) -> Filter:
        return make_filter(self.schema, name, op, value)

    def matches_filter(self, row_index: int, made: Filter) -> bool:
        place = self._place_of_row(check_row_index(row_index, self.row_count))
        return not self.frame().filter((F.col(POS) == place) & made.to_column()).isEmpty()

    def materialize_row(self, row_index: int, columns: list[str] | None = None) -> dict[str, Any]:
        row = self.get(row_index)
        return row if columns is None else {c: row[c] for c in columns}

    def has_query_hook(self) -> bool:
        return self.on_query is not None

    def notify_query(self, info: dict[str, Any]) -> None:
        if self.on_query:
            self.on_query(info)

    def record_row_scan(self) -> None:
        self.scanned_row_count += 1

    def record_row_scans(self, count: int) -> None:
        self.scanned_row_count += count

    def reset_scan_counter(self) -> None:
        self.scanned_row_count = 0

    def reset_materialization_counter(self) -> None:
        self.materialized_row_count = 0

    # Snapshots

    def serialize(self, magic: bytes = snapshot.MAGIC) -> bytes:
        """The rows as one binary snapshot on the driver; ``save`` is for large tables."""
        rows = self.frame().orderBy(POS).select(*map(col, self.schema)).toArrow()
        self._grow(self.row_count)
        return snapshot.encode(self.schema, rows, self.capacity, magic)

    @classmethod
    def deserialize(cls, spark: SparkSession, data: bytes, magic: bytes = snapshot.MAGIC) -> Table:
        """Restores the rows and the capacity; indexes and hooks are not part of a snapshot."""
        schema, rows, capacity = snapshot.decode(data, magic)
        table = cls(spark, schema, capacity)
        if rows.num_rows:
            fields = spark_schema(schema)
            rows = rows.append_column(POS, pa.array(range(rows.num_rows), pa.int64()))
            kinds = spark.createDataFrame([], fields).toArrow().schema
            table._base = spark.createDataFrame(pa.table([rows[f.name].cast(kinds.field(f.name).type) for f in fields], [f.name for f in fields]), fields)
        table.row_count = table._next = rows.num_rows
        return table

    def save(self, path: str) -> None:
        """Write the rows as Parquet, range-partitioned by place; the schema goes along in the fields' metadata."""
        fields = spark_schema(self.schema)
        fields[POS].metadata["batches"] = json.dumps(self.batches)
        df = self.frame().select(*(col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in fields))
        df.repartitionByRange(POS).sortWithinPartitions(POS).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options: Any) -> Table:
        df = spark.read.parquet(path)
        schema: Schema = {}
        for f in df.schema:
            if f.name != POS:
                kind = f.metadata["lt"]
                schema[f.name] = Column("boolean") if kind == "boolean" else Column("dictionary", values=tuple(f.metadata["dict"])) if kind == "dictionary" else Column("numeric", kind)
        table = cls(spark, schema, **options)
        table._base = df
        table.batches = json.loads(df.schema[POS].metadata.get("batches", "{}"))
        found = df.agg(F.count(F.lit(1)), F.max(POS)).collect()[0]
        table.row_count, table._next = found[0], (found[1] + 1 if found[0] else 0)
        table.dense = table._next == table.row_count
        table._grow(table.row_count)
        return table


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p.capitalize() for p in rest)


for _name in [n for n in vars(Table) if "_" in n.strip("_") and not n.startswith("_")]:
    setattr(Table, _camel(_name), vars(Table)[_name])
for _name in ("row_count", "scanned_row_count", "materialized_row_count"):
    setattr(Table, _camel(_name), property(lambda self, n=_name: getattr(self, n)))


def table(spark: SparkSession, schema: Schema, **options: Any) -> Table:
    """An empty table."""
    return Table(spark, schema, **options)


def from_rows(spark: SparkSession, schema: Schema, rows: list[dict], **options: Any) -> Table:
    return Table.from_rows(spark, schema, rows, **options)
