"""Exact top-k search by inner product with a vector-approximation file.

Vectors are taken as the integers floor(scale * x).  The file holds, block by
block in the shared folder, a cell number of CELL_BITS bits for every component,
two to a byte, and beside it the exact vector.  A search scans the cells only.

Bounds.  The middle m of a vector's cells is no farther from the vector than half
a cell in any component, so its inner product with a query q is between q.m - r
and q.m + r, with r the sum of |q| times half the cells' widths: one product of
matrices bounds all pairs of a block and a group of queries.  The k-th best lower
bound over some blocks is a score that a query's result cannot fall below.  Exact
vectors are then read in the order of their bounds, best first (the lower bound
order of a distance), until no unread vector can reach the k-th result.

Queries wait in the shared folder too, in groups of bounded size, and every task
takes a block and some groups, so neither the driver nor a closure ever holds
vectors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm import store
from rowloom.llm.scratch import fresh_path, stash

CELL_BITS = 4
#: Vectors of a block, queries of a group on average, queries whose bounds are held at once.
BLOCK_ROWS, GROUP_QUERIES, QUERY_ROWS = 4096, 4096, 256
#: Exact vectors read at once for a query.
READ_ROWS = 64
#: Blocks that the first bounds of a query's result come from, and groups of queries to a task.
FIRST_BLOCKS, TASK_GROUPS = 8, 16
MOST_TASKS = 100_000
#: Scores are 64-bit integers; beyond that they count as the nearest one.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """Rows (vec_id, v) with v the integers floor(scale * x); rows that take no part are gone."""
    x = F.col(vector_col)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & sound & (F.size(x) > 0))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and integer vectors of a batch (vec_id, v), one pair for each length of vector."""
    lists = batch.column("v")
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    ends = lists.offsets.to_numpy()
    values, length = lists.values.to_numpy(), np.diff(ends)
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        yield ids[rows], values[ends[rows][:, None] + np.arange(n)]


def _pack(cells: np.ndarray) -> np.ndarray:
    """Cells of 4 bits, two to a byte."""
    if cells.shape[1] % 2:
        cells = np.concatenate([cells, np.zeros((len(cells), 1), np.uint8)], axis=1)
    return cells[:, ::2] << 4 | cells[:, 1::2]


def _unpack(packed: np.ndarray, dims: int) -> np.ndarray:
    out = np.empty((len(packed), 2 * packed.shape[1]), np.uint8)
    out[:, ::2], out[:, 1::2] = packed >> 4, packed & 15
    return out[:, :dims]


def build(rows: DataFrame) -> DataFrame:
    """Write the file; one row for each block: path, dims."""
    folder = fresh_path(rows.sparkSession, "vafile")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            for ids, v in _matrices(batch):
                for a in range(0, len(ids), BLOCK_ROWS):
                    part = v[a : a + BLOCK_ROWS]
                    # In parts of a cell that cannot overflow.
                    low, high = part.min(axis=0), part.max(axis=0)
                    width = ((high.astype(object) - low) // (1 << CELL_BITS) + 1).astype(np.float64)
                    cells = np.minimum((part - low.astype(np.float64)) // width, (1 << CELL_BITS) - 1).astype(np.uint8)
                    path = f"{folder}/{TaskContext.get().partitionId():06d}-{made:06d}"
                    store.write(path, {"id": ids[a : a + BLOCK_ROWS].astype(np.int64), "cell": _pack(cells).ravel(), "exact": part.ravel(), "low": low, "width": width})
                    made += 1
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([part.shape[1]], pa.int32())], ["path", "dims"])

    return stash(rows.mapInArrow(run, "path string, dims int"), "vafile-blocks")


def scores_of(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of a query with rows, as 64-bit integers."""
    most = float(np.abs(query.astype(np.float64)).max(initial=0)) * float(np.abs(rows.astype(np.float64)).max(initial=0)) * len(query)
    if most < 2**53:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return rows @ query
    exact = [sum(a * b for a, b in zip(query.tolist(), row, strict=True)) for row in rows.tolist()]
    return np.array([min(max(x, LEAST), MOST) for x in exact], np.int64)


class Block:
    def __init__(self, path: str, dims: int) -> None:
        arrays = store.read(path)
        self.ids = np.asarray(arrays["id"])
        cells = _unpack(np.asarray(arrays["cell"]).reshape(len(self.ids), -1), dims)
        #: Middles of the cells, and half their widths.
        self.half = (arrays["width"] - 1) / 2
        self.middle = arrays["low"] + cells * arrays["width"] + self.half
        #: Stays on disk; rows are read one by one.
        self.exact = arrays["exact"].reshape(-1, dims)
        self.most = float(np.abs(self.middle).max(initial=0))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and vector the bound in the middle, and for each query how far the score can be from it."""
        size = np.abs(queries.astype(np.float64))
        most = float(size.max(initial=0)) * self.most * queries.shape[1]
        # Middles are halves, so products below these sizes are exact; beyond, rounding widens the bounds.
        kind = np.float32 if most < 2**22 else np.float64
        middle = queries.astype(kind) @ self.middle.astype(kind).T
        slack = 0.0 if most < 2**51 else most * queries.shape[1] * 2.0**-51
        return middle, size @ self.half + slack


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k].astype(np.float64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    # Falling scores without negation, which the least integer has none of.
    return np.lexsort((ids, ~scores))[:k]


def _search(block: Block, query: np.ndarray, upper: np.ndarray, floor: float, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The best k rows of the block that can reach ``floor``, read in the order of their upper bounds; and how many were read."""
    order = np.flatnonzero((upper >= floor) & (block.ids != own))
    order = order[np.argsort(-upper[order], kind="stable")]
    scores, ids, read = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for a in range(0, len(order), READ_ROWS):
        if len(scores) >= k and float(scores.min()) > upper[order[a]]:
            break
        rows = order[a : a + READ_ROWS]
        read += len(rows)
        scores = np.concatenate([scores, scores_of(query, block.exact[rows])])
        ids = np.concatenate([ids, block.ids[rows]])
        best = _best(scores, ids, k)
        scores, ids = scores[best], ids[best]
    return scores, ids, read


def _write_groups(asked: DataFrame, groups: int) -> list[tuple[int, str]]:
    """Write the queries in groups of one length; (dims, path) of each group."""
    folder = fresh_path(asked.sparkSession, "vafile-queries")

    def run(table: pa.Table) -> pa.Table:
        dims, part = table["dims"][0].as_py(), table["part"][0].as_py()
        path = f"{folder}/{dims}-{part:06d}"
        ((ids, v),) = _matrices(table.select(["vec_id", "v"]).combine_chunks().to_batches()[0])
        store.write(path, {"id": ids.astype(np.int64), "v": v.ravel()})
        return pa.table({"dims": pa.array([dims], pa.int32()), "path": pa.array([path])})

    rows = asked.select("vec_id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("part"))
    found = rows.groupBy("dims", "part").applyInArrow(run, "dims int, path string").collect()
    return sorted((r.dims, r.path) for r in found)


def _group(path: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    arrays = store.read(path)
    return np.asarray(arrays["id"]), np.asarray(arrays["v"]).reshape(-1, dims)


def _floors(blocks: DataFrame, groups: list[tuple[int, str]], k: int) -> None:
    """Write for each group what a query's result cannot fall below: the best k-th lower bound over a few blocks of its length."""
    spark = blocks.sparkSession
    w = Window.partitionBy("dims").orderBy("path")
    first: dict[int, list[str]] = {}
    for r in blocks.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= FIRST_BLOCKS).collect():
        first.setdefault(r.dims, []).append(r.path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, queries = _group(path, dims)
                floor = np.full(len(ids), -np.inf)
                for block in (Block(p, dims) for p in first.get(dims, [])):
                    for a in range(0, len(ids), QUERY_ROWS):
                        middle, radius = block.bounds(queries[a : a + QUERY_ROWS])
                        middle[ids[a : a + QUERY_ROWS, None] == block.ids] = -np.inf
                        floor[a : a + QUERY_ROWS] = np.maximum(floor[a : a + QUERY_ROWS], _kth(middle, k) - radius)
                store.write(f"{path}.floor", {"floor": floor})
                yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    rows = spark.createDataFrame(groups, "dims int, path string").repartition(len(groups))
    rows.mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def candidates(vectors: DataFrame, is_query, k: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """Rows (query_id, vec_id, score) that hold every query's result; with vec_id null the number of exact vectors read."""
    schema = "query_id long, vec_id long, score long"
    blocks = build(quantised(vectors, id_col, vector_col, scale))
    # Of repeated query ids with different vectors the least vector asks.
    asked = quantised(vectors.filter(is_query), id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stash(asked, "vafile-asked")
    groups = _write_groups(asked, max(1, -(-asked.count() // GROUP_QUERIES)))
    if not groups:
        return blocks.sparkSession.createDataFrame([], schema)
    _floors(blocks, groups, k)
    paths: dict[int, list[str]] = {}
    for dims, path in groups:
        paths.setdefault(dims, []).append(path)
    chunks = -(-max(map(len, paths.values())) // TASK_GROUPS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, dims, chunk in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                mine = paths.get(dims, [])[chunk * TASK_GROUPS : (chunk + 1) * TASK_GROUPS]
                block = Block(path, dims) if mine else None
                for group in mine:
                    ids, queries = _group(group, dims)
                    floor = np.asarray(store.read(f"{group}.floor")["floor"])
                    found, read = [], 0
                    for a in range(0, len(ids), QUERY_ROWS):
                        middle, radius = block.bounds(queries[a : a + QUERY_ROWS])
                        for i, (bound, r) in enumerate(zip(middle, radius, strict=True), a):
                            scores, near, n = _search(block, queries[i], bound + r, floor[i], ids[i], k)
                            found.append((np.full(len(near), ids[i]), near, scores))
                            read += n
                    columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([read], pa.int64())], ["query_id", "vec_id", "score"])

    tasks = blocks.select("path", "dims", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    # By number, so that these few bytes, which stand for much work, are not put into one task.
    return tasks.repartition(max(1, min(blocks.count() * chunks, MOST_TASKS))).mapInArrow(run, schema)


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best inner products of every query row: query_id, rank, vec_id, score.

    Candidates are all rows with another id than the query's; ties go to the
    smaller id; fewer rows than k give fewer results.  Rows with a null id, a
    null or empty vector, or a null or non-finite component take no part.
    Vectors are compared with those of their own length only.  A query id that
    repeats is one query, with the least of its vectors; repeated candidate rows
    count each.  Scores are exact however large the components; beyond 64 bits
    they count as the nearest 64-bit number.  An empty table, or one without
    queries, gives no rows.  ``is_query`` is a condition on the input's columns.
    """
    found = candidates(vectors, is_query, k, scale, id_col, vector_col).filter("vec_id IS NOT NULL")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
