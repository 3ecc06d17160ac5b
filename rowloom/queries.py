"""One query for each operator of the engine, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.errors import EngineError
from rowloom.operators.table import Table, from_rows, table
from rowloom.schema import Schema, column
from rowloom.sources import versions

ORDERS: Schema = {
    "o_orderkey": column.uint32(),
    "o_custkey": column.uint32(),
    "o_orderstatus": column.dictionary(["F", "O", "P"]),
    "o_totalprice": column.float64(),
    "o_orderdate": column.uint32(),
    "o_orderpriority": column.dictionary(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]),
}
LINEITEM: Schema = {
    "l_orderkey": column.uint32(),
    "l_partkey": column.uint32(),
    "l_suppkey": column.uint32(),
    "l_linenumber": column.int32(),
    "l_quantity": column.float64(),
    "l_extendedprice": column.float64(),
    "l_discount": column.float64(),
    "l_returnflag": column.dictionary(["A", "N", "R"]),
    "l_linestatus": column.dictionary(["F", "O"]),
}
CUSTOMER: Schema = {
    "c_custkey": column.uint32(),
    "c_nationkey": column.int32(),
    "c_acctbal": column.float64(),
    "c_mktsegment": column.dictionary(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]),
}
PART: Schema = {"p_partkey": column.uint32(), "p_size": column.uint8(), "p_retailprice": column.float32()}
LABELS: Schema = {"doc_id": column.uint32(), "quality": column.uint8(), "toxic": column.boolean()}

#: The orders as the tables see them.
O_SQL = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(epoch(o_orderdate) AS BIGINT) AS o_orderdate, o_orderpriority FROM orders)"


def _orders(spark: SparkSession, d: str) -> Table:
    date = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return Table.from_parquet(spark, f"{d}/orders.parquet", ORDERS, prepare=lambda df: df.withColumn("o_orderdate", date))


def _lineitem(spark: SparkSession, d: str) -> Table:
    return Table.from_parquet(spark, f"{d}/lineitem.parquet", LINEITEM)


def _customer(spark: SparkSession, d: str) -> Table:
    return Table.from_parquet(spark, f"{d}/customer.parquet", CUSTOMER)


def _part(spark: SparkSession, d: str) -> Table:
    return Table.from_parquet(spark, f"{d}/part.parquet", PART)


def _labels(spark: SparkSession, d: str) -> Table:
    return Table.from_parquet(spark, f"{d}/labels.parquet", LABELS, prepare=lambda df: df.withColumn("toxic", F.col("toxic") == 1))


def _local(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame(rows)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).where({"o_orderstatus": "F", "o_totalprice": {"gte": 150000.0}}).select(["o_orderkey", "o_custkey", "o_totalprice"]).frame()


def _explain_row(spark: SparkSession, d: str) -> DataFrame:
    """What the planner says of five queries, with an equality, a sorted and no index."""
    t = _customer(spark, d).create_index("c_mktsegment").create_sorted_index("c_acctbal")
    asked = {"equality": t.where("c_mktsegment", "=", "BUILDING"), "range": t.where("c_acctbal", ">=", 9500.0), "wide": t.where("c_acctbal", ">=", -500.0), "none": t.where("c_nationkey", "=", 3), "all": t.query()}
    plans = {k: q.explain() for k, q in asked.items()}
    return _local(spark, [{"query": k, "scan_type": p["scanType"], "candidates": p.get("candidateRows", -1), "reason": p.get("reasonCode", "")} for k, p in plans.items()])


EXPLAIN_SQL = """
WITH n AS (SELECT count(*) AS rows_, count(*) FILTER (c_mktsegment = 'BUILDING') AS eq, count(*) FILTER (c_acctbal >= 9500) AS rng, count(*) FILTER (c_acctbal >= -500) AS wide FROM customer)
SELECT 'equality' AS query, CASE WHEN eq > 0.4 * rows_ THEN 'full' ELSE 'index' END AS scan_type, eq AS candidates, CASE WHEN eq > 0.4 * rows_ THEN 'INDEX_CANDIDATE_SET_TOO_LARGE' ELSE '' END AS reason FROM n
UNION ALL SELECT 'range', CASE WHEN rng > 0.4 * rows_ THEN 'full' ELSE 'index' END, rng, CASE WHEN rng > 0.4 * rows_ THEN 'INDEX_CANDIDATE_SET_TOO_LARGE' ELSE '' END FROM n
UNION ALL SELECT 'wide', CASE WHEN wide > 0.4 * rows_ THEN 'full' ELSE 'index' END, wide, CASE WHEN wide > 0.4 * rows_ THEN 'INDEX_CANDIDATE_SET_TOO_LARGE' ELSE '' END FROM n
UNION ALL SELECT 'none', 'full', -1, 'NO_INDEX_FOR_COLUMN'
UNION ALL SELECT 'all', 'full', -1, 'NO_PREDICATES'
"""


def _affected(spark: SparkSession, name: str, result: dict[str, int], t: Table) -> DataFrame:
    """The table after a mutation, with the number of affected rows beside each row."""
    return t.query().frame().withColumn(name, F.lit(result["affectedRows"]).cast("long"))


def _update(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    return _affected(spark, "affected", t.update_many({"o_orderstatus": "P"}, {"o_orderstatus": "F", "o_totalprice": 1.5}), t)


def _update_window(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    return _affected(spark, "affected", t.where("o_orderstatus", "=", "O").offset(5).limit(50).update({"o_custkey": 7}), t)


def _update_callback(spark: SparkSession, d: str) -> DataFrame:
    t = _customer(spark, d)
    return _affected(spark, "affected", t.where("c_acctbal", ">", 0).filter(lambda r: r["c_custkey"] % 3 == 0).update({"c_nationkey": -1}), t)


def _delete(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    return _affected(spark, "affected", t.delete_many({"o_orderpriority": {"in": ["1-URGENT", "5-LOW"]}}), t)


def _delete_window(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d)
    return _affected(spark, "affected", t.where("o_orderstatus", "=", "F").offset(10).limit(100).delete(), t)


def _by_key(spark: SparkSession, d: str, change: str) -> DataFrame:
    t = _customer(spark, d).create_unique_index("c_custkey")
    if change == "find":
        return _local(spark, [t.find_by("c_custkey", 42)])
    if change == "update":
        return _affected(spark, "affected", t.update_by("c_custkey", 42, {"c_acctbal": 0.25}), t)
    return _affected(spark, "affected", t.delete_by("c_custkey", 42), t)


def _positional(spark: SparkSession, d: str) -> DataFrame:
    t = _customer(spark, d)
    t.update(3, {"c_nationkey": 99})
    t.delete(0)
    t.delete(0)
    return _local(spark, [t.get(0) | {"at": 0}, t.get(1) | {"at": 1}, t.get(t.row_count - 1) | {"at": -1}])


def _insert_many(spark: SparkSession, d: str) -> DataFrame:
    t = _customer(spark, d)
    t.insert({"c_custkey": 4_000_000_000, "c_nationkey": -5, "c_acctbal": 0.5, "c_mktsegment": "BUILDING"})
    t.insert_many([{"c_custkey": 4_000_000_000 + i, "c_nationkey": i, "c_acctbal": i / 4, "c_mktsegment": "MACHINERY"} for i in (1, 2, 3)])
    return t.query().frame()


def _insert_frame(spark: SparkSession, d: str) -> DataFrame:
    t = _customer(spark, d)
    t.insert_frame(spark.read.parquet(f"{d}/customer.parquet").select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), "c_nationkey", "c_acctbal", "c_mktsegment"), ["c_custkey"])
    return t.query().frame()


def _index_stats(spark: SparkSession, d: str) -> DataFrame:
    t = _customer(spark, d).create_index("c_nationkey").create_index("c_mktsegment").create_sorted_index("c_acctbal").create_unique_index("c_custkey")
    rows = [("equality", s) for s in t.index_stats()] + [("sorted", s) for s in t.sorted_index_stats()] + [("unique", s) for s in t.unique_index_stats()]
    return _local(spark, [{"kind": k, "col": s["column"], "uniques": s.get("uniqueValues", -1), "n_rows": s["rowCount"], "bytes": s["memoryBytesApprox"]} for k, s in rows])


INDEX_STATS_SQL = """
WITH n AS (SELECT count(*) AS r, count(DISTINCT c_nationkey) AS a, count(DISTINCT c_mktsegment) AS b FROM customer)
SELECT 'equality' AS kind, 'c_nationkey' AS col, a AS uniques, r AS n_rows, r * 4 + a * 32 AS bytes FROM n
UNION ALL SELECT 'equality', 'c_mktsegment', b, r, r * 4 + b * 32 FROM n
UNION ALL SELECT 'sorted', 'c_acctbal', -1, r, r * 4 FROM n
UNION ALL SELECT 'unique', 'c_custkey', r, r, r * 4 + r * 40 FROM n
"""


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    t = _orders(spark, d).create_index("o_orderstatus", clustered=True).create_sorted_index("o_totalprice")
    return t.where({"o_orderstatus": "P", "o_totalprice": {"lt": 90000.0}}).select(["o_orderkey", "o_totalprice"]).frame()


def _roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return Table.deserialize(spark, _customer(spark, d).serialize()).query().frame()


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    rows = list(_customer(spark, d).where("c_nationkey", "=", 7).limit(20).stream())
    return _local(spark, [r | {"at": i} for i, r in enumerate(rows)])


def _for_each(spark: SparkSession, d: str) -> DataFrame:
    out: list[dict] = []
    _customer(spark, d).where("c_nationkey", "<", 3).limit(15).for_each(lambda row, i: out.append(row | {"at": i}))
    return _local(spark, out)


def _hooked(spark: SparkSession, d: str) -> DataFrame:
    """What the hook is told of a count, a scan and a mutation."""
    seen: list[dict] = []
    t = _customer(spark, d).create_index("c_mktsegment")
    t.on_query = seen.append
    t.where("c_mktsegment", "=", "FURNITURE").count()
    t.where("c_nationkey", "=", 4).to_array()
    t.where("c_nationkey", "=", 5).update({"c_acctbal": 0.0})
    return _local(spark, [{"at": i, "scan": s["scanType"], "scanned": s["rowsScanned"], "results": s["resultCount"]} for i, s in enumerate(seen)])


HOOKED_SQL = """
WITH n AS (SELECT count(*) AS r, count(*) FILTER (c_mktsegment = 'FURNITURE') AS f, count(*) FILTER (c_nationkey = 4) AS four, count(*) FILTER (c_nationkey = 5) AS five FROM customer)
SELECT 0 AS at, CASE WHEN f > 0.4 * r THEN 'full' ELSE 'index' END AS scan, CASE WHEN f > 0.4 * r THEN r ELSE f END AS scanned, f AS results FROM n
UNION ALL SELECT 1, 'full', r, four FROM n UNION ALL SELECT 2, 'full', r, five FROM n
"""


def _scalars(spark: SparkSession, d: str) -> DataFrame:
    """Terminals that return scalars, as one row."""
    t = _orders(spark, d)
    high = t.where("o_totalprice", ">=", 400000.0)
    return _local(spark, [{
        "n_rows": t.row_count,
        "n_high": high.size(),
        "none_empty": t.where("o_totalprice", "<", 0).is_empty(),
        "exists_p": t.exists({"o_orderstatus": "P"}),
        "exists_none": t.exists("o_totalprice", ">", 1e12),
        "count_where": t.count_where("o_orderstatus", "!=", "F"),
        "first_key": t.first_where({"o_orderstatus": "P"})["o_orderkey"],
        "code": t.get_comparable_value(0, "o_orderpriority"),
    }])


SCALARS_SQL = f"""
WITH o AS (SELECT * FROM {O_SQL})
SELECT (SELECT count(*) FROM o) AS n_rows, (SELECT count(*) FROM o WHERE o_totalprice >= 400000) AS n_high, TRUE AS none_empty,
       EXISTS (SELECT 1 FROM o WHERE o_orderstatus = 'P') AS exists_p, FALSE AS exists_none,
       (SELECT count(*) FROM o WHERE o_orderstatus <> 'F') AS count_where,
       (SELECT min(o_orderkey) FROM o WHERE o_orderstatus = 'P') AS first_key,
       (SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) - 1 FROM o ORDER BY o_orderkey LIMIT 1) AS code
"""


NATION: Schema = {"n_nationkey": column.uint8(), "n_name": column.dictionary([f"NATION_{i}" for i in range(25)]), "n_regionkey": column.int16()}
REGION: Schema = {"r_regionkey": column.uint8(), "r_name": column.dictionary(["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])}


def _small(spark: SparkSession, d: str, name: str, schema: Schema) -> list[dict]:
    """Rows of one of the two tables of fixed size."""
    rows = spark.read.parquet(f"{d}/{name}.parquet").select(*schema).collect()
    return [r.asDict() for r in sorted(rows)]


def _table(spark: SparkSession, d: str) -> DataFrame:
    """An empty table that grows by single inserts."""
    t = table(spark, REGION, capacity=2)
    for row in _small(spark, d, "region", REGION):
        t.insert(row)
    return t.query().frame().withColumn("capacity", F.lit(t.capacity)).withColumn("columns", F.lit(",".join(t.get_schema())))


def _many_files(spark: SparkSession, d: str) -> DataFrame:
    """Customers from files in several folders, some of which have the same name."""
    path = f"{versions.settle(spark.range(0), 1).path}-files"
    rows = spark.read.parquet(f"{d}/customer.parquet")
    for part in range(3):
        rows.filter(F.col("c_custkey") % 3 == part).coalesce(1).write.parquet(f"{path}/part={part}")
    t = Table.from_parquet(spark, path, CUSTOMER)
    return t.query().frame().withColumn("n_rows", F.lit(t.row_count).cast("long"))


def _typed_reads(spark: SparkSession, d: str) -> DataFrame:
    t = _customer(spark, d)
    last = t.row_count - 1
    read = lambda i: {"row_index": i, "segment": t.get_value(i, "c_mktsegment"), "code": t.get_comparable_value(i, "c_mktsegment"), "acctbal": t.get_numeric_value(i, "c_acctbal")}
    return _local(spark, [read(i) for i in (0, 17, last)])


def _failure(call: Callable[[], object]) -> dict:
    """Code and details of the error that a call ends with."""
    try:
        call()
    except EngineError as e:
        details = e.details or {}
        return {"code": e.code, "col": details.get("column", ""), "key": details.get("key", -1), **{n: details.get(k, -1) for n, k in (("existing", "existingRowIndex"), ("input", "inputIndex"), ("conflicting", "conflictingInputIndex"))}, "operation": details.get("operation", "")}
    return {"code": "", "col": "", "key": -1, "existing": -1, "input": -1, "conflicting": -1, "operation": ""}


def _unique_errors(spark: SparkSession, d: str) -> DataFrame:
    """What the four checks of unique keys report; the table stays as it was."""
    t = _customer(spark, d).create_unique_index("c_custkey")
    row = {"c_custkey": 42, "c_nationkey": 1, "c_acctbal": 0.0, "c_mktsegment": "BUILDING"}
    fresh = [row | {"c_custkey": k} for k in (3_000_000_001, 3_000_000_002, 3_000_000_001)]
    calls = {
        "u1_insert": lambda: t.insert(row),
        "u2_insert_many": lambda: t.insert_many(fresh),
        "u3_update": lambda: t.update(0, {"c_custkey": 42}),
        "u3_update_many": lambda: t.update_many({"c_mktsegment": "BUILDING"}, {"c_custkey": 42}),
        "u4_create": lambda: t.create_unique_index("c_nationkey"),
    }
    out = [{"query": name} | _failure(call) for name, call in calls.items()]
    return _local(spark, [r | {"n_rows": t.query().count()} for r in out])


UNIQUE_ERRORS_SQL = """
WITH n AS (SELECT count(*) AS r, count(*) FILTER (c_custkey < 42) AS before FROM customer),
least AS (SELECT min(c_nationkey) AS k FROM (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1))
SELECT 'u1_insert' AS query, 'ROWLOOM_DUPLICATE_KEY' AS code, 'c_custkey' AS col, 42 AS key, before AS existing, -1 AS input, -1 AS conflicting, 'insert' AS operation, r AS n_rows FROM n
UNION ALL SELECT 'u2_insert_many', 'ROWLOOM_DUPLICATE_KEY', 'c_custkey', 3000000001, -1, 2, 0, 'insertMany', r FROM n
UNION ALL SELECT 'u3_update', 'ROWLOOM_DUPLICATE_KEY', 'c_custkey', 42, -1, -1, -1, 'update', r FROM n
UNION ALL SELECT 'u3_update_many', 'ROWLOOM_DUPLICATE_KEY', 'c_custkey', 42, -1, -1, -1, 'updateMany', r FROM n
UNION ALL SELECT 'u4_create', 'ROWLOOM_DUPLICATE_KEY', 'c_nationkey', k, -1, -1, -1, 'rebuildUniqueIndex', r FROM n, least
"""


def _error_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of calls that are refused."""
    t = _customer(spark, d)
    row = {"c_custkey": 5_000_000, "c_nationkey": 1, "c_acctbal": 0.0, "c_mktsegment": "BUILDING"}
    calls = {
        "unknown column": lambda: t.where("nope", "=", 1),
        "operator": lambda: t.where("c_mktsegment", ">", "BUILDING"),
        "empty list": lambda: t.where_in("c_custkey", []),
        "literal out of range": lambda: t.where("c_custkey", "=", -1),
        "literal not in dictionary": lambda: t.where("c_mktsegment", "=", "SHIPS"),
        "empty object": lambda: t.where({}),
        "limit": lambda: t.limit(-1),
        "offset": lambda: t.offset(0.5),
        "selection twice": lambda: t.select(["c_custkey", "c_custkey"]),
        "row index": lambda: t.get(t.row_count),
        "missing value": lambda: t.insert({"c_custkey": 1}),
        "type": lambda: t.insert(row | {"c_acctbal": "0"}),
        "empty patch": lambda: t.update(0, {}),
        "sum of text": lambda: t.sum("c_mktsegment"),
        "index twice": lambda: t.create_index("c_nationkey").create_index("c_nationkey"),
        "no unique index": lambda: t.find_by("c_custkey", 1),
        "snapshot": lambda: Table.deserialize(spark, b"ROWLOOM?"),
    }
    return _local(spark, [{"call": name, "code": _failure(call)["code"]} for name, call in calls.items()])


ERROR_CODES = {
    "unknown column": "INVALID_COLUMN", "operator": "INVALID_OPERATOR", "empty list": "TYPE_MISMATCH", "literal out of range": "OUT_OF_RANGE",
    "literal not in dictionary": "UNKNOWN_VALUE", "empty object": "INVALID_PREDICATE", "limit": "INVALID_LIMIT", "offset": "INVALID_OFFSET",
    "selection twice": "DUPLICATE_COLUMN", "row index": "INVALID_ROW_INDEX", "missing value": "MISSING_VALUE", "type": "TYPE_MISMATCH",
    "empty patch": "MISSING_VALUE", "sum of text": "INVALID_COLUMN_TYPE", "index twice": "INDEX_EXISTS", "no unique index": "UNIQUE_INDEX_NOT_FOUND",
    "snapshot": "INVALID_SERIALIZED_DATA",
}


def _predicate_order(spark: SparkSession, d: str) -> DataFrame:
    """The order in which a plan lists predicates: by cost, ties as written."""
    t = _customer(spark, d)
    q = t.where_not_in("c_nationkey", [1]).where("c_acctbal", "<", 10).where_in("c_custkey", [1, 2]).where("c_mktsegment", "!=", "BUILDING").where("c_acctbal", ">=", 0).where("c_nationkey", "=", 3)
    return _local(spark, [{"rank": i, "predicate": p} for i, p in enumerate(q.explain()["predicateOrder"])])


def _index_life(spark: SparkSession, d: str) -> DataFrame:
    """States of all kinds of indexes through mutations and rebuilds, and the planner's own view."""
    t = _customer(spark, d).create_index("c_mktsegment").create_sorted_index("c_acctbal").create_unique_index("c_custkey")
    out: list[dict] = []

    def note(step: str) -> None:
        for s in t.debug_index_diagnostics():
            out.append({"step": step, "kind": s["kind"], "col": s["column"], "state": s["state"], "reason": s.get("dirtyReason", "")})

    note("created")
    t.insert({"c_custkey": 4_000_000_000, "c_nationkey": 1, "c_acctbal": 0.5, "c_mktsegment": "BUILDING"})
    note("insert")
    t.update(0, {"c_mktsegment": "MACHINERY"})
    note("update")
    t.rebuild_indexes()
    note("rebuilt")
    t.delete_where("c_custkey", "=", 4_000_000_000)
    note("delete")
    t.rebuilds.submit("sorted", "c_acctbal").result()
    t.rebuild_unique_indexes()
    note("background")
    plan = t.where("c_acctbal", ">=", 1e6).debug_plan()
    out.append({"step": "plan", "kind": plan["source"], "col": plan["column"], "state": plan["mode"], "reason": ""})
    return _local(spark, out)


INDEX_LIFE = [
    ("created", "fresh", "", "fresh", "", "fresh", ""),
    ("insert", "fresh", "", "dirty", "insert", "fresh", ""),
    ("update", "dirty", "update", "dirty", "insert", "fresh", ""),
    ("rebuilt", "fresh", "", "fresh", "", "fresh", ""),
    ("delete", "dirty", "delete", "dirty", "delete", "dirty", "delete"),
    ("background", "dirty", "delete", "fresh", "", "fresh", ""),
]


def _values(columns: str, rows: list[tuple]) -> str:
    text = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {text}) AS v({columns})"


def _filtered(predicate: str) -> str:
    return f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM {O_SQL} WHERE {predicate}"


def _filter_query(*where) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: _orders(spark, d).where(*where).select(["o_orderkey", "o_orderstatus", "o_totalprice"]).frame()


_FILTERS = {
    "f1_eq": (("o_orderstatus", "=", "F"), "o_orderstatus = 'F'"),
    "f2_ne": (("o_orderstatus", "!=", "F"), "o_orderstatus <> 'F'"),
    "f3_gt": (("o_totalprice", ">", 200000.0), "o_totalprice > 200000"),
    "f4_gte": (("o_totalprice", ">=", 200000.0), "o_totalprice >= 200000"),
    "f5_lt": (("o_totalprice", "<", 50000.0), "o_totalprice < 50000"),
    "f6_lte": (("o_orderkey", "<=", 5000), "o_orderkey <= 5000"),
    "f7_in": (("o_custkey", "in", [1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144]), "o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)"),
    "f8_not_in": (("o_orderpriority", "not in", ["1-URGENT", "2-HIGH"]), "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    "f9_object": (({"o_orderstatus": {"in": ["F", "P"]}, "o_totalprice": {"gte": 1e5, "lt": 2e5}},), "o_orderstatus IN ('F', 'P') AND o_totalprice >= 100000 AND o_totalprice < 200000"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "flagship": flagship,
    **{k: _filter_query(*w) for k, (w, _) in _FILTERS.items()},
    "f3_float32": lambda s, d: _part(s, d).where("p_retailprice", ">", 950.1).where("p_size", "<=", 25).select(["p_partkey", "p_size"]).frame(),
    "f1_boolean": lambda s, d: _labels(s, d).where("toxic", "=", True).frame(),
    "f10_and": lambda s, d: _lineitem(s, d).where("l_returnflag", "=", "R").where("l_quantity", ">=", 45).where("l_discount", "<", 0.03).where_not_in("l_linenumber", [2, 3]).frame(),
    "f11_callback": lambda s, d: _orders(s, d).where("o_orderstatus", "=", "F").filter(lambda r: r["o_orderkey"] % 7 == 0).filter(lambda r: r["o_totalprice"] > 1e5).select(["o_orderkey"]).frame(),
    "p1_select": lambda s, d: _customer(s, d).select(["c_mktsegment", "c_custkey"]).frame(),
    "p2_limit": lambda s, d: _orders(s, d).limit(25).where("o_orderstatus", "=", "O").frame(),
    "p3_offset": lambda s, d: _orders(s, d).where("o_totalprice", ">", 1e5).offset(40).limit(30).select(["o_orderkey", "o_totalprice"]).frame(),
    "p3_offset_only": lambda s, d: _customer(s, d).offset(100).frame(),
    "p5_first": lambda s, d: _local(s, [_customer(s, d).where("c_acctbal", ">", 5000).first()]),
    "p6_for_each": _for_each,
    "p7_stream": _streamed,
    "scalars": _scalars,
    "a1_count": lambda s, d: _lineitem(s, d).where("l_returnflag", "=", "A").count_frame("n"),
    "a1_count_window": lambda s, d: _orders(s, d).where("o_orderstatus", "=", "F").offset(10).limit(500).count_frame("n"),
    "a3_sum": lambda s, d: _lineitem(s, d).where("l_linestatus", "=", "F").aggregate_frame({"keys": ("sum", "l_orderkey"), "quantity": ("sum", "l_quantity")}).select("keys", F.round("quantity", 2).alias("quantity")),
    "a3_sum_empty": lambda s, d: _orders(s, d).where("o_totalprice", "<", 0).aggregate_frame({"x": ("sum", "o_custkey"), "y": ("sum", "o_totalprice"), "z": ("max", "o_custkey")}),
    "a4_avg": lambda s, d: _orders(s, d).where("o_orderstatus", "=", "O").aggregate_frame({"x": ("avg", "o_custkey"), "y": ("avg", "o_totalprice")}).select(F.round("x", 4).alias("x"), F.round("y", 2).alias("y")),
    "a5_min": lambda s, d: _orders(s, d).where("o_orderstatus", "=", "P").aggregate_frame({"x": ("min", "o_totalprice"), "y": ("min", "o_orderdate")}),
    "a6_max": lambda s, d: _orders(s, d).offset(100).limit(1000).aggregate_frame({"x": ("max", "o_totalprice"), "n": ("count", "o_custkey")}),
    "a7_top": lambda s, d: _orders(s, d).where("o_orderstatus", "=", "F").select(["o_orderkey", "o_custkey"]).top_frame(20, "o_totalprice"),
    "a8_bottom": lambda s, d: _orders(s, d).limit(2000).select(["o_orderkey", "o_totalprice"]).top_frame(15, "o_totalprice", largest=False),
    "i2_insert_many": _insert_many,
    "i2_insert_frame": _insert_frame,
    "m1_positional": _positional,
    "m2_update": _update,
    "m2_update_window": _update_window,
    "m2_update_callback": _update_callback,
    "m5_update_by": lambda s, d: _by_key(s, d, "update"),
    "m7_delete": _delete,
    "m7_delete_window": _delete_window,
    "m10_delete_by": lambda s, d: _by_key(s, d, "delete"),
    "m11_find_by": lambda s, d: _by_key(s, d, "find"),
    "s5_index_scan": _indexed,
    "s9_roundtrip": _roundtrip,
    "x5_index_stats": _index_stats,
    "x8_explain": _explain_row,
    "x11_hook": _hooked,
    "s1_table": _table,
    "s1_many_files": _many_files,
    "s3_from_rows": lambda s, d: from_rows(s, NATION, _small(s, d, "nation", NATION)).where("n_regionkey", "=", 2).frame(),
    "s8_typed_reads": _typed_reads,
    "u_unique_errors": _unique_errors,
    "e_error_codes": _error_codes,
    "f12_predicate_order": _predicate_order,
    "m4_update_where": lambda s, d: (lambda t: _affected(s, "affected", t.update_where("c_acctbal", "<", 0, {"c_nationkey": 24}), t))(_customer(s, d)),
    "m9_delete_where": lambda s, d: (lambda t: _affected(s, "affected", t.delete_where("c_acctbal", "<", 0), t))(_customer(s, d)),
    "x_index_life": _index_life,
}

_C = "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer"

ORACLE_SQL: dict[str, str] = {
    "flagship": f"SELECT o_orderkey, o_custkey, o_totalprice FROM {O_SQL} WHERE o_orderstatus = 'F' AND o_totalprice >= 150000",
    **{k: _filtered(p) for k, (_, p) in _FILTERS.items()},
    "f3_float32": "SELECT p_partkey, p_size FROM part WHERE CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) > CAST(950.1 AS DOUBLE) AND p_size <= 25",
    "f1_boolean": "SELECT doc_id, quality, toxic = 1 AS toxic FROM labels WHERE toxic = 1",
    "f10_and": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45 AND l_discount < CAST(0.03 AS DOUBLE) AND l_linenumber NOT IN (2, 3)",
    "f11_callback": f"SELECT o_orderkey FROM {O_SQL} WHERE o_orderstatus = 'F' AND o_orderkey % 7 = 0 AND o_totalprice > 100000",
    "p1_select": "SELECT c_mktsegment, c_custkey FROM customer",
    "p2_limit": f"SELECT * FROM {O_SQL} WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 25",
    "p3_offset": f"SELECT o_orderkey, o_totalprice FROM {O_SQL} WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 30 OFFSET 40",
    "p3_offset_only": f"{_C} ORDER BY c_custkey OFFSET 100",
    "p5_first": f"{_C} WHERE c_acctbal > 5000 ORDER BY c_custkey LIMIT 1",
    "p6_for_each": f"SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS at FROM ({_C} WHERE c_nationkey < 3 ORDER BY c_custkey LIMIT 15)",
    "p7_stream": f"SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS at FROM ({_C} WHERE c_nationkey = 7 ORDER BY c_custkey LIMIT 20)",
    "scalars": SCALARS_SQL,
    "a1_count": "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'A'",
    "a1_count_window": "SELECT CAST(least(greatest(count(*) - 10, 0), 500) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'F'",
    "a3_sum": "SELECT CAST(sum(l_orderkey) AS BIGINT) AS keys, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_linestatus = 'F'",
    "a3_sum_empty": "SELECT CAST(0 AS BIGINT) AS x, CAST(0 AS DOUBLE) AS y, CAST(NULL AS BIGINT) AS z",
    "a4_avg": "SELECT round(avg(o_custkey), 4) AS x, round(avg(o_totalprice), 2) AS y FROM orders WHERE o_orderstatus = 'O'",
    "a5_min": f"SELECT min(o_totalprice) AS x, min(o_orderdate) AS y FROM {O_SQL} WHERE o_orderstatus = 'P'",
    "a6_max": f"SELECT max(o_totalprice) AS x, count(*) AS n FROM (SELECT * FROM {O_SQL} ORDER BY o_orderkey LIMIT 1000 OFFSET 100)",
    "a7_top": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "a8_bottom": "SELECT o_orderkey, o_totalprice FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 2000) ORDER BY o_totalprice, o_orderkey LIMIT 15",
    "i2_insert_many": f"{_C} UNION ALL SELECT 4000000000, -5, 0.5, 'BUILDING' UNION ALL SELECT 4000000000 + i, i, i / 4.0, 'MACHINERY' FROM (VALUES (1), (2), (3)) AS v(i)",
    "i2_insert_frame": f"{_C} UNION ALL SELECT c_custkey + 1000000, c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "m1_positional": f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM ({_C})), n AS (SELECT max(i) AS last FROM r)
        SELECT c_custkey, CASE WHEN i = 3 THEN 99 ELSE c_nationkey END AS c_nationkey, c_acctbal, c_mktsegment, CASE WHEN i = last THEN -1 ELSE i - 2 END AS at FROM r, n WHERE i IN (2, 3, last)""",
    "m2_update": f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 1.5 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS affected FROM {O_SQL}",
    "m2_update_window": f"WITH hit AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 50 OFFSET 5) SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT k FROM hit) THEN 7 ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, (SELECT count(*) FROM hit) AS affected FROM {O_SQL}",
    "m2_update_callback": "WITH hit AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 AND c_custkey % 3 = 0) SELECT c_custkey, CASE WHEN c_custkey IN (SELECT k FROM hit) THEN -1 ELSE c_nationkey END AS c_nationkey, c_acctbal, c_mktsegment, (SELECT count(*) FROM hit) AS affected FROM customer",
    "m5_update_by": "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey = 42 THEN 0.25 ELSE c_acctbal END AS c_acctbal, c_mktsegment, CAST(1 AS BIGINT) AS affected FROM customer",
    "m7_delete": f"SELECT *, (SELECT count(*) FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')) AS affected FROM {O_SQL} WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')",
    "m7_delete_window": f"WITH hit AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100 OFFSET 10) SELECT *, (SELECT count(*) FROM hit) AS affected FROM {O_SQL} WHERE o_orderkey NOT IN (SELECT k FROM hit)",
    "m10_delete_by": f"SELECT *, CAST(1 AS BIGINT) AS affected FROM ({_C}) WHERE c_custkey <> 42",
    "m11_find_by": f"{_C} WHERE c_custkey = 42",
    "s5_index_scan": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 90000",
    "s9_roundtrip": _C,
    "x5_index_stats": INDEX_STATS_SQL,
    "x8_explain": EXPLAIN_SQL,
    "x11_hook": HOOKED_SQL,
    "s1_table": "SELECT r_regionkey, r_name, 8 AS capacity, 'r_regionkey,r_name' AS columns FROM region",
    "s1_many_files": f"SELECT *, (SELECT count(*) FROM customer) AS n_rows FROM ({_C})",
    "s3_from_rows": "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2",
    "s8_typed_reads": """WITH r AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS row_index, count(*) OVER () AS n FROM customer)
        SELECT row_index, c_mktsegment AS segment, list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1 AS code, c_acctbal AS acctbal FROM r WHERE row_index IN (0, 17, n - 1)""",
    "u_unique_errors": UNIQUE_ERRORS_SQL,
    "e_error_codes": _values("call, code", [(k, f"ROWLOOM_{v}") for k, v in ERROR_CODES.items()]),
    "f12_predicate_order": _values("rank, predicate", list(enumerate(["c_nationkey =", "c_mktsegment !=", "c_acctbal <", "c_acctbal >=", "c_custkey in", "c_nationkey not in"]))),
    "m4_update_where": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 24 ELSE c_nationkey END AS c_nationkey, c_acctbal, c_mktsegment, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS affected FROM customer",
    "m9_delete_where": f"SELECT *, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS affected FROM ({_C}) WHERE c_acctbal >= 0",
    "x_index_life": _values(
        "step, kind, col, state, reason",
        [(step, kind, col, *states[2 * k : 2 * k + 2]) for step, *states in INDEX_LIFE for k, (kind, col) in enumerate((("equality", "c_mktsegment"), ("sorted", "c_acctbal"), ("unique", "c_custkey")))] + [("plan", "sorted", "c_acctbal", "index", "")],
    ),
}
