import pytest

from rowloom import UNSET, EngineError, Table, column
from rowloom.queries import QUERIES
from rowloom.sources import versions
from tests.helpers import OPS, SHIPMENTS, Lcg, fails, make, shipments


@pytest.fixture(scope="module")
def t(spark):
    return make(spark).cache()


ROWS = shipments(80)


@pytest.mark.parametrize(
    ("name", "op", "value"),
    [("weight", "=", 14), ("zone", "!=", "north"), ("weight", ">", 40), ("weight", ">=", 42), ("price", "<", 100), ("price", "<=", 130), ("id", "in", [3, 5, 5, 79]), ("zone", "not in", ["north"]), ("paid", "=", True)],
)
def test_operators(t, name, op, value):
    assert t.where(name, op, value).to_array() == [r for r in ROWS if OPS[op](r[name], value)]


def test_object_predicates(t):
    assert t.where({"zone": "north", "weight": {"gte": 18, "lt": 60}}).to_array() == [r for r in ROWS if r["zone"] == "north" and 18 <= r["weight"] < 60]
    assert t.where({"weight": UNSET, "id": {"in": [1, 2], "gt": UNSET}}).count() == 2
    for bad in ({}, {"weight": UNSET}, {"weight": {}}, {"weight": {"ne": 1}}, {"zone": {"gt": "a"}}):
        fails("INVALID_PREDICATE", lambda bad=bad: t.where(bad))
    fails("TYPE_MISMATCH", lambda: t.where({"weight": [1, 2]}))
    fails("INVALID_COLUMN", lambda: t.where({"nope": 1}))
    fails("TYPE_MISMATCH", lambda: t.where({"weight": None}))
    fails("UNKNOWN_VALUE", lambda: t.where({"zone": None}))


def test_literals_must_fit_the_column(t):
    fails("OUT_OF_RANGE", lambda: t.where("weight", ">=", 300))
    fails("TYPE_MISMATCH", lambda: t.where("weight", ">=", 18.5))
    fails("TYPE_MISMATCH", lambda: t.where("weight", "=", float("nan")))
    fails("TYPE_MISMATCH", lambda: t.where("weight", "=", True))
    fails("UNKNOWN_VALUE", lambda: t.where("zone", "=", "gone"))
    fails("INVALID_OPERATOR", lambda: t.where("zone", ">", "north"))
    fails("INVALID_OPERATOR", lambda: t.where("weight", "like", 3))
    fails("TYPE_MISMATCH", lambda: t.where_in("weight", []))
    fails("INVALID_COLUMN", lambda: t.where("toString", "=", 3))
    assert t.where("weight", "=", 14.0).count() == len([r for r in ROWS if r["weight"] == 14])


def test_the_builder_is_declarative(t):
    wanted = [r for r in ROWS if r["weight"] > 30]
    assert t.limit(10).where("weight", ">", 30).to_array() == wanted[:10]
    assert t.where("weight", ">", 30).offset(3).limit(99).limit(4).to_array() == wanted[3:7]
    assert t.select(["id"]).select(["price", "id"]).limit(2).to_array() == [{"price": r["price"], "id": r["id"]} for r in ROWS[:2]]
    assert list(t.limit(1).to_array()[0]) == list(SHIPMENTS)
    assert t.limit(0).to_array() == [] and t.limit(0).first() is None and t.limit(0).is_empty()


def test_windows_and_counts(t):
    q = t.where("zone", "=", "north")
    n = len([r for r in ROWS if r["zone"] == "north"])
    assert q.count() == q.size() == n
    assert q.offset(5).limit(10).count() == 10 and q.offset(n - 2).limit(10).count() == 2 and q.offset(1000).count() == 0
    assert q.offset(n).is_empty() and not q.offset(n - 1).is_empty()
    assert t.offset(78).to_array() == ROWS[78:]
    for bad in (-1, 1.5, "3", True):
        fails("INVALID_LIMIT", lambda bad=bad: t.limit(bad))
        fails("INVALID_OFFSET", lambda bad=bad: t.offset(bad))


def test_selection_errors(t):
    fails("INVALID_COLUMN", lambda: t.select([]))
    fails("INVALID_COLUMN", lambda: t.select(["nope"]))
    fails("DUPLICATE_COLUMN", lambda: t.select(["id", "id"]))


def test_aggregates(t):
    q = t.where("weight", ">", 30).offset(2).limit(20)
    rows = [r for r in ROWS if r["weight"] > 30][2:22]
    scores = [r["price"] for r in rows]
    assert (q.sum("price"), q.min("price"), q.max("price")) == (sum(scores), min(scores), max(scores))
    assert q.avg("price") == pytest.approx(sum(scores) / 20)
    none = t.where("id", "<", 0)
    assert (none.sum("price"), none.avg("price"), none.min("price"), none.max("price")) == (0, None, None, None)
    assert q.aggregate({"a": ("sum", "price"), "n": ("count", "price")}) == {"a": sum(scores), "n": 20}
    fails("INVALID_COLUMN_TYPE", lambda: t.sum("zone"))
    fails("INVALID_COLUMN", lambda: t.avg("nope"))


def test_top_and_bottom(t):
    by = sorted(ROWS, key=lambda r: (-r["price"], r["id"]))
    assert t.top(5, "price") == by[:5]
    assert t.select(["id"]).bottom(3, "price") == [{"id": r["id"]} for r in sorted(ROWS, key=lambda r: (r["price"], r["id"]))[:3]]
    assert t.limit(10).top(2, "price") == sorted(ROWS[:10], key=lambda r: (-r["price"], r["id"]))[:2]
    fails("INVALID_LIMIT", lambda: t.top(0, "price"))
    fails("INVALID_COLUMN_TYPE", lambda: t.bottom(1, "paid"))


def test_callbacks(t):
    q = t.where("weight", ">", 30).filter(lambda r: r["id"] % 2 == 0)
    rows = [r for r in ROWS if r["weight"] > 30 and r["id"] % 2 == 0]
    assert q.select(["id"]).to_array() == [{"id": r["id"]} for r in rows]
    assert q.count() == len(rows) and q.first() == rows[0] and q.offset(1).limit(2).to_array() == rows[1:3]
    # The second sees only rows that pass the first.
    assert t.filter(lambda r: r["id"] > 75).filter(lambda r: 1 / (r["id"] > 75) > 0).count() == 4
    fails("INVALID_PREDICATE", lambda: t.filter("weight > 3"))


def test_iteration_and_helpers(t):
    assert list(t.where("weight", ">", 80)) == [r for r in ROWS if r["weight"] > 80]
    seen = []
    t.where("weight", ">", 80).for_each(lambda row, i: seen.append((i, row["id"])))
    assert seen == list(enumerate(r["id"] for r in ROWS if r["weight"] > 80))
    assert t.first_where({"weight": {"gt": 80}}) == next(r for r in ROWS if r["weight"] > 80)
    assert t.first_where(lambda r: r["id"] == 9)["id"] == 9
    assert t.count_where("weight", ">", 80) == len(seen)
    assert t.exists({"id": 5}) and not t.exists("id", ">", 500)
    assert t.firstWhere({"id": 3})["id"] == 3 and t.rowCount == 80


def test_positions(t):
    assert t.get(0) == ROWS[0] and t.get(79.0) == ROWS[79] and t.get_value(3, "weight") == ROWS[3]["weight"]
    for i in range(0, 80, 11):
        assert t.get_comparable_value(i, "zone") == SHIPMENTS["zone"].values.index(ROWS[i]["zone"])
    for bad in (-1, 80, 1.5, "0", None):
        fails("INVALID_ROW_INDEX", lambda bad=bad: t.get(bad))
    fails("INVALID_COLUMN_TYPE", lambda: t.get_numeric_value(0, "zone"))


def test_queries_bind_late(spark):
    t = make(spark, shipments(3))
    q = t.where("id", ">=", 2)
    t.insert({"id": 9, "weight": 1, "price": 1, "zone": "north", "paid": False})
    assert [r["id"] for r in q.to_array()] == [2, 9]


def test_float32_keeps_the_literal(spark):
    t = Table.from_rows(spark, {"x": column.float32()}, [{"x": 0.1}, {"x": 0.5}])
    assert t.where("x", "=", 0.1).count() == 0 and t.where("x", "=", 0.5).count() == 1
    assert t.where("x", ">", 0.1).count() == 2


def test_negative_zero(spark):
    t = Table.from_rows(spark, {"x": column.float64()}, [{"x": -0.0}, {"x": 0.0}])
    assert t.where("x", "=", 0).count() == t.where("x", "in", [0.0]).count() == 2


def test_random_queries(spark):
    """Random predicates with every kind of index, against the lists."""
    rows = shipments(160)
    base = make(spark, rows).cache()
    rng = Lcg(0xC01C)
    for mode in range(4):
        t = base
        if mode & 1 and not t.has_index("zone"):
            t.create_index("zone").create_index("weight")
        if mode & 2 and not t.has_sorted_index("price"):
            t.create_sorted_index("price").create_sorted_index("weight")
        for _ in range(25):
            q, wanted = t.query(), rows
            for _ in range(1 + rng.below(3)):
                name = ["weight", "price", "zone", "paid", "id"][rng.below(5)]
                ops = ["=", "!=", "in", "not in"] + (["<", "<=", ">", ">="] if SHIPMENTS[name].kind == "numeric" else [])
                op = ops[rng.below(len(ops))]
                value = rows[rng.below(160)][name]
                value = [value, rows[rng.below(160)][name]] if op in ("in", "not in") else value
                q = q.where(name, op, value)
                wanted = [r for r in wanted if OPS[op](r[name], value)]
            if rng.below(2):
                o, n = rng.below(20), rng.below(30)
                q, wanted = q.offset(o).limit(n), wanted[o : o + n]
            assert q.to_array() == wanted
            assert q.count() == len(wanted)


def test_any_column_name(spark, tmp_path):
    names = ["a.b", "back`tick", "with space", "ünï", "select", "x(1)"]
    schema = {n: column.int32() for n in names}
    rows = [{n: (i * 7 + k) % 10 for k, n in enumerate(names)} for i in range(12)]
    t = Table.from_rows(spark, schema, rows)
    for n in names:
        assert t.where(n, ">=", 5).select([n]).to_array() == [{n: r[n]} for r in rows if r[n] >= 5]
        assert t.sum(n) == sum(r[n] for r in rows) and t.max(n) == max(r[n] for r in rows)
        assert t.top(1, n)[0][n] == max(r[n] for r in rows)
    t.create_index("a.b", clustered=True).create_sorted_index("back`tick")
    assert t.where("a.b", "=", 3).to_array() == [r for r in rows if r["a.b"] == 3]
    assert t.where("back`tick", "<", 2).count() == sum(r["back`tick"] < 2 for r in rows)
    t.update_many({"a.b": 3}, {"x(1)": -1})
    t.update(0, {"with space": 99})
    assert t.filter(lambda r: r["with space"] == 99).count() == 1
    t.save(str(tmp_path / "t"))
    assert Table.load(spark, str(tmp_path / "t")).to_array() == t.to_array()


def test_many_files(spark, tmp_path):
    """Files of one name in several folders, and names with spaces and other signs."""
    schema = {"k": column.uint32(), "a": column.uint8()}
    for a in (1, 2, 10):
        path = tmp_path / "in" / f"a={a}"
        spark.range(a * 100, a * 100 + 5).selectExpr("CAST(id AS INT) AS k").coalesce(1).write.parquet(str(path))
        (part,) = path.glob("part-*.parquet")
        part.rename(path / "part 0#%41é.parquet")
        for left in path.glob(".*crc"):
            left.unlink()
    t = Table.from_parquet(spark, str(tmp_path / "in"), schema)
    order = sorted((1, 2, 10), key=lambda a: f"a={a}/")
    assert t.to_array() == [{"k": k, "a": a} for a in order for k in range(a * 100, a * 100 + 5)]
    assert t.row_count == 15 and t.get(7) == t.to_array()[7] and t.offset(3).limit(4).to_array() == t.to_array()[3:7]


def scanned(df) -> int:
    """Rows that the file scans of a collected frame gave out."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_clustered_indexes_read_less(spark, monkeypatch):
    monkeypatch.setattr(versions, "FEW_ROWS", 100)
    rows = shipments(2000)
    t = Table.from_frame(spark.createDataFrame(rows, "id long, weight int, price long, zone string, paid boolean"), SHIPMENTS, ["id"])
    wanted = lambda: [r for r in rows if r["price"] < 60 and r["paid"]]
    plain = t.where("price", "<", 60).where("paid", "=", True)
    before = plain.frame()
    assert sorted(r["id"] for r in before.collect()) == [r["id"] for r in wanted()]
    t.create_sorted_index("price", clustered=True)
    after = plain.frame()
    assert sorted(r["id"] for r in after.collect()) == [r["id"] for r in wanted()]
    assert scanned(after) < 0.3 * scanned(before)
    assert plain.to_array() == wanted() and plain.offset(2).limit(3).to_array() == wanted()[2:5]
    # A changed row beside the copy; another version without one.
    t.update(wanted()[0]["id"], {"price": 5000})
    rows[wanted()[0]["id"]]["price"] = 5000
    assert plain.to_array() == wanted()
    t.update_many({"zone": "west"}, {"price": 7})
    rows = [r | {"price": 7} if r["zone"] == "west" else r for r in rows]
    assert plain.to_array() == wanted()
    t.create_index("zone", clustered=True)
    assert t.where("zone", "=", "west").where("weight", "=", 255).to_array() == [r for r in rows if r["zone"] == "west" and r["weight"] == 255]
    t.drop_index("zone").drop_sorted_index("price")
    assert plain.to_array() == wanted()


def test_registered_queries_check_the_large_tables(spark, tmp_path):
    spark.sql("SELECT 1 AS o_orderkey, 2 AS o_custkey, 'X' AS o_orderstatus, 3D AS o_totalprice, DATE '1995-01-01' AS o_orderdate, '5-LOW' AS o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql("SELECT 1 AS l_orderkey, 2 AS l_partkey, 3 AS l_suppkey, 1 AS l_linenumber, 4D AS l_quantity, 5D AS l_extendedprice, 0D AS l_discount, 'X' AS l_returnflag, 'F' AS l_linestatus").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.sql("SELECT 1 AS c_custkey, 2 AS c_nationkey, CAST('NaN' AS DOUBLE) AS c_acctbal, 'BUILDING' AS c_mktsegment").write.parquet(str(tmp_path / "customer.parquet"))
    for name in ("flagship", "a1_count", "x8_explain"):
        with pytest.raises(EngineError):
            QUERIES[name](spark, str(tmp_path)).collect()
