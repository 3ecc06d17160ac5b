from pathlib import Path

import pytest

from rowloom import Table, column
from rowloom.operators import table
from rowloom.plans import windows
from rowloom.sources import versions
from tests.helpers import OPS, SHIPMENTS, Lcg, fails, make, shipments


def row(i, **more):
    return {"id": i, "weight": 1, "price": 2, "zone": "north", "paid": True} | more


def test_inserts(spark):
    t = make(spark, [])
    assert t.is_empty() and t.to_array() == []
    t.insert(row(1)).insert_many([row(2), row(3)]).insert_many([])
    assert [r["id"] for r in t] == [1, 2, 3] and t.row_count == 3
    before = t.to_array()
    e = fails("OUT_OF_RANGE", lambda: t.insert_many([row(4), row(5, weight=256)]))
    assert e.message.startswith("Invalid row at index 1:")
    fails("TYPE_MISMATCH", lambda: t.insert_many("rows"))
    fails("TYPE_MISMATCH", lambda: t.insert([1]))
    fails("MISSING_VALUE", lambda: t.insert({"id": 1}))
    fails("INVALID_COLUMN", lambda: t.insert(row(4, more=1)))
    fails("TYPE_MISMATCH", lambda: t.insert(row(4, weight=1.5)))
    fails("TYPE_MISMATCH", lambda: t.insert(row(4, weight=float("inf"))))
    fails("TYPE_MISMATCH", lambda: t.insert(row(4, paid=1)))
    fails("TYPE_MISMATCH", lambda: t.insert(row(4, id=True)))
    fails("UNKNOWN_VALUE", lambda: t.insert(row(4, zone="x")))
    assert t.to_array() == before


def test_many_small_inserts_and_capacity(spark):
    t = Table(spark, SHIPMENTS, 2)
    for i in range(12):
        t.insert(row(i))
        t.count_where("id", ">=", 0)
        assert t.first()["id"] == 0
    assert [r["id"] for r in t] == list(range(12)) and t.capacity == 16
    fails("INVALID_LIMIT", lambda: Table(spark, SHIPMENTS, 0))


def test_updates(spark):
    rows = shipments(30)
    t = make(spark, rows)
    assert t.update(3, {"weight": 99}) == {"affectedRows": 1}
    rows[3]["weight"] = 99
    assert t.where("zone", "=", "south").select(["id"]).update({"price": 7, "paid": False}) == {"affectedRows": sum(r["zone"] == "south" for r in rows)}
    rows = [r | {"price": 7, "paid": False} if r["zone"] == "south" else r for r in rows]
    assert t.to_array() == rows
    assert t.where("weight", ">", 10).offset(2).limit(4).update({"zone": "west"})["affectedRows"] == 4
    hit = [r["id"] for r in rows if r["weight"] > 10][2:6]
    rows = [r | {"zone": "west"} if r["id"] in hit else r for r in rows]
    assert t.filter(lambda r: r["id"] in (5, 6)).update({"weight": 0})["affectedRows"] == 2
    rows = [r | {"weight": 0} if r["id"] in (5, 6) else r for r in rows]
    assert t.update_many({"id": 500}, {"weight": 1}) == {"affectedRows": 0}
    # The matched set is that of before the update.
    assert t.update_where("weight", "<", 50, {"weight": 60})["affectedRows"] == len([r for r in rows if r["weight"] < 50])
    rows = [r | {"weight": 60} if r["weight"] < 50 else r for r in rows]
    assert t.to_array() == rows
    fails("MISSING_VALUE", lambda: t.update(0, {}))
    fails("OUT_OF_RANGE", lambda: t.update_many({"id": 500}, {"weight": 1000}))
    fails("INVALID_ROW_INDEX", lambda: t.update(30, {"weight": 1}))
    assert t.to_array() == rows


def test_deletes(spark):
    rows = shipments(30)
    t = make(spark, rows)
    t.delete(4).delete(4)
    del rows[4:6]
    assert t.get(4) == rows[4] and t.row_count == 28
    assert t.where("zone", "=", "north").offset(1).limit(3).delete() == {"affectedRows": 3}
    gone = [r["id"] for r in rows if r["zone"] == "north"][1:4]
    rows = [r for r in rows if r["id"] not in gone]
    assert t.delete_many({"weight": {"gt": 60}})["affectedRows"] == len([r for r in rows if r["weight"] > 60])
    rows = [r for r in rows if r["weight"] <= 60]
    other = rows[2]["id"]
    assert t.filter(lambda r: r["id"] == other).delete()["affectedRows"] == 1
    del rows[2]
    assert t.delete_where("id", "=", 999) == {"affectedRows": 0}
    t.insert(row(77))
    assert t.to_array() == [*rows, row(77)]
    assert t.query().delete()["affectedRows"] == len(rows) + 1 and t.is_empty()


def test_unique_keys(spark):
    t = make(spark, shipments(6)).create_unique_index("id")
    assert t.find_by("id", 4) == shipments(6)[4] and t.find_by("id", 40) is None
    e = fails("DUPLICATE_KEY", lambda: t.insert(row(3)))
    assert e.details["existingRowIndex"] == 3
    e = fails("DUPLICATE_KEY", lambda: t.insert_many([row(10), row(11), row(10)]))
    assert (e.details["inputIndex"], e.details["conflictingInputIndex"]) == (2, 0)
    t.insert(row(10))
    fails("DUPLICATE_KEY", lambda: t.insert(row(10)))
    fails("DUPLICATE_KEY", lambda: t.update(0, {"id": 3}))
    assert t.update(0, {"id": 0}) == {"affectedRows": 1}
    fails("DUPLICATE_KEY", lambda: t.update_many({"zone": "north"}, {"id": 50}))
    assert t.update_by("id", 5, {"id": 6, "weight": 3}) == {"affectedRows": 1} and t.find_by("id", 6)["weight"] == 3
    assert t.update_by("id", 500, {"weight": 3}) == {"affectedRows": 0}
    fails("OUT_OF_RANGE", lambda: t.update_by("id", 500, {"weight": 300}))
    assert t.delete_by("id", 2) == {"affectedRows": 1} and t.delete_by("id", 2) == {"affectedRows": 0}
    fails("UNIQUE_INDEX_NOT_FOUND", lambda: t.find_by("weight", 3))
    fails("DUPLICATE_KEY", lambda: t.create_unique_index("zone"))
    assert not t.has_unique_index("zone")


@pytest.mark.parametrize("seed", [0x2A, 0x7E57, 0xACE, 0x10AD, 0xF00])
def test_random_mutations(spark, seed):
    """A random trace of mutations, snapshots, key lookups and index changes against a list."""
    rng, rows = Lcg(seed), shipments(40)
    t, key = make(spark, rows).create_unique_index("id"), 1000
    for step in range(40):
        kind = rng.below(10)
        if kind == 0:
            fresh = [row(key + k, weight=rng.below(90), zone=SHIPMENTS["zone"].values[rng.below(3)]) for k in range(1 + rng.below(3))]
            key += 3
            t.insert_many(fresh)
            rows = rows + fresh
        elif kind == 1 and rows:
            i, patch = rng.below(len(rows)), {"price": rng.below(5000)}
            t.update(i, patch)
            rows = [r | patch if k == i else r for k, r in enumerate(rows)]
        elif kind in (2, 3):
            op, value = ["<", ">=", "=", "!="][rng.below(4)], rng.below(90)
            hit = [r["id"] for r in rows if OPS[op](r["weight"], value)]
            q = t.where("weight", op, value)
            if rng.below(2):
                o, n = rng.below(4), rng.below(6)
                q, hit = q.offset(o).limit(n), hit[o : o + n]
            if kind == 2:
                assert q.update({"paid": False, "weight": 33})["affectedRows"] == len(hit)
                rows = [r | {"paid": False, "weight": 33} if r["id"] in hit else r for r in rows]
            elif len(hit) < len(rows) // 2:
                assert q.delete()["affectedRows"] == len(hit)
                rows = [r for r in rows if r["id"] not in hit]
        elif kind == 4 and rows:
            i = rng.below(len(rows))
            t.delete(i)
            del rows[i]
        elif kind == 5:
            t = Table.deserialize(spark, t.serialize()).create_unique_index("id")
        elif kind == 6:
            t.drop_index("zone") if t.has_index("zone") else t.create_index("zone", clustered=bool(rng.below(2)))
        elif kind == 8 and rows:
            i, patch = rng.below(len(rows)), {"weight": rng.below(256)}
            assert t.find_by("id", rows[i]["id"]) == rows[i]
            assert t.update_by("id", rows[i]["id"], patch) == {"affectedRows": 1}
            rows = [r | patch if k == i else r for k, r in enumerate(rows)]
        elif kind == 9 and rows:
            i, other = rng.below(len(rows)), rng.below(len(rows))
            fails("DUPLICATE_KEY", lambda k=rows[i]["id"]: t.insert(row(k)))
            if i != other:
                fails("DUPLICATE_KEY", lambda i=i, k=rows[other]["id"]: t.update(i, {"id": k}))
            assert t.delete_by("id", rows[i]["id"]) == {"affectedRows": 1} and t.delete_by("id", rows[i]["id"]) == {"affectedRows": 0}
            del rows[i]
        else:
            t.drop_sorted_index("weight") if t.has_sorted_index("weight") else t.create_sorted_index("weight")
        if step % 3 == 0:
            assert t.to_array() == rows, step
            assert t.where("zone", "=", "north").count() == len([r for r in rows if r["zone"] == "north"])
            assert t.where("weight", ">=", 40).count() == len([r for r in rows if r["weight"] >= 40])
            assert t.where("zone", "=", "west").to_array() == [r for r in rows if r["zone"] == "west"]
            assert not rows or t.get(len(rows) // 2) == rows[len(rows) // 2]
    assert t.to_array() == rows and t.row_count == len(rows)


def folders(spark):
    """Folders of versions in the shared folder."""
    return {p.name for p in Path(versions.folder(spark).removeprefix("file:")).iterdir() if p.name.startswith("table-")}


def test_versions_do_not_pile_up(spark):
    t = make(spark, shipments(30))
    t.create_index("zone", clustered=True)
    before = folders(spark)
    for k in range(8):
        assert t.update_many({"id": 500}, {"weight": 1}) == {"affectedRows": 0}
        assert t.delete_many({"id": 500}) == {"affectedRows": 0}
    assert folders(spark) == before
    frames = []
    for k in range(8):
        t.update_many({"zone": "south"}, {"weight": k})
        frames.append(t.query().frame())
        frames[max(0, k - table.KEPT_VERSIONS)].collect()
    assert len(folders(spark) - before) <= table.KEPT_VERSIONS + 1
    t.release()
    assert not folders(spark) - before


def test_changes_of_one_row_write_nothing(spark, monkeypatch):
    monkeypatch.setattr(table, "MOST_HELD", 6)
    rows = shipments(30)
    t = make(spark, rows).create_unique_index("id")
    t.frame()
    before = folders(spark)
    t.update(3, {"weight": 9})
    t.update(3, {"price": 11})
    t.delete(5)
    t.update_by("id", 20, {"zone": "west"})
    t.delete_by("id", 3)
    assert folders(spark) == before
    rows = [r | ({"zone": "west"} if r["id"] == 20 else {}) for r in rows if r["id"] not in (3, 5)]
    assert t.to_array() == rows and [t.get(i) for i in (0, 3, 17, 27)] == [rows[i] for i in (0, 3, 17, 27)]
    assert t.where("zone", "=", "west").count() == sum(r["zone"] == "west" for r in rows)
    for i in range(0, 20, 2):
        t.update(i, {"weight": i})
        rows[i] = rows[i] | {"weight": i}
    assert len(folders(spark) - before) >= 1 and t.to_array() == rows
    t.insert(row(500))
    t.update(len(rows), {"weight": 77})
    assert t.to_array() == [*rows, row(500, weight=77)]


def test_windows_over_gaps(spark, monkeypatch):
    """Large windows are ranges of places: nothing is gathered in one task."""
    monkeypatch.setattr(windows, "TAKEN_ROWS", 5)
    monkeypatch.setattr(windows, "BLOCK_BITS", 3)
    monkeypatch.setattr(windows, "MOST_BLOCKS_BITS", 40)
    rows = shipments(70)
    t = make(spark, rows)
    for gaps in range(3):
        kept = [r for r in rows if r["weight"] > 20]
        for o, n in ((0, None), (3, None), (0, 7), (10, 20), (60, 30), (69, None), (70, 5), (1000, None)):
            end = None if n is None else o + n
            q, w = t.offset(o), t.where("weight", ">", 20).offset(o)
            q, w = (q, w) if n is None else (q.limit(n), w.limit(n))
            assert q.to_array() == rows[o:end] and w.to_array() == kept[o:end]
            assert [r.asDict() for r in w.frame().collect()] == kept[o:end] and w.sum("price") == sum(r["price"] for r in kept[o:end])
            plan = w.frame()._jdf.queryExecution().executedPlan().toString()
            assert "CollectLimit -1" not in plan and "GlobalLimit" not in plan.replace("GlobalLimit 0", "")
        assert [t.get(i) for i in range(0, len(rows), 9)] == rows[::9]
        for i in (50, 49, 8, 0):
            t.delete(i)
            del rows[i]
        t.delete_many({"id": {"in": [30, 31, 32]}})
        rows = [r for r in rows if r["id"] not in (30, 31, 32)]


def test_insert_frame(spark):
    t = make(spark, shipments(5)).create_unique_index("id")
    more = spark.createDataFrame([(12, 3, 4, "north", True), (11, 5, 6, "south", False)], "id long, weight int, price long, zone string, paid boolean")
    t.insert_frame(more, ["id"])
    assert [r["id"] for r in t] == [0, 1, 2, 3, 4, 11, 12] and t.row_count == 7
    fails("DUPLICATE_KEY", lambda: t.insert_frame(more, ["id"]))
    fails("OUT_OF_RANGE", lambda: t.insert_frame(more.selectExpr("id + 100 AS id", "999 AS weight", "price", "zone", "paid"), ["id"]))
    assert t.row_count == 7
    t.insert(row(13))
    assert t.get(7)["id"] == 13


def test_stream_inserts(spark, tmp_path):
    from rowloom.streaming.ingest import insert_stream

    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 0.5), (2, 1.5)], "k long, x double").write.parquet(source)
    t = Table(spark, {"k": column.uint32(), "x": column.float64()})
    stream = spark.readStream.schema("k long, x double").parquet(source)
    insert_stream(t, stream, ["k"], str(tmp_path / "cp")).awaitTermination()
    assert t.to_array() == [{"k": 1, "x": 0.5}, {"k": 2, "x": 1.5}]


def test_stream_batches_are_inserted_once(spark, tmp_path):
    """A batch that comes again after a restart, with new state on the driver, changes nothing."""
    from rowloom.streaming.ingest import insert_stream

    source, checkpoint = str(tmp_path / "in"), tmp_path / "cp"
    spark.createDataFrame([(1, 0.5)], "k long, x double").write.parquet(source)
    t = Table(spark, {"k": column.uint32(), "x": column.float64()})
    run = lambda: insert_stream(t, spark.readStream.schema("k long, x double").parquet(source), ["k"], str(checkpoint)).awaitTermination()
    run()
    # As if the engine had stopped between the insert and its own note of it.
    for note in (checkpoint / "commits").glob("*"):
        note.unlink()
    for note in (checkpoint / "commits").glob(".*"):
        note.unlink()
    run()
    assert t.to_array() == [{"k": 1, "x": 0.5}]
    spark.createDataFrame([(2, 1.5)], "k long, x double").write.mode("append").parquet(source)
    run()
    assert [r["k"] for r in t] == [1, 2]


def test_schema_errors(spark):
    fails("INVALID_SCHEMA", lambda: Table(spark, {}))
    fails("INVALID_SCHEMA", lambda: Table(spark, None))
    fails("INVALID_COLUMN_TYPE", lambda: Table(spark, {"a": 3}))
    fails("INVALID_COLUMN", lambda: Table(spark, {"": column.int32()}))
    fails("INVALID_COLUMN", lambda: Table(spark, {"x": column.int32(), "X": column.int32()}))
    fails("INVALID_SCHEMA", lambda: column.dictionary([]))
    fails("INVALID_SCHEMA", lambda: column.dictionary([1]))
    fails("DUPLICATE_COLUMN", lambda: column.dictionary(["a", "a"]))
    with pytest.raises(AttributeError):
        column.int64()
