import threading

from rowloom import Table
from rowloom.operators import background
from rowloom.plans import indexes
from tests.helpers import SHIPMENTS, fails, make, shipments


def test_explain_contract(spark):
    rows = shipments(100)
    t = make(spark, rows)
    assert t.query().explain() | {"reason": ""} == {"scanType": "full", "indexesUsed": [], "predicates": 0, "predicateOrder": [], "projectionPushdown": False, "reasonCode": "NO_PREDICATES", "reason": ""}
    assert t.where("weight", "=", 7).explain()["reasonCode"] == "NO_INDEX_FOR_COLUMN"
    assert t.where("weight", ">", 7).explain()["reasonCode"] == "RANGE_QUERY_WITHOUT_SORTED_INDEX"
    assert t.where("weight", "!=", 7).explain()["reasonCode"] == "UNSUPPORTED_INDEX_OPERATOR"
    assert t.filter(lambda r: True).where("weight", "=", 7).explain()["reasonCode"] == "CALLBACK_PREDICATE_REQUIRES_FULL_SCAN"
    t.create_index("zone").create_index("weight").create_sorted_index("weight").create_sorted_index("price")
    some = sorted({u["weight"] for u in rows if 0 < u["weight"] < 255}, key=lambda w: sum(u["weight"] == w for u in rows))[:2]
    e = t.where("zone", "=", "north").where("price", "<", 800).where("weight", "in", some).select(["id"]).explain()
    few = len([u for u in rows if u["weight"] in some])
    assert (e["scanType"], e["selectedIndex"], e["candidateRows"], e["indexState"]) == ("index", "equality:weight", few, "fresh")
    assert e["predicateOrder"] == ["zone =", "price <", "weight in"] and e["projectionPushdown"] and "reasonCode" not in e
    e = t.where("weight", ">=", 5).explain()
    assert e["reasonCode"] == "INDEX_CANDIDATE_SET_TOO_LARGE" and e["candidateRows"] > 40 and e["scanType"] == "full"
    assert t.where("weight", "=", next(w for w in range(256) if w not in {u["weight"] for u in rows})).explain()["scanType"] == "index"


def test_exactly_the_largest_share_uses_the_index(spark):
    rows = [u | {"zone": "north" if u["id"] < 40 else "south"} for u in shipments(100)]
    t = make(spark, rows).create_index("zone")
    assert t.where("zone", "=", "north").explain()["scanType"] == "index"
    t.insert_many([u | {"id": 200, "zone": "north"} for u in shipments(1)])
    assert t.where("zone", "=", "north").explain()["scanType"] == "full"


def test_life_cycle(spark):
    t = make(spark).create_index("zone").create_sorted_index("weight").create_unique_index("id")
    states = lambda: {(s["kind"], s["column"]): s["state"] for s in t.debug_index_diagnostics()}
    t.insert(shipments(200)[150])
    assert states() == {("equality", "zone"): "fresh", ("sorted", "weight"): "dirty", ("unique", "id"): "fresh"}
    e = t.where("weight", "<", 5).explain()
    assert (e["indexState"], e["fallbackReason"], e["reasonCode"]) == ("dirty", "dirty-index", "INDEX_DIRTY_WOULD_REBUILD_ON_EXECUTION") and "candidateRows" not in e
    assert states()[("sorted", "weight")] == "dirty"
    t.where("zone", "=", "north").count()
    assert states()[("sorted", "weight")] == "dirty"
    t.where("weight", "<", 5).count()
    assert states()[("sorted", "weight")] == "fresh"
    t.update(0, {"zone": "south"})
    assert states() == {("equality", "zone"): "dirty", ("sorted", "weight"): "fresh", ("unique", "id"): "fresh"}
    t.update_many({"id": 9999}, {"weight": 3})
    assert states()[("sorted", "weight")] == "fresh"
    t.delete(0)
    assert states() == {("equality", "zone"): "dirty", ("sorted", "weight"): "dirty", ("unique", "id"): "fresh"}
    t.delete_many({"id": 5})
    assert states()[("unique", "id")] == "dirty"
    t.query().count()
    assert states()[("equality", "zone")] == "fresh" and states()[("sorted", "weight")] == "dirty"
    assert t.unique_index_stats()[0]["uniqueValues"] == t.row_count and states()[("unique", "id")] == "fresh"
    assert t.where("zone", "=", "north").count() == len([r for r in t.to_array() if r["zone"] == "north"])


def test_index_errors_and_stats(spark):
    t = make(spark).create_index("zone")
    fails("INDEX_EXISTS", lambda: t.create_index("zone"))
    fails("INDEX_NOT_FOUND", lambda: t.drop_index("weight"))
    fails("INDEX_UNSUPPORTED_COLUMN", lambda: t.create_index("paid"))
    fails("SORTED_INDEX_UNSUPPORTED_COLUMN", lambda: t.create_sorted_index("zone"))
    fails("SORTED_INDEX_NOT_FOUND", lambda: t.rebuild_sorted_index("weight"))
    fails("UNIQUE_INDEX_UNSUPPORTED", lambda: t.create_unique_index("paid"))
    fails("UNIQUE_INDEX_NOT_FOUND", lambda: t.drop_unique_index("id"))
    fails("INVALID_COLUMN", lambda: t.create_index("nope"))
    assert t.index_stats() == [{"column": "zone", "uniqueValues": 3, "rowCount": 80, "memoryBytesApprox": 80 * 4 + 3 * 32}]
    t.create_sorted_index("weight")
    assert t.sorted_index_stats() == [{"column": "weight", "rowCount": 80, "memoryBytesApprox": 320, "dirty": False}]
    assert t.indexes() == ["zone"] and t.sorted_indexes() == ["weight"] and t.has_index("zone") and not t.has_index("weight")
    t.drop_index("zone").rebuild_indexes()
    assert t.indexes() == []


def test_hook_and_counters(spark):
    seen = []
    t = make(spark, on_query=seen.append)
    t.where("id", ">=", 10).limit(1).to_array()
    assert seen[-1]["rowsScanned"] == 11 and seen[-1]["resultCount"] == 1 and seen[-1]["materializedRows"] == 1
    t.where("id", ">=", 10).first()
    t.where("id", ">", 70).count()
    t.sum("weight")
    assert [s.get("resultCount") for s in seen[1:]] == [1, 9, None]
    assert seen[2]["scanType"] == "full" and seen[2]["rowsScanned"] == 80 and seen[2]["backgroundRebuildScheduled"] is False
    n = len(seen)
    list(t.stream()), t.get(0), t.is_empty(), t.update(0, {"weight": 1}), t.delete(0)
    assert len(seen) == n
    t.where("id", "=", 5).update({"weight": 2})
    assert seen[-1]["resultCount"] == 1
    t.create_index("id")
    t.update(0, {"id": 999})
    t.where("id", "=", 999).count()
    assert seen[-1]["dirtyIndexRebuildPaid"] and seen[-1]["dirtyIndexReason"] == "equality" and seen[-1]["indexUsed"]
    t.reset_scan_counter()
    assert t.scanned_row_count == 0


def test_background_rebuilds(spark, monkeypatch):
    t = make(spark).create_index("zone")
    t.update(0, {"zone": "south"})
    assert t.rebuilds.submit("equality", "zone").result(60)
    assert t.where("zone", "=", "south").explain()["indexState"] == "fresh" or t.where("zone", "=", "south").explain()["scanType"] == "full"
    gate, slow = threading.Event(), background.indexes.histogram
    monkeypatch.setattr(background.indexes, "histogram", lambda *a: (gate.wait(60), slow(*a))[1])
    future = t.rebuilds.submit("equality", "zone")
    e = t.where("zone", "=", "north").explain()
    assert e["backgroundRebuildState"] in ("queued", "rebuilding") and e["backgroundIndexing"] == "sync" and e["scanType"] == "full"
    t.registry.by_kind["equality"]["zone"].mark_dirty("update")
    gate.set()
    assert future.result(60) is False and t.debug_index_diagnostics()[0]["staleResultsDiscarded"] == 1
    monkeypatch.setattr(background.indexes, "histogram", lambda *a: 1 / 0)
    fails("BACKGROUND_REBUILD_FAILED", lambda: t.rebuilds.submit("equality", "zone").result(60))
    assert t.where("zone", "=", "north").explain()["fallbackReason"] == "failed-index"


def test_explain_starts_no_job(spark):
    t = make(spark).create_index("zone").create_sorted_index("weight")
    t.frame()
    spark.sparkContext.setJobGroup("explain", "explain")
    t.where("zone", "=", "north").where("weight", ">", 3).explain()
    t.index_stats(), t.sorted_index_stats()
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("explain")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    make(spark).save(path)
    t = Table.load(spark, path)
    plan = t.where("weight", ">", 50).select(["id"]).frame()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(weight,50)" in plan and "price" not in plan.split("ReadSchema")[1]
    assert t.to_array() == shipments(80) and list(t.schema) == list(SHIPMENTS)


def test_low_level_surface(spark):
    t = make(spark).create_index("zone")
    made = t.create_filter("zone", "=", "west")
    rows = shipments(80)
    for i in (0, 1, 2, 40, 79):
        assert t.matches_filter(i, made) == (rows[i]["zone"] == "west")
    plan = t.get_indexed_candidate_plan((made,))
    assert plan["candidateRows"] == plan["places"].count() == sum(r["zone"] == "west" for r in rows) and plan["operator"] == "="
    assert t.get_index_debug_plan(())["reasonCode"] == "NO_PREDICATES" and t.get_indexed_candidate_plan(()) is None
    assert t.materialize_row(1, ["id"]) == {"id": 1} and not t.has_query_hook()
    before = t.scanned_row_count
    t.record_row_scan()
    t.record_row_scans(4)
    assert t.scannedRowCount == before + 5


def test_estimates_and_stats_are_the_same_at_every_size(spark, monkeypatch):
    rows = [u | {"price": (u["id"] * 37) % 211 * 10} for u in shipments(400)]
    small = make(spark, rows).create_index("price").create_index("zone").create_sorted_index("price").create_unique_index("id")
    monkeypatch.setattr(indexes, "MAX_VALUES", 50)
    monkeypatch.setattr(indexes, "BLOCK_VALUES", 30)
    large = make(spark, rows).create_index("price").create_index("zone").create_sorted_index("price").create_unique_index("id")
    blocks = large.registry.by_kind["sorted"]["price"].values
    assert isinstance(blocks, indexes.Blocks) and len(blocks.names) > 3
    large.frame()
    spark.sparkContext.setJobGroup("large", "large")
    for op in ("<", "<=", ">", ">="):
        for value in (0, 5, 10, 700, 1234, 2090, 2100, 2101, 5000):
            assert large.where("price", op, value).explain() == small.where("price", op, value).explain()
    for value in range(0, 2120, 5):
        assert large.where("price", "=", value).explain() == small.where("price", "=", value).explain()
    asked = [2100, 10, 3, 770, 1500]
    assert large.where("price", "in", asked).explain() == small.where("price", "in", asked).explain()
    assert large.index_stats() == small.index_stats() and large.index_stats()[0]["uniqueValues"] == 211
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("large")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    more = [u | {"id": 1000 + u["id"], "price": s} for u, s in zip(shipments(4), (10, 3, 3, 3000), strict=True)]
    for t in (small, large):
        t.insert_many(more)
    assert large.index_stats() == small.index_stats() and large.index_stats()[0]["uniqueValues"] == 213
    for value in (10, 3, 3000, 20):
        assert large.where("price", "=", value).explain() == small.where("price", "=", value).explain()
        assert large.where("price", "=", value).count() == small.where("price", "=", value).count()
