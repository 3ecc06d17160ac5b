import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from rowloom.llm import suffixes
from rowloom.llm.suffixes import SPAN


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - SPAN + 1):
            if i is not None:
                w = b[p : p + SPAN]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - SPAN + 1):
            if i is not None and first[b[p : p + SPAN]] < i:
                gone[p : p + SPAN] = b"\1" * SPAN
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in suffixes.substring_digests(docs).collect()), key=repr)


def corpus(seed):
    r = random.Random(seed)
    words = ["the", "of", "and", "schön", "ation", "re", "ça", "zzz", "x"]
    prose = lambda n: " ".join(r.choice(words) + r.choice(words) for _ in range(n))
    shared = [prose(r.randrange(4, 30)) for _ in range(6)]
    rows = []
    for i in range(120):
        kind = r.randrange(6)
        if kind == 0 and rows:
            text = r.choice(rows)[1]
        elif kind == 1 and rows and rows[-1][1]:
            old = r.choice(rows)[1] or ""
            at = r.randrange(len(old) + 1)
            text = old[:at] + r.choice(["", "!", prose(2)]) + old[at + r.randrange(3) :]
        else:
            text = " ".join(r.choice([prose(r.randrange(12)), r.choice(shared)]) for _ in range(r.randrange(6)))
        rows.append((i, text))
    rows += [(500, None), (501, ""), (502, "a" * 49), (503, "a" * 50), (504, "a" * 51), (505, "ab" * 400), (506, "ab" * 300), (507, "a" * 300), (508, "\0" * 120), (509, "\0" * 80), (510, "é" * 60)]
    rows += [(None, rows[3][1]), (7, rows[3][1]), (7, rows[7][1]), (600, "x" * 20000), (601, "y" + "x" * 20000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows) == brute(rows)


def test_many_small_blocks_and_buckets(spark, monkeypatch):
    small(monkeypatch)
    rows = corpus(9)
    assert found(spark, rows, 4) == brute(rows)


def small(monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 700)
    monkeypatch.setattr(suffixes, "HASH_BYTES", 2000)
    monkeypatch.setattr(suffixes, "RANGE_BYTES", 2000)
    monkeypatch.setattr(suffixes, "WAITING", 150)


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_leads_are_dealt_by_the_bytes_around_them(spark, monkeypatch, hot):
    small(monkeypatch)
    monkeypatch.setattr(suffixes, "HOT_LEAD", hot)
    r = random.Random(hot)
    passage = "a passage that very many documents have with other words around it, each"
    rows = corpus(4) + [(1000 + i, f"{r.random()} {passage} {r.random()}" + r.choice(["", " and more of it"])) for i in range(60)]
    assert found(spark, rows, 4) == brute(rows)


def test_hashes_decide_nothing(spark, monkeypatch):
    """With two bits of a hash nearly all leads agree by hash; the bytes tell them apart."""
    small(monkeypatch)
    monkeypatch.setattr(suffixes, "_width", lambda size, bits: max(2, bits))
    rows = corpus(5)
    assert found(spark, rows, 4) == brute(rows)


def test_a_bucket_of_hashes_is_not_in_memory_at_once():
    """Anchors of a bucket that nearly all have a lead of their own; one lead in ten comes again in the next task."""
    rng = np.random.default_rng(8)
    n, batches, wanted = 100_000, [], {}
    fresh = np.unique(rng.integers(0, 1 << 63, 8 * n, dtype=np.uint64) * np.uint64(2))
    fresh = rng.permutation(fresh)[: 6 * n].reshape(6, n)
    for k, leads in enumerate(fresh):
        if k:
            leads[: n // 10] = fresh[k - 1, n // 2 : n // 2 + n // 10]
            wanted.setdefault((k, 1), set()).update(range(n // 10))
            wanted.setdefault((k - 1, 1), set()).update(range(n // 2, n // 2 + n // 10))
        sender = suffixes._Sender(f"t{k}", 0, 64, 1 << 40)
        order = np.argsort(leads)
        assert not list(sender.add(1, leads[order], order)) + list(sender.add(2, leads[:0], order[:0]))
        batches += sender.flush()
    table = pa.Table.from_batches(batches)
    meet = suffixes._meet(suffixes.HOT_LEAD)
    tracemalloc.start()
    try:
        out = meet(table)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    found = {(int(b[1]), int(b[-1])): set(np.frombuffer(r["open"], np.uint32).tolist()) for r in out.to_pylist() if (b := r["block"])}
    assert found == {(k, b): wanted.get((k, b), set()) for k in range(6) for b in (1, 2)}
    assert most < 20 * 6 * n


def test_text_ids(spark):
    passage = "one passage that is much longer than fifty bytes, so it counts as a repeat"
    docs = spark.createDataFrame([("2", passage), ("10", passage), ("x", passage), (None, passage)], "doc_id string, text string")
    out = {r.doc_id: r.n_removed for r in suffixes.substring_digests(docs).collect()}
    assert out == {"2": 0, "10": len(passage), "x": 0, None: 0}


def test_empty_table(spark):
    assert found(spark, []) == []


def test_kept_documents(spark):
    passage = "one passage that is much longer than fifty bytes, so it counts as a repeat"
    rows = [(1, f"start {passage} end", "en", 5), (2, f"other {passage} tail", "en", 5), (3, passage, "de", 5), (4, "", None, 0), (5, None, "fr", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, n_chars long")
    out = {r.doc_id: r for r in suffixes.without_repeats(docs).collect()}
    assert out[1].text == rows[0][1] and out[2].text == "othertail"
    assert 3 not in out and out[4].text == "" and out[5].text is None
    assert out[2].n_chars == len(out[2].text) and out[2].block == "en"


def test_multikey_order():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 3, (4000, 30)).astype(np.uint8)
    rows[1000:2000] = rows[:1000]
    order = suffixes.multikey_order(rows)
    ordered = [rows[i].tobytes() for i in order]
    assert ordered == sorted(ordered)
    shared = suffixes.common_prefixes(rows, order)
    for k in range(1, 200):
        a, b = ordered[k - 1], ordered[k]
        assert shared[k] == next((j for j in range(30) if a[j] != b[j]), 30)
