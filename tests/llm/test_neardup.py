import random
from collections import Counter

import numpy as np
import pytest

from rowloom.llm import neardup


def bag(text):
    w = (text or "").encode().lower().split()
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def jaccard(a, b):
    low = sum((a & b).values())
    return low / max(1, sum(a.values()) + sum(b.values()) - low)


def brute(rows):
    """Least id of each group, by comparing all pairs."""
    bags = {i: bag(t) for i, t in rows}
    label = {i: i for i in bags}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if bags[a] and bags[b] and jaccard(bags[a], bags[b]) >= 0.8:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


def corpus(seed):
    r = random.Random(seed)
    rows, i = [], 0
    for _ in range(25):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(3, 300))]
        for _ in range(r.choice([1, 1, 2, 6])):
            rows.append((i, " ".join(edited(r, base, len(base) * r.choice([0, 1, 2, 3]) // 100))))
            i += 1
    hub = [f"h{r.randrange(10**5)}" for _ in range(300)]
    rows += [(1000 + k, " ".join(edited(r, hub, r.choice([3, 6, 7, 8])))) for k in range(60)] + [(2000, " ".join(hub))]
    rows += [(3000, "a b c"), (3001, "A  b\tC"), (3002, "a b c d"), (3003, ""), (3004, None), (3005, ""), (3006, "x y z v w " * 3000), (3007, "x y z v w " * 2990)]
    rows += [(3008, "m n o p q " * 40), (3009, "m n o p q " * 60)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    out = neardup.near_duplicates(docs).collect()
    assert {r.doc_id: r.class_id for r in out} == brute(rows)
    assert len(out) == len(rows) and all(r.kept == (r.doc_id == r.class_id) for r in out)


def test_estimate_is_unbiased():
    r = random.Random(4)
    errors = []
    for _ in range(40):
        a = Counter({k: r.randrange(1, 6) for k in range(120)})
        b = Counter({k: max(1, n + r.choice([0, 0, 1, -1])) for k, n in a.items() if r.random() < 0.9})
        owner = np.repeat([0, 1], [len(a), len(b)])
        h = neardup.mix(np.array([*a, *b], np.uint64) + np.uint64(77 + r.randrange(10**9)) * np.uint64(1 << 20))
        sig = neardup.signatures(owner, h, np.array([*a.values(), *b.values()]), 2)
        errors.append((sig[0] == sig[1]).mean() - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.03
    assert np.std(errors) < 0.09


def test_overlap():
    def packed(counts):
        h = np.array(sorted(counts), np.uint64) << np.uint64(16)
        return neardup._unpacked(memoryview(neardup._packed(h, np.array([counts[k] for k in sorted(counts)]))))

    a, b = packed({1: 3, 5: 1, 9: 1}), packed({1: 2, 5: 1, 7: 1})
    assert neardup.overlap(a, b) == 3 / 6
    assert neardup.overlap(a, a) == 1
    # Counts have no bound.
    assert neardup.overlap(packed({1: 200_000}), packed({1: 190_000})) == 0.95
    assert neardup.overlap(packed({1: 5_000_000_000, 2: 1}), packed({1: 4_000_000_000, 3: 1})) == pytest.approx(0.8, abs=1e-6)


def test_very_many_copies_of_a_shingle(spark):
    rows = [(0, "a " * 200_004), (1, "a " * 190_004), (2, "a " * 140_004), (3, "b " * 200_004)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in out} == {0: 0, 1: 0, 2: 2, 3: 3}


def core_corpus():
    """Texts that share most of their words with all others, a few near copies among them."""
    r = random.Random(12)
    core = [f"c{k}" for k in range(220)]
    rows = []
    for k in range(160):
        own = [f"o{r.randrange(10**9)}" for _ in range(55)]
        rows.append((k, " ".join(core + own)))
        if k % 16 == 0:
            rows.append((1000 + k, " ".join(edited(r, core + own, 4))))
        if k % 40 == 0:
            rows += [(2000 + 10 * k + j, " ".join(edited(r, core + own, 5))) for j in range(8)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("small", "few", "part"), [(20, 32, 250), (20, 2, 3), (10**6, 32, 250)])
def test_large_buckets_of_different_groups(spark, monkeypatch, small, few, part):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    monkeypatch.setattr(neardup, "FEW_NODES", few)
    monkeypatch.setattr(neardup, "PART_NODES", part)
    monkeypatch.setattr(neardup, "HOT_PAIRS", 7)
    rows = core_corpus()
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.class_id for r in out} == brute(rows)


def test_rows_of_a_large_bucket_grow_with_it(spark, monkeypatch):
    """Twice the texts with a common core: no more than twice the rows behind the buckets, and no task of a bucket."""
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 50)
    seen = []
    links = neardup._by_rare_shingles
    monkeypatch.setattr(neardup, "_by_rare_shingles", lambda *args: (seen.append(args[0].count()), links(*args))[1])
    tokens = neardup.stash
    kept = []
    monkeypatch.setattr(neardup, "stash", lambda df, name: (lambda out: (kept.append(out.count()) if name == "neardup-tokens" else None, out)[1])(tokens(df, name)))
    r = random.Random(3)
    core = [f"c{k}" for k in range(220)]
    for n in (100, 200):
        rows = [(k, " ".join(core + [f"o{r.randrange(10**9)}" for _ in range(55)])) for k in range(n)]
        out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert all(x.kept for x in out)
    # Rare shingles are each text's own: none is left that two groups share.
    assert seen[0] > 50 and seen[1] <= 2.5 * seen[0] and kept == [0, 0]


def test_ids_that_are_no_numbers(spark):
    text = " ".join(map(str, range(50)))
    rows = [("1", text), ("2", text), ("x", text), (None, text), ("x", "other")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(((r.doc_id, r.class_id, r.kept) for r in out), key=repr) == sorted([("1", 1, True), ("2", 1, False), ("x", None, True), ("x", None, True), (None, None, True)], key=repr)


def test_nulls_and_repeats(spark):
    text = " ".join(map(str, range(50)))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None)]
    out = sorted(((r.doc_id, r.class_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert out == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (None, None, True)], key=repr)
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_id_for_several_texts(spark):
    """Near copies of every text of an id are in the id's group, and so are their own near copies."""
    r = random.Random(8)
    base = [[f"w{r.randrange(10**6)}" for _ in range(200)] for _ in range(6)]
    near = lambda k: " ".join(edited(r, base[k], 2))
    rows = [(50, " ".join(words)) for words in base[:4]] + [(50, " ".join(base[0]))]
    rows += [(60 + k, near(k)) for k in range(5)] + [(10, near(2)), (70, near(5)), (71, " ".join(base[5]))]
    # Two ids that share no text but a third one's.
    rows += [(80, near(4)), (80, " ".join(base[5]))]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.class_id) for r in out} == {(i, 10) for i in (10, 50, 60, 61, 62, 63)} | {(i, 64) for i in (64, 70, 71, 80)}
    assert all(r.kept == (r.doc_id == r.class_id) for r in out)
