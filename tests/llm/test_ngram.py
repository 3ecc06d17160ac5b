import math
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rowloom.llm import ngram, store
from rowloom.llm.elias_fano import Sequence
from rowloom.llm.scratch import fresh_path


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1), (5, 1000), (1000, 1001), (20_000, 1 << 50)])
def test_sequence(n, universe):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, universe, n).astype(np.uint64))
    seq = Sequence(Sequence.build(values, universe))
    assert (seq.access(np.arange(len(values))) == values).all()
    asked = np.concatenate([values, rng.integers(0, universe, 300).astype(np.uint64)])
    at = {int(v): i for i, v in enumerate(values)}
    assert seq.find(asked).tolist() == [at.get(int(v), -1) for v in asked]


def test_pointers_with_repeats():
    values = np.array([0, 0, 0, 2, 2, 7, 7, 7, 7], np.uint64)
    assert (Sequence(Sequence.build(values, 8)).access(np.arange(9)) == values).all()


def brute(rows):
    """Scores by plain counting, as the module's docstring defines them."""
    words = {i: [*(t or "").encode().lower().split(), b"\n"] for i, t in rows}
    train = [w for i, w in words.items() if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    grams = [Counter(tuple(w[k : k + n]) for w in train for k in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total, types = sum(grams[0].values()), len(grams[0])
    kept = [None, *({g: c for g, c in grams[n].items() if c >= ngram.MIN_COUNT} for n in (1, 2))]
    weight = [defaultdict(lambda: 1.0) for _ in range(3)]
    for n in (1, 2):
        for g, c in kept[n].items():
            weight[n][g[:-1]] -= (c - ngram.DISCOUNT) / grams[n - 1][g[:-1]]
    out = {}
    for i, w in words.items():
        score = 0.0
        for k, x in enumerate(w):
            p = (grams[0][(x,)] + 1) / (total + types + 1)
            for n in (1, 2):
                g = tuple(w[max(0, k - n) : k + 1])
                if len(g) == n + 1 and (n == 1 or g[:2] in kept[1]):
                    c = kept[n].get(g)
                    p = (max(c - ngram.DISCOUNT, 0) / grams[n - 1][g[:-1]] if c else 0) + weight[n][g[:-1]] * p
            score += math.log10(p)
        base = sum(math.log10((grams[0][(x,)] + 1) / (total + types + 1)) for x in w)
        out[i] = (len(w), sum(grams[0][(x,)] > 0 for x in w), total, base, score)
    return out


def test_scores(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(40)] + ["The", "CAFÉ", "x\x1cy", "é"]
    odds = 1 / np.arange(1, len(vocabulary) + 1)
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60), p=odds / odds.sum()))) for i in range(150)]
    rows += [(150, None), (151, ""), (152, "\t \n"), (153, "zz zz " * 500)]
    found = {r.doc_id: r for r in ngram.train_and_score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert len(found) == len(rows)
    for i, (n, known, total, base, score) in brute(rows).items():
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=1e-3, abs=1e-3)
        assert r.score <= 0


def test_ngrams_seen_once_are_retained(spark):
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 7 != 2][:2]
    docs = spark.createDataFrame(zip(ids, ["p q r", "s t u"], strict=True), "doc_id long, text string")
    found = {r.doc_id: r.score for r in ngram.train_and_score(docs).collect()}
    # 8 tokens of 7 types, each once but for the end; every longer n-gram once.
    word, end = 2 / 16, 3 / 16
    below = lambda p: 0.25 + 0.75 * p
    expected = sum(map(math.log10, (word, below(word), below(below(word)), below(below(end)))))
    assert [found[i] for i in ids] == pytest.approx([expected] * 2, abs=2e-3)


def test_probabilities_sum_to_one(spark):
    """Over the vocabulary and one unknown word, after one token and after two."""
    docs = spark.createDataFrame([(i, "a b c a b d a b c b") for i in range(30)], "doc_id long, text string").select("text")
    model = ngram.Model(fresh_path(spark, "ngram"), 1)
    ngram._count_tokens(docs, model)
    rows = ngram._identified(docs, model, "text")
    for level in (2, 3):
        ngram._count_ngrams(rows, model, level)
    reader = ngram.Reader(model)
    following = [b"a", b"b", b"c", b"d", b"\n", b"unknown"]
    start = np.array([0])
    for context in ([b"a"], [b"a", b"b"], [b"b", b"c"]):
        total = 0.0
        for w in following:
            ids = reader.ids([*context, w])
            counts, weights, begins = reader.tokens(ids, True)
            p = (counts + 1) / (model.tokens + model.types + 1)
            found, place, q = reader.pairs(ids, begins, start)
            p[1:] = q[1:] + weights[:-1] * p[1:]
            if len(context) == 2 and found[1] >= 0:
                _, q3 = reader.successors(2, found[1:2], place[2:])
                (level, _, local), *_ = reader.by_shard(2, found[1:2])
                p[-1] = q3[0] + ngram._DECODED[level["weight"][local]][0] * p[-1]
            total += p[-1]
        assert total == pytest.approx(1, abs=2e-3)


def test_empty_table_and_nulls(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, score string")
    assert ngram.train_and_score(empty).count() == 0
    rows = ngram.train_and_score(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_known, r.train_tokens) for r in rows] == [(False, 0, 0)] * 2


def test_looking_up_costs_the_same_with_many_shards(spark):
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(" ".join(f"w{k}" for k in rng.zipf(1.3, 400) % 3000),) for _ in range(20)], "text string")
    calls, found = {}, {}
    for bits in (1, 7):
        model = ngram.Model(fresh_path(spark, "ngram"), bits)
        ngram._count_tokens(docs, model)
        rows = ngram._identified(docs, model, "text")
        for level in (2, 3):
            ngram._count_ngrams(rows, model, level)
        reader, calls[bits] = ngram.Reader(model), 0
        (words, number, lengths) = next(ngram.words_of(docs.limit(10).toArrow().column(0).combine_chunks()))

        def look_up():
            ids = reader.ids(words)[number]
            starts = np.cumsum(lengths) - lengths
            counts, weights, begins = reader.tokens(ids, True)
            found, place, q = reader.pairs(ids, begins, starts)
            return counts, weights, q, reader.successors(2, found[:-1], place[1:])[1]

        def count(*_):
            calls[bits] += 1

        look_up()  # The shards are mapped now.
        reader.clear()
        sys.setprofile(count)
        try:
            found[bits] = look_up()
        finally:
            sys.setprofile(None)
    assert calls[7] < 1.5 * calls[1]
    for one, two in zip(found[1], found[7], strict=True):
        assert (one == two).all()


def test_counts_of_shards_with_numbers_of_different_width(tmp_path):
    model = ngram.Model(str(tmp_path), 2)
    model.set_level(1, {0: 2, 1: 1, 3: 2})
    for shard, counts in ((0, np.array([1, 5], np.uint32)), (1, np.array([1 << 40], np.int64)), (3, np.array([7, (1 << 32) - 1], np.uint32))):
        store.write(f"{tmp_path}/1-{shard:05d}", {"hash": np.arange(len(counts), dtype=np.uint64) + np.uint64(shard << 62), "count": counts})
    level = ngram.Reader(model).level(1)
    shard, local = np.array([0, 3, 1, 0, 3]), np.array([1, 1, 0, 0, 0])
    assert level.counts(shard, local).tolist() == [5, (1 << 32) - 1, 1 << 40, 1, 7]
    asked = np.array([1, 2, 1 << 62, 1 << 63, (3 << 62) + 1], np.uint64)
    assert level.hashed((asked >> np.uint64(62)).astype(np.int64), asked).tolist() == [1, -1, 0, -1, 1]
