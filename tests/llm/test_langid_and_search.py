import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import langid, vafile

STEMS = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["schu", "ber", "ung", "zt"], "cc": ["eau", "oux", "ré", "ment"]}


def prose(r, lang, n):
    return " ".join("".join(r.choices(STEMS[lang], k=r.randrange(1, 4))) for _ in range(n))


def test_phrases_are_longest_matches():
    r = random.Random(2)
    sample = "".join(r.choices("abc", k=200))
    moves = langid.suffix_automaton(sample)
    for _ in range(300):
        text = "".join(r.choices("abcd", k=r.randrange(30)))
        count, at = 0, 0
        while at < len(text):
            n = 1
            while at + n < len(text) and text[at : at + n + 1] in sample and text[at : at + n] in sample:
                n += 1
            count, at = count + 1, at + n
        assert langid.phrases(moves, text) == count


def test_held_out_accuracy(spark):
    r = random.Random(1)
    rows = [(i, prose(r, lang := r.choice(list(STEMS)), r.randrange(5, 60)), lang) for i in range(600)]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 34 !?", "bb"), (1003, "x" * 50_000, None), (1004, prose(r, "cc", 30), None)]
    docs = spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, lang string, score double").repartition(3)
    out = {x.doc_id: x for x in langid.identify(docs, langid.learn(docs)).collect()}
    assert len(out) == len(rows)
    held = [(out[i].lang_pred, lang) for i, _, lang in rows[:600] if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.98
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1004].lang_pred == "cc"
    assert all(0 <= x.score <= 1 for x in out.values())
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    samples = langid.learn(docs)
    kept = langid.identified_documents(docs, samples)
    found = {x.doc_id: x.lang for x in kept.collect()}
    # Texts without a letter, and one that no sample helps to spell, go; a missing label is filled in.
    assert kept.columns == docs.columns and set(found) == {x[0] for x in rows} - {1000, 1001, 1002, 1003} and found[1004] == "cc"
    assert {x.lang for x in langid.identified_documents(docs, samples, languages=["bb"]).collect()} == {"bb"}
    assert langid.identified_documents(docs, {}).count() == 0


def by_hand(samples, text):
    """Prediction by looking for each phrase in the samples as text, without automata."""
    if not samples or not any(c.isalpha() for c in text):
        return "und", 0.0, False
    text = " " + " ".join(text.lower().split())
    found = []
    for lang, sample in sorted(samples.items()):
        n = at = 0
        while at < len(text):
            size = 1
            while at + size < len(text) and text[at : at + size + 1] in sample:
                size += 1
            n, at = n + 1, at + size
        found.append((n * math.log2(max(2, len(sample))) / len(text), lang))
    best, lang = min(found)
    others = [e for e, x in found if x != lang]
    odds = [sample.count(c) / len(sample) for sample in [samples[lang]] for c in set(sample)]
    return lang, 1 - best / min(others) if others else 1.0, best < -sum(p * math.log2(p) for p in odds)


def test_predictions_are_those_of_whole_texts(spark):
    r = random.Random(9)
    rows = [(i, prose(r, lang := r.choice(list(STEMS)), r.randrange(1, 40)) + r.choice(["", "  Qq 7", " É\n", "ka lo berung"]), lang) for i in range(150)]
    rows += [(500, "kaloschu  eauBER\tzt", None), (501, "zzzz qqqq", None), (502, "", None), (503, None, None), (504, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = langid.learn(docs)
    out = {x.doc_id: x for x in langid.identify(docs, samples).collect()}
    for i, text, _ in rows:
        lang, score, fits = by_hand(samples, text or "")
        assert (out[i].lang_pred, out[i].fits) == (lang, fits) and out[i].score == pytest.approx(score), text


def test_the_automata_decide(spark, monkeypatch):
    """With a parse that finds nothing, no document is kept."""
    r = random.Random(3)
    docs = spark.createDataFrame([(i, prose(r, "aa", 30), "aa") for i in range(40)], "doc_id long, text string, lang string")
    samples = langid.learn(docs)
    model = langid.Identifier(samples)
    text = prose(r, "aa", 50)
    assert model.predict(text).fits and not model.predict("wxyv " * 50).fits
    model.automata = [{}]
    assert not model.predict(text).fits


def test_most_frequent_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    rows = [(i, "some text", lang) for i, lang in enumerate(["a", "b", "b", "c", "c", "c"] * 5)]
    assert set(langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == {"b", "c"}


def test_learns_from_labels_only(spark):
    """Labels of held-out rows and rows without a label change nothing."""
    r = random.Random(4)
    rows = [(i, prose(r, "aa", 20), "aa") for i in range(60)]
    same = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    rows = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in rows] + [(99, prose(r, "bb", 20), None), (None, "x y", "qq")]
    assert langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")) == same
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.learn(empty) == {} and langid.identify(empty, {}).count() == 0
    assert langid.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), {}).first().lang_pred == "und"


def brute(rows, k):
    good = [(i, np.floor(64 * np.array(v, np.float64)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v in {i: v for i, v in good if i % 20 == 0}.items():
        found = sorted((-int(v @ w), j) for j, w in good if j != i and len(w) == len(v))[:k]
        out |= {(i, n, j, -s) for n, (s, j) in enumerate(found, 1)}
    return out


def test_exact_search(spark, monkeypatch):
    monkeypatch.setattr(vafile, "BLOCK_ROWS", 37)
    monkeypatch.setattr(vafile, "QUERY_ROWS", 3)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(400)] + [(400 + i, [0.25] * 8) for i in range(120)]
    rows += [(700, None), (720, [float("nan")] * 8), (740, [1.0, None] * 4), (760, []), (780, [float("inf")] + [0.0] * 7), (800, [1.0, 2.0]), (None, [0.1] * 8), (820, [0.0] * 8)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    out = vafile.top_k(docs, F.col("vec_id") % 20 == 0, k=20)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()} == brute([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows], 20)


def test_cells_approximate_and_few_vectors_are_read(spark, monkeypatch):
    """Cells tell vectors apart roughly; few exact vectors are needed all the same."""
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 0.12, (40, 48))
    rows = [(i, (centres[i % 40] + rng.normal(0, 0.05, 48)).tolist()) for i in range(4000)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    blocks = vafile.build(vafile.quantised(docs, "vec_id", "embedding", 64.0)).collect()
    query = np.floor(64 * np.array([rows[0][1]])).astype(np.int64)
    for r in blocks:
        block = vafile.Block(r.path, r.dims)
        middle, radius = block.bounds(query)
        exact = vafile.scores_of(query[0], np.asarray(block.exact))
        assert (np.abs(middle[0] - exact) <= radius[0]).all() and radius[0] > 0
        assert (middle[0] != exact).mean() > 0.9
    reads = vafile.candidates(docs, F.col("vec_id") % 20 == 0, 20, 64.0, "vec_id", "embedding").filter("vec_id IS NULL").agg(F.sum("score")).first()[0]
    assert 200 * 20 <= reads < 0.1 * 200 * 4000
    out = vafile.top_k(docs, F.col("vec_id") % 20 == 0, k=20)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()} == brute(rows, 20)


def test_many_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vafile, "GROUP_QUERIES", 5)
    monkeypatch.setattr(vafile, "TASK_GROUPS", 2)
    monkeypatch.setattr(vafile, "FIRST_BLOCKS", 1)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.3, 6 + i % 2).tolist()) for i in range(600)]
    out = vafile.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 20 == 0, k=7)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()} == brute(rows, 7)


def test_huge_components(spark):
    """Exact where a score fits 64 bits, else the nearest 64-bit number."""
    rows = [(0, [1e8, -3e7, 0.5]), (20, [2.0, 1.0, 1.0]), (40, [1e300, 1.0, -1e300])]
    rows += [(1, [1e8, 1e8, 1.0]), (2, [-1e8, 1.0, 1.0]), (3, [1.0, 1.0, 1.0]), (4, [3e7, 1e8, 7.0]), (5, [1e17, 0.0, 0.0])]
    number = lambda x: min(max(math.floor(64 * x), -(1 << 63)), (1 << 63) - 1)
    whole = {i: [number(x) for x in v] for i, v in rows}
    clamp = lambda x: min(max(x, vafile.LEAST), vafile.MOST)
    expected = set()
    for i in (0, 20, 40):
        found = sorted((-clamp(sum(a * b for a, b in zip(whole[i], w, strict=True))), j) for j, w in whole.items() if j != i)
        expected |= {(i, n, j, -s) for n, (s, j) in enumerate(found, 1)}
    out = vafile.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=20)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()} == expected


def test_repeated_queries_ask_with_the_least_vector(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 9.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0])]
    out = vafile.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5)
    assert [(r["rank"], r.vec_id, r.score) for r in out.orderBy("rank").collect()] == [(1, 1, 32 * 64 + 576 * 64), (2, 2, 32 * 128)]


def test_few_rows_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.5]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in vafile.top_k(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(0, 1, 1, 64 * 32 + 32 * 32), (0, 2, 2, -64 * 64)]
    assert vafile.top_k(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert vafile.top_k(few.filter("vec_id > 0"), F.col("vec_id") % 20 == 0).count() == 0
