import random

import pyarrow as pa

import corpus_pipeline
from rowloom.llm import scratch
from tests.llm import test_neardup, test_suffixes


def prose(r, n):
    return " ".join("".join(r.choices(["tion", "re", "an", "the", "ou", "st"], k=r.randrange(1, 4))) for _ in range(n))


def corpus():
    r = random.Random(6)
    clean = [(i, prose(r, r.randrange(30, 120)), "en", "s", 0) for i in range(60)]
    passage = "a passage of more than fifty words that some documents share " * 8
    rows = clean + [(100, "  ".join(clean[3][1].split(" ")), "en", "s", 0), (101, clean[4][1] + " end", "en", "s", 0), (102, None, "en", "s", 0), (103, "12 34", "en", "s", 0), (104, "zqxj kvwz jjqk xzvy wqkj", None, "s", 0)]
    rows += [(200 + i, f"{prose(r, 40)} {passage} {prose(r, 40)}", "en", "s", 0) for i in range(3)]
    return clean, rows


def test_stages(spark, tmp_path):
    clean, rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    ids = {name: {r.doc_id for r in found} for name, found in seen.items()}
    everyone = {r[0] for r in rows}
    assert ids["language_id"] == everyone - {102, 103, 104}
    assert ids["exact_dedup"] == ids["language_id"] - {100}
    left = [(r.doc_id, r.text) for r in seen["exact_dedup"]]
    groups = test_neardup.brute(left)
    assert ids["near_dedup"] == {i for i, g in groups.items() if i == g} and 101 not in ids["near_dedup"]
    wanted = {i: n for i, _, n, _, _ in test_suffixes.brute([(r.doc_id, r.text) for r in seen["near_dedup"]])}
    texts = {r.doc_id: r.text for r in seen["suffix_dedup"]}
    sizes = {r.doc_id: len(r.text) for r in seen["near_dedup"]}
    assert all(len(texts[i]) == sizes[i] - wanted[i] for i in texts)
    assert wanted[200] == 0 and wanted[201] > 400 and all(texts[i] == t for i, t, *_ in clean if wanted.get(i) == 0 and i in texts)
    assert ids["packing"] == ids["suffix_dedup"]
    scratch.release_all()


def test_run(spark, tmp_path):
    _, rows = corpus()
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(out.columns)
    assert out.count() > 50


def test_empty_tables_and_columns_with_clashing_names(spark, tmp_path):
    """Every stage keeps columns it does not know, whatever their names, nulls and repeats among the rows, and takes an empty table."""
    _, rows = corpus()
    kinds = "doc_id long, text string, lang string, source string, n_chars long, node string, block long, bucket string, keep_id long, kept boolean, label string, __dropped long, number int, size string"
    extra = ("n", 1, "b", 2, True, None, 3, 4, "s")
    table = [(i, t, lang, s, len(t or ""), *extra) for i, t, lang, s, _ in rows] + [(None, rows[0][1], None, None, None, *extra), (rows[1][0], rows[1][1], None, None, None, *extra)]
    for name, some in (("full", table), ("none", [])):
        docs = spark.createDataFrame(some, kinds)
        for k, (stage_name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / name / str(k))
            docs.write.parquet(path)
            docs = stage(spark, spark.read.schema(docs.schema).parquet(path), str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == [c.split()[0] for c in kinds.split(", ")], stage_name
                assert all(r[5:] == extra for r in docs.collect())
        assert (docs.count() > 50) == (name == "full")
    scratch.release_all()


def test_batches_of_long_texts_are_of_moderate_size(spark):
    """10,000 rows, Spark's most for a batch, are 40 MB here."""
    docs = spark.range(10_000, numPartitions=1).selectExpr("id doc_id", "repeat(cast(id as string), 1000) text", "'en' lang", "'s' source", "4000 n_chars")
    sizes = lambda batches: (b.select(["n"]) for b in map(measured, batches))
    for _, stage in corpus_pipeline.STAGES[1:2] + corpus_pipeline.STAGES[-1:]:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs.limit(1), "")
        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) < 8 << 20


def measured(batch):
    return pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])
