"""Corpus pipeline: language ID, exact, near and substring deduplication, packing.

Each stage is a function of (spark, docs, sf_dir).  Its result is written as
Parquet and read again as the docs of the next stage; all stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import exact_dedup, langid, neardup, packing, scratch, suffixes
from rowloom.llm.queries import tokenizer_path


#: Bytes of the Arrow batches between Spark and its workers: texts are long, and each task holds a batch several times over.
BATCH_BYTES = 6 << 20


def _begin(spark: SparkSession) -> None:
    """Free what earlier stages stashed; from here on the session's Arrow batches are of moderate size.

    Results are planned when they are written, after the stage has returned, so the setting stays.
    """
    scratch.release_all()
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fit a learned language; the others go, among them those without a letter.  A missing label is filled in."""
    _begin(spark)
    return langid.identified_documents(docs, langid.learn(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of equal texts."""
    _begin(spark)
    return exact_dedup.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near duplicates."""
    _begin(spark)
    return neardup.kept_documents(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that a document with a smaller id has."""
    _begin(spark)
    return suffixes.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences of 2,048 tokens."""
    _begin(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), size=2048)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("packing", pack),
]

#: Suffix automata, signatures and token ids have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        path = f"{scratch.shared_dir(spark)}/pipeline/{scratch.unique()}-{name}"
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
