"""Tables from DataFrames and Parquet files."""

from __future__ import annotations

from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.errors import EngineError
from rowloom.schema import INTEGERS, POS, Schema, col

#: Bytes of file names that may be sent to every executor.
MOST_NAMES = 64 << 20


def _as_path(uri: str) -> str:
    """The URI of a file as the scan names the file: without an empty host."""
    u = urlsplit(uri)
    return f"{u.scheme}:" + (f"//{u.netloc}" if u.netloc else "") + u.path


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a Parquet path with their place: file by file in order of path, row by row.

    The place is (rank of the file) * 2**40 + (row in the file); both come with
    the scan, so nothing is sorted and filters on other columns are pushed down.
    """
    df = spark.read.parquet(path)
    files = sorted(df.inputFiles())
    base = F.col("_metadata.row_index")
    if len(files) > 1:
        # By the whole path: files of different folders may have the same name.
        ranks = spark.createDataFrame(pa.table({"__file": [_as_path(f) for f in files], "__rank": pa.array(range(len(files)), pa.int64())}))
        if sum(map(len, files)) <= MOST_NAMES:
            ranks = F.broadcast(ranks)
        df = df.withColumn("__file", F.col("_metadata.file_path")).withColumn("__row", base).join(ranks, "__file", "left")
        rank = F.coalesce("__rank", F.raise_error(F.concat(F.lit("no rank for the file "), "__file")).cast("long"))
        return df.withColumn(POS, rank * F.lit(1 << 40) + F.col("__row")).drop("__file", "__row", "__rank")
    return df.withColumn(POS, base)


def conform(df: DataFrame, schema: Schema) -> DataFrame:
    """Columns of the schema, as stored, and the place."""
    return df.select(*(col(n).cast(c.spark_type).alias(n) for n, c in schema.items()), POS)


def check_frame(df: DataFrame, schema: Schema) -> int:
    """Number of rows of a frame all of whose values fit the schema; one aggregation finds a violation."""
    faults = []
    for n, c in schema.items():
        v = col(n)
        if c.kind == "dictionary":
            rules = [("UNKNOWN_VALUE", v.isNull() | ~v.isin(list(c.values)))]
        elif c.kind == "boolean":
            rules = [("TYPE_MISMATCH", v.isNull())]
        else:
            d = v.cast("double")
            bad = v.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
            rules = [("TYPE_MISMATCH", bad | (d != F.floor(d)) if c.is_integer else bad)]
            if c.is_integer:
                rules.append(("OUT_OF_RANGE", (v < INTEGERS[c.type][0]) | (v > INTEGERS[c.type][1])))
        faults += [(n, suffix, F.min(F.when(rule, F.col(POS)))) for suffix, rule in rules]
    found = df.agg(F.count(F.lit(1)).alias("n"), *(f.alias(f"f{i}") for i, (_, _, f) in enumerate(faults))).collect()[0]
    first = min(((found[f"f{i}"], i) for i in range(len(faults)) if found[f"f{i}"] is not None), default=None)
    if first:
        name, suffix, _ = faults[first[1]]
        raise EngineError(suffix, f'Column "{name}" has a value that does not fit, at place {first[0]}.', {"column": name, "place": first[0]})
    return found.n
