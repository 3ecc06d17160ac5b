"""Exact deduplication by progressive refinement, with DataFrame functions only.

Texts are equal when they are identical after each run of ASCII white space has
become one space.  Groups are refined by byte length, then by the hash of a
prefix, then by the SHA-256 of the whole text; only groups that still have more
than one row go on to the next level.

Grouping runs on narrow rows (id, length, hashes), never on texts.  Every level
counts per (key, salt) first and per key after, and joins the result back on
(key, salt), so a key that holds a third of all rows is spread over the salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.scratch import salts, stash

#: Characters that the second level hashes.
PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """The text with each run of [\\x20\\x09-\\x0D] made one space; null is empty."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_replace(spaced, " {2,}", " ")


def _refine(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with n and keep: the number of rows with the same key, their least id."""
    part = rows.groupBy(*key, "salt").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keep"))
    whole = part.groupBy(*key).agg(F.sum("n").alias("n"), F.min("keep").alias("keep"))
    return rows.join(part.select(*key, "salt").join(whole, key), [*key, "salt"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", all_digests: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and, on request, text_sha256.

    The row with the least id of each group of equal texts is kept.

    * null text: equal to the empty text;
    * null id: takes no part in the choice of keep_id; such rows are kept only
      where every id of the group is null;
    * repeated rows (same id, same text): each counts in group_size and carries
      the same decision;
    * empty table: no rows;
    * other columns are ignored, whatever their names.

    ``all_digests`` hashes every text in the first scan (for callers that
    report the digest); otherwise a second scan hashes the texts of groups
    that length and prefix have not told apart.
    """
    text = normalised(F.col(text_col))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts(docs.sparkSession))).cast("int").alias("salt")
    narrow = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id",
        F.octet_length("t").alias("size"),
        F.xxhash64(F.substring("t", 1, PREFIX_CHARS)).alias("head"),
        salt,
        *([F.sha2("t", 256).alias("sha")] if all_digests else []),
    )
    narrow = stash(narrow, "exact-narrow")

    sized = _refine(narrow, ["size"])
    by_size = stash(sized.select(*narrow.columns, F.col("n").alias("n1")), "exact-size")
    alone = [by_size.filter("n1 = 1")]
    headed = _refine(by_size.filter("n1 > 1").drop("n1"), ["size", "head"])
    by_head = stash(headed.select(*narrow.columns, F.col("n").alias("n2")), "exact-head")
    alone.append(by_head.filter("n2 = 1"))
    left = by_head.filter("n2 > 1").drop("n2")
    if not all_digests:
        wanted = left.select("doc_id", "size", "head").distinct()
        full = docs.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
            "doc_id", F.octet_length("t").alias("size"), F.xxhash64(F.substring("t", 1, PREFIX_CHARS)).alias("head"), "t"
        )
        same = [full[c].eqNullSafe(wanted[c]) for c in ("doc_id", "size", "head")]
        left = full.join(wanted, same, "left_semi").select(
            "doc_id", "size", "head", salt, F.sha2("t", 256).alias("sha")
        )
        left = stash(left, "exact-full")
    last = _refine(left, ["size", "head", "sha"])

    digest = ["sha"] if all_digests else []
    out = last.select("doc_id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), *digest)
    for rows in alone:
        out = out.unionByName(rows.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), *digest))
    return out.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), *([F.col("sha").alias("text_sha256")] if all_digests else [])
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that ``exact_dedup`` keeps, with all their columns.

    Documents are named by their id: rows of one id go or stay together, and
    rows with a null id stay.
    """
    dropped = exact_dedup(docs, id_col, text_col).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__dropped")).distinct()
    # By sorting at every size: the ids that go are as many as the input makes them.
    return docs.join(dropped.hint("merge"), docs[id_col] == dropped["__dropped"], "left_anti")
