"""Sum-of-squares packing of token ids into sequences of a fixed length.

A document is its token ids and one end id.  Only documents longer than a
sequence are cut, into full pieces and a rest.  Pieces are dealt by hash into
shards of bounded size and each shard is packed by itself, so no task ever holds
more than a shard, and a shard of some thousand pieces already comes within a
sequence or so of the least number possible.

Inside a shard pieces are placed by falling length.  Each goes to the open
sequence for which the sum, over all residual gaps, of the squared number of open
sequences with that gap becomes smallest; ties go to the smaller gap.  A new
sequence is opened only where no open one has room.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.arrow import texts_of
from rowloom.llm.tokens import worker_encoder

#: Documents to a shard, on average.
SHARD_DOCS = 4000
#: Sequence ids of a shard start at shard * SHARD_IDS.
SHARD_IDS = 1 << 32


def place(lengths: Iterable[int], size: int) -> tuple[list[int], list[int]]:
    """Sequence number and offset of each piece, in the order given."""
    counts = np.zeros(size + 1, np.int64)
    open_at: dict[int, list[tuple[int, int]]] = {}
    sequences, offsets, used = [], [], 0
    for n in lengths:
        gaps = counts[n:size]
        if gaps.any():
            # Taking one from gap g and adding one to gap g - n changes the sum by
            # 2 * (counts[g - n] - counts[g]) + 2, by one less where nothing is left.
            change = 2 * (counts[: size - n] - gaps) + 2
            change[0] -= 1
            gap = n + int(np.where(gaps > 0, change, np.iinfo(np.int64).max).argmin())
            seq, at = open_at[gap].pop()
            counts[gap] -= 1
        else:
            seq, at, gap = used, 0, size
            used += 1
        if gap > n:
            counts[gap - n] += 1
            open_at.setdefault(gap - n, []).append((seq, at + n))
        sequences.append(seq)
        offsets.append(at)
    return sequences, offsets


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer)
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, words in enumerate(encoder.encode(texts_of(batch.column(1)))):
                ids = words + end
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone.  Ids may be null or repeat; every
    row is packed by itself.  Pieces of equal length are ordered by id, piece
    and checksum.  An empty table gives no rows; other columns are ignored.
    """
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    rows = pieces(docs, tokenizer, size, end_id, id_col, text_col)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sequences, offsets = place(table["length"].to_pylist(), size)
        first = (table["shard"][0].as_py() if len(table) else 0) * SHARD_IDS
        table = table.append_column("sequence_id", pa.array(np.array(sequences, np.int64) + first)).append_column("offset", pa.array(offsets, pa.int64()))
        return table.drop_columns(["shard"])

    kinds = [(f.name, f.dataType.simpleString()) for f in rows.schema if f.name != "shard"]
    schema = ", ".join(f"{n} {t}" for n, t in [*kinds, ("sequence_id", "long"), ("offset", "long")])
    return rows.groupBy("shard").applyInArrow(run, schema)
