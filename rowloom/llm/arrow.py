"""Helpers for operators that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a text column; null is empty."""
    return [x or "" for x in column.to_pylist()]


def coded_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) words between ASCII white space: the distinct ones, the number of each word in order, and the words of each text."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), None, texts)
    words = pc.ascii_split_whitespace(texts)
    lengths = pc.fill_null(words.value_lengths(), 0).to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64), lengths


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to about ``most``, one item at least."""
    start = total = end = 0
    for end, n in enumerate(sizes, 1):
        total += n
        if total >= most:
            yield start, end
            start, total = end, 0
    if start < end:
        yield start, end
