"""Sorted keys with counts as few bytes.

Keys become the gaps between neighbours, gaps and counts are laid out by byte (all
lowest bytes, then all second ones, ...), and the whole is compressed: the higher
bytes are mostly equal, so a key costs about the logarithm of the mean gap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_CODEC = pa.Codec("zstd", 1)
U64 = np.uint64


def _planes(values: np.ndarray) -> tuple[int, bytes]:
    """Number of bytes that the largest value needs, and those of all values, lowest bytes first."""
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    return width, np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _values(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n and width:
        out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel()


def squeeze(*columns: np.ndarray) -> bytes:
    """Unsigned columns of one length, laid out by byte and compressed."""
    planes = [_planes(c) for c in columns]
    head = len(columns[0]).to_bytes(8, "little") + bytes([len(planes), *(w for w, _ in planes)])
    return head + _CODEC.compress(b"".join(data for _, data in planes), asbytes=True)


def expand(block: memoryview) -> list[np.ndarray]:
    """The columns of ``squeeze``, as uint64."""
    block = memoryview(block)
    n, columns = int.from_bytes(block[:8], "little"), block[8]
    widths = list(block[9 : 9 + columns])
    raw = memoryview(_CODEC.decompress(block[9 + columns :], n * sum(widths))) if n * sum(widths) else memoryview(b"")
    ends = np.cumsum([0, *(n * w for w in widths)])
    return [_values(raw[a:b], n, w) for a, b, w in zip(ends[:-1].tolist(), ends[1:].tolist(), widths, strict=True)]


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys (uint64, sorted) and counts from 1 on."""
    return squeeze(np.diff(keys, prepend=U64(0)), counts.astype(U64) - U64(1))


def unpack(block: memoryview) -> tuple[np.ndarray, np.ndarray]:
    gaps, more = expand(block)
    with np.errstate(over="ignore"):
        return np.cumsum(gaps, dtype=U64), more.astype(np.int64) + 1
