"""Files of named arrays in the shared folder, written once and memory-mapped."""

from __future__ import annotations

import ctypes
import json
import mmap
import os
import tempfile
import uuid
import weakref
from collections.abc import Sequence
from typing import BinaryIO

import numpy as np

_ALIGN = 64
_MAP_FIXED, _MAP_NORESERVE = 0x10, 0x4000


def _plain(uri: str) -> str | None:
    """Path of a folder that the file system itself shares; None for other stores."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def write(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write ``arrays`` as one file.  The file appears whole or not at all, so a task may run twice."""
    head, at, parts = {}, 0, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        head[name] = [a.dtype.str, len(a), at]
        parts.append(a.tobytes())
        at += -(-a.nbytes // _ALIGN) * _ALIGN
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % _ALIGN)
    data = b"".join([len(text).to_bytes(8, "little"), text, *(p + b"\0" * (-len(p) % _ALIGN) for p in parts)])
    part = f"{uri}.part-{uuid.uuid4().hex}"
    if (path := _plain(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_plain(part), "wb") as f:
            f.write(data)
        os.replace(_plain(part), path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    _, part = fs.FileSystem.from_uri(part)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def _opened(uri: str) -> BinaryIO:
    """The file, or of one in a remote store a nameless local copy, which goes when its last mapping does."""
    path = _plain(uri)
    if path is not None:
        return open(path, "rb")
    from pyarrow import fs

    store, remote = fs.FileSystem.from_uri(uri)
    f = tempfile.TemporaryFile()
    with store.open_input_stream(remote) as source:
        while block := source.read(1 << 24):
            f.write(block)
    f.flush()
    return f


def _size(uri: str) -> int:
    path = _plain(uri)
    if path is not None:
        return os.path.getsize(path)
    from pyarrow import fs

    store, remote = fs.FileSystem.from_uri(uri)
    return store.get_file_info(remote).size


def _head(raw: np.ndarray) -> dict[str, tuple[str, int, int]]:
    """Type, length and place in the file, in bytes, of each array."""
    size = int.from_bytes(raw[:8].tobytes(), "little")
    return {name: (kind, n, 8 + size + at) for name, (kind, n, at) in json.loads(raw[8 : 8 + size].tobytes()).items()}


def read(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory."""
    with _opened(uri) as f:
        raw = np.asarray(np.memmap(f, np.uint8, "r"))
    return {name: raw[at : at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, at) in _head(raw).items()}


class Mapped:
    """Files mapped one behind another into one range of addresses, so that one index reaches into all of them.

    ``views`` has that range as numbers of 1, 2, 4 and 8 bytes.  Only what is read takes memory.
    """

    def __init__(self, uris: Sequence[str | None]) -> None:
        libc = ctypes.CDLL(None, use_errno=True)
        libc.mmap.restype = ctypes.c_void_p
        libc.mmap.argtypes = [ctypes.c_void_p, ctypes.c_size_t, ctypes.c_int, ctypes.c_int, ctypes.c_int, ctypes.c_long]
        libc.munmap.argtypes = [ctypes.c_void_p, ctypes.c_size_t]

        def mapped(*args: int | None) -> int:
            if (at := libc.mmap(*args)) == ctypes.c_void_p(-1).value:
                raise OSError(ctypes.get_errno(), "mmap")
            return at

        sizes = [0 if u is None else _size(u) for u in uris]
        rounded = [-(-n // mmap.PAGESIZE) * mmap.PAGESIZE for n in sizes]
        total = sum(rounded) + mmap.PAGESIZE
        base = mapped(None, total, mmap.PROT_READ, mmap.MAP_PRIVATE | mmap.MAP_ANONYMOUS | _MAP_NORESERVE, -1, 0)
        weakref.finalize(self, libc.munmap, base, total)
        raw = np.ctypeslib.as_array((ctypes.c_uint8 * total).from_address(base))
        self.views = {k.itemsize: raw.view(k) for k in map(np.dtype, (np.uint8, np.uint16, np.uint32, np.uint64))}
        self.heads: list[dict[str, tuple[str, int, int]]] = []
        at = 0
        for uri, size, room in zip(uris, sizes, rounded, strict=True):
            if size:
                with _opened(uri) as f:
                    mapped(base + at, size, mmap.PROT_READ, mmap.MAP_SHARED | _MAP_FIXED, f.fileno(), 0)
                self.heads.append({name: (kind, n, at + place) for name, (kind, n, place) in _head(raw[at : at + size]).items()})
            else:
                self.heads.append({})
            at += room

    def places(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the array in each file: its place in the view of its width, its length and its width (0, 0 and 1 where there is none)."""
        found = [h.get(name, ("u1", 0, 0)) for h in self.heads]
        width = np.array([np.dtype(kind).itemsize for kind, _, _ in found], np.int64)
        return np.array([at for _, _, at in found], np.int64) // width, np.array([n for _, n, _ in found], np.int64), width


def write_bytes(uri: str, data: bytes) -> None:
    """Write one file of plain bytes; see ``write``."""
    write(uri, {"bytes": np.frombuffer(data, np.uint8)})


def read_bytes(uri: str) -> memoryview:
    return memoryview(np.asarray(read(uri)["bytes"]))
