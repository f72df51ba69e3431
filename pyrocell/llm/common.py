"""Helpers shared by the text operators.

Words are runs of bytes other than 0x20 and 0x09-0x0D: exactly what ``bytes.split()`` returns, and
``bytes.lower()`` touches A-Z alone, so operators work on UTF-8 bytes and never decode to find words.
A null text is an empty one.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from pyrocell.storage import discard, materialise, recording, scratch  # noqa: F401


def fresh(name: str, taken: list[str]) -> str:
    """The name, with underscores appended until no column has it."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, mod m; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % m


def raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def texts_of(column: pa.Array, step: int = 256) -> Iterator[bytes]:
    """A string column's values as UTF-8 bytes, null as empty, a few at a time: a batch is never held twice."""
    for at in range(0, len(column), step):
        yield from (t or b"" for t in as_bytes(column.slice(at, step)))


def trim() -> None:
    """Gives memory that a batch needed back to the system: a worker that waits for its next task keeps none of it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def pack(a: np.ndarray) -> bytes:
    """An integer or float array as zstd over its byte planes: sorted or small values cost few bytes."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else a
    return a.dtype.str.encode().ljust(4) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:4].decode().strip())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values, as differences."""
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)
