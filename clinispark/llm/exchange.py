"""Sorted arrays of hashes as compact binary rows.

A task cuts its sorted hashes by value into `n` ranges and makes one row a range, so that a shuffle moves thousands of
blobs instead of millions of rows, and a hash that is hot comes at most once from each chunk of input.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame

_pack, _unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Fixed-width numbers, byte planes apart, compressed."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.dtype.itemsize).T
    return _pack.compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    planes = np.frombuffer(_unpack.decompress(blob), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


def filled(values: np.ndarray, n: int):
    """(range, start, end) of each of n equal ranges that ascending uint64 values fill."""
    if not len(values):
        return
    ids = np.minimum(values // np.uint64((1 << 64) // n), np.uint64(n - 1)) if n > 1 else np.zeros(len(values), np.uint64)
    new = np.flatnonzero(ids[1:] != ids[:-1]) + 1
    for a, b in zip([0, *new.tolist()], [*new.tolist(), len(values)], strict=True):
        yield int(ids[a]), a, b


def collapsed(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, more, copies): rows that are alike within a batch are one, so many equal rows stay few."""
    names = ["doc_id", "text", *more]
    schema = docs.select(*[f"`{c}`" for c in names]).schema.add("copies", "long")

    def scan(batches):
        import pyarrow as pa

        from .words import slices

        for batch in slices(batches, 5000):
            table = pa.Table.from_batches([batch]).group_by(names, use_threads=False).aggregate([([], "count_all")])
            yield from table.select([*names, "count_all"]).rename_columns([*names, "copies"]).combine_chunks().to_batches()

    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(scan, schema)


def merged(docs: list, texts: list[bytes], copies: list[int]) -> list[tuple]:
    """(doc_id, text, copies) in an order that only the rows decide, each pair once however its copies came."""
    held: dict[tuple, int] = {}
    for d, t, n in zip(docs, texts, copies, strict=True):
        held[d, t] = held.get((d, t), 0) + n
    return [(d, t, held[d, t]) for d, t in sorted(held, key=lambda x: (x[0] is None, x[0] or 0, x[1]))]


def narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint16 if len(values) == 0 or int(values.max()) < 1 << 16 else np.uint32)
