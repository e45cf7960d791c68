"""Integer vectors from embedding columns, packed in blocks, for the operators on vectors."""

from __future__ import annotations

import numpy as np

#: What a stored component can be at most; larger ones count as this.
WIDEST = (1 << 31) - 1
#: Vectors of a block at most.
BLOCK = 4096


def integers(column, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are whole, their vectors as floor(scale * x), shorter ones padded with zeros).

    A row is whole if its vector is not null and holds neither null nor non-finite components.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lens = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(pc.list_flatten(column).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lens)), lens)
    good = pc.is_valid(column).to_numpy(zero_copy_only=False).copy()
    good[row[~np.isfinite(flat)]] = False
    out = np.zeros((int(good.sum()), int(lens[good].max(initial=0))), np.int32)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    use = good[row]
    out[(np.cumsum(good) - 1)[row[use]], at[use]] = np.clip(np.floor(flat[use] * scale), -WIDEST, WIDEST).astype(np.int32)
    return good, out


def padded(rows: np.ndarray, width: int, limit: int) -> np.ndarray:
    """The rows as int64 of that width, each component within the limit."""
    out = np.zeros((len(rows), width), np.int64)
    out[:, : rows.shape[1]] = np.clip(rows, -limit, limit)
    return out


def limit_of(terms: int, factor: int = 1) -> int:
    """The largest power of two that keeps a sum of `terms` products of two numbers up to `factor` times it within 62 bits."""
    return 1 << max(1, (62 - max(1, terms).bit_length()) // 2 - (factor - 1).bit_length())


def exact(terms: int, most: int) -> bool:
    """Whether doubles hold sums of that many products of numbers up to `most` exactly."""
    return terms * most * most < 1 << 53
