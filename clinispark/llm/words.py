"""Words of UTF-8 texts as 64-bit hashes, and hashes of their windows, in NumPy.

A word is a run of bytes other than space and 0x09-0x0D, which is how bytes.split() cuts. All words of a block of texts
are hashed together, without a Python object for each.
"""

from __future__ import annotations

import contextlib
import ctypes
import re

import numpy as np

U64 = np.uint64
#: An odd multiplier for polynomial window hashes, and the two of a 64-bit finaliser.
BASE, MIX1, MIX2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
EMPTY = np.zeros(0, U64)
_blank = re.compile(rb"[\x20\x09-\x0D]")


#: Bytes that are hashed at once; longer texts are cut at blanks.
BLOCK = 1 << 18
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
#: A random number for each byte value, and the byte base of word hashes.
BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
STEP = 0xD6E8FEB86659FD93
#: The same for a second, independent hash.
BYTE2 = np.random.default_rng(20250117).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
STEP2 = 0xC2B2AE3D27D4EB4F
#: mallopt's name of the threshold (a fixed value of glibc), and the bytes from which arrays are mapped by themselves.
M_MMAP_THRESHOLD, MAPPED_FROM = -3, 4 << 20
_powers: dict[tuple[str, int], np.ndarray] = {}
_lean: list[bool] = []


def _tables(n: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """step ** i and its inverse modulo 2 ** 64, for i below n."""
    if len(_powers.get(("up", step), ())) < n:
        size = max(n, BLOCK + (BLOCK >> 2))
        for key, base in (("up", step), ("down", pow(step, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[key, step] = np.multiply.accumulate(x)
    return _powers["up", step], _powers["down", step]


def _cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    word = ~BLANK[data]
    edge = np.diff(word, prepend=False, append=False)
    at = np.flatnonzero(edge)
    return at[::2], at[1::2]


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """Polynomial hashes of runs of bytes by differences of one running sum, mixed with the length."""
    byte, step = (BYTE2, STEP2) if second else (BYTE, STEP)
    up, down = _tables(len(data) + 1, step)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(byte[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * BASE)


def blocks(texts: list[bytes]):
    """(texts' numbers, joined bytes, offsets) of about BLOCK bytes each; a long text is cut at blanks into several."""
    numbers, held, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            end = len(text)
            if end - at > BLOCK:
                m = _blank.search(text, at + BLOCK)
                end = m.start() if m else end
            part = text if end - at == len(text) else text[at:end]
            numbers.append(i)
            held.append(part)
            size += len(part) + 1
            if size >= BLOCK:
                yield numbers, held
                numbers, held, size = [], [], 0
            if end >= len(text):
                break
            at = end
    if held:
        yield numbers, held


def lean() -> None:
    """Makes this Python worker give large arrays back to the system as soon as they are freed.

    Spark keeps its workers between tasks, and their memory counts against the executor. glibc else raises the size from
    which blocks are mapped by themselves with every large block freed, and keeps what lies below.
    """
    if _lean:
        return
    _lean.append(True)
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").mallopt(M_MMAP_THRESHOLD, MAPPED_FROM)


def _hashed(texts: list[bytes], kinds: tuple[bool, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    lean()
    counts, out = np.zeros(len(texts) + 1, np.int64), [[] for _ in kinds]
    for numbers, held in blocks(texts):
        data = np.frombuffer(b"\n".join(held), np.uint8)
        starts, ends = _cut(data)
        for found, second in zip(out, kinds, strict=True):
            found.append(hash_runs(data, starts, ends, second))
        first = np.concatenate([[0], np.cumsum([len(h) + 1 for h in held])])
        np.add.at(counts, np.array(numbers) + 1, np.diff(np.searchsorted(starts, first)))
    return [np.concatenate(found) if found else EMPTY for found in out], np.cumsum(counts)


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and where each text's begin: len(texts) + 1 positions."""
    (one,), at = _hashed(texts, (False,))
    return one, at


def hashed_twice(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As hashed, with a second hash that is independent of the first."""
    (one, two), at = _hashed(texts, (False, True))
    return one, two, at


def slices(batches, rows: int = 1000, size: int = 4 << 20):
    """Arrow batches in parts of at most `rows` rows and, unless one row is larger, about `size` bytes of text.

    Free memory goes back to the system when the last is done.
    """
    import pyarrow.compute as pc

    lean()
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            held = total[at - 1] if at else 0
            end = min(at + rows, max(at + 1, int(np.searchsorted(total, held + size, side="right"))))
            yield batch.slice(at, end - at)
            at = end
    trim()


def trim() -> None:
    """Gives free memory of this Python worker back to the system; Spark keeps the worker for later tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * MIX1
    x = (x ^ (x >> U64(27))) * MIX2
    return x ^ (x >> U64(31))


def windows(hashes: np.ndarray, width: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of every run of `width` words; none if there are fewer. Runs are built by doubling."""
    if len(hashes) < width:
        return EMPTY
    out, done, block, size, power = None, 0, hashes, 1, base
    n, k = len(hashes), width
    while k:
        if k & 1:
            part = block[done : done + n - width + 1]
            out = part.copy() if out is None else out * _power(base, size) + part
            done += size
        k >>= 1
        if k:
            block = block[: len(block) - size] * power + block[size:]
            size, power = size * 2, power * power
    return mixed(out)


def _power(base: np.uint64, k: int) -> np.uint64:
    return U64(pow(int(base), k, 1 << 64))


def binary(column) -> list[bytes | None]:
    """An Arrow string or binary column as bytes."""
    import pyarrow as pa

    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return column.to_pylist()


np.seterr(over="ignore")
