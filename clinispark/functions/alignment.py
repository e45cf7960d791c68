"""Kinds of word errors: substitutions, deletions and insertions of a least-cost alignment, in linear space."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = "struct<hits: bigint, substitutions: bigint, deletions: bigint, insertions: bigint>"
_NAMES = ["hits", "substitutions", "deletions", "insertions"]
#: A base of weights: of alignments with the fewest edits that with the most hits counts, so the kinds are unique.
_EDIT = np.int64(1) << 32
#: Numbers of a diagonal of tables, or of matches, that are worked on at once.
CELLS = 1 << 15
#: Numbers that are worked on in the time that starting a step takes.
STEP = 4096
#: Rows whose words are held as texts at a time.
ROWS = 512
#: Cells of a table that take as long as a pair of matches.
CHAIN = 1.0


def _costs(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """Least cost of each pair, edits * _EDIT - hits; of each pair three diagonals are held, all pairs at a time.

    Words are numbers below 1 << 15, or the sum of the lengths if that is more. A deletion or an insertion counts 0, a
    substitution `one` and a hit 2 * one + 1, and the most counts: an alignment of n and m words then costs (n + m) * one less
    that, in edits of `one`. So cells of a diagonal don't wait for one another.
    """
    n, m = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    wide, high = int(n.max(initial=0)), int(m.max(initial=0))
    most = np.array([_shared(*p)[0] for p in pairs], np.int64)
    one = int(most.max(initial=0)) + 1  # more than the hits there can be
    top = int((np.minimum(n, m) * one + most * (one + 1)).max(initial=0))
    # the cells of shorter pairs that are filled up don't matter, they may wrap around
    kind = np.uint16 if top < 1 << 16 else np.int32 if top < 1 << 31 else np.int64
    word = np.int16 if wide + high < 1 << 15 else np.int32
    r, h = np.full((wide, len(pairs)), -1, word), np.full((high, len(pairs)), -2, word)
    for i, (x, y) in enumerate(pairs):
        r[: len(x), i], h[high - len(y) :, i] = x, y[::-1]  # the other way round, so that a diagonal is two slices
    # row i of a diagonal k is the cell of i and k - i words; rows lie one after the other in flat arrays, since views of those cost less
    x = len(pairs)
    r, h = r.ravel(), h.ravel()
    last, this, free = (np.zeros((wide + 1) * x, kind) for _ in range(3))
    same, gain, out, ends = np.empty(wide * x, bool), np.empty(wide * x, kind), np.zeros(x, np.int64), {}
    for i, k in enumerate((n + m).tolist()):
        ends.setdefault(k, []).append(i)
    more, plain = kind(one + 1), kind(one)
    for k in range(2, wide + high + 1):
        a, b = max(1, k - high) * x, min(wide, k - 1) * x + x
        w, g, new, at = same[: b - a], gain[: b - a], free[a:b], (high - k) * x
        np.equal(r[a - x : b - x], h[at + a : at + b], out=w)
        np.multiply(w, more, out=g)
        np.add(g, plain, out=g)
        np.add(g, last[a - x : b - x], out=g)
        np.maximum(this[a:b], this[a - x : b - x], out=new)
        np.maximum(new, g, out=new)
        if k - 1 < wide:
            free[b : b + x] = 0
        if a == x:
            free[:x] = 0
        last, this, free = this, free, last
        if k in ends:
            done = np.array(ends[k])
            out[done] = this[n[done] * x + done]
    # most = edits saved * one + hits
    hits = np.where((n > 0) & (m > 0), out % one, 0)
    edits = n + m - out // one
    return (edits * _EDIT - hits).tolist()


def _shared(r: np.ndarray, h: np.ndarray) -> tuple[int, int]:
    """Hits there can be at most, and the pairs of equal words of both sides."""
    size = 1 + max(r.max(initial=-1), h.max(initial=-1))
    a, b = (np.bincount(x, minlength=size) for x in (r, h))
    return int(np.minimum(a, b).sum()), int(a @ b)


def _matches(r: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal words in r and h, in ascending order."""
    order = np.argsort(h, kind="stable")
    lo, hi = (np.searchsorted(h[order], r, side=s) for s in ("left", "right"))
    n = hi - lo
    i = np.repeat(np.arange(len(r)), n)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]


def _chain_costs(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """As _costs, for pairs with few equal words: the best chain of them, all pairs at a time.

    From one hit of a chain to the next, the words between on the longer side are edits. Each hit seeks the best of all
    before it, so the work of a pair is the square of its equal words.
    """
    found = [_matches(*p) for p in pairs]
    n, m = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
    count = max(len(i) for i, _ in found)
    edit = min(int(np.minimum(n, m).max(initial=0)), count) + 1  # more than the hits there can be
    far = 2 * int(np.maximum(n, m).max(initial=0)) + 2
    kind = np.int32 if 4 * far * edit < 1 << 31 else np.int64
    none = kind(2 * far * edit)
    i, j = np.full((count, len(pairs)), far // 2, kind), np.full((count, len(pairs)), far // 2, kind)  # what is filled up lies beyond all ends
    for k, (x, y) in enumerate(found):
        i[: len(x), k], j[: len(x), k] = x, y
    real = i < far // 2
    ie, je = i * kind(edit), j * kind(edit)
    # what a chain costs up to a hit, less the place of the hit on either side
    by_i, by_j, cost = np.empty_like(i), np.empty_like(i), np.empty_like(i)
    s, t, ok, also = np.empty_like(i), np.empty_like(i), np.empty(i.shape, bool), np.empty(i.shape, bool)
    for k in range(count):
        best = np.maximum(ie[k], je[k])
        if k:
            u, v, o, p = s[:k], t[:k], ok[:k], also[:k]
            np.add(by_i[:k], ie[k], out=u)
            np.add(by_j[:k], je[k], out=v)
            np.maximum(u, v, out=u)
            np.greater_equal(i[:k], i[k], out=o)
            np.greater_equal(j[:k], j[k], out=p)
            np.logical_or(o, p, out=o)
            np.multiply(o, none, out=v)
            u += v
            best = np.minimum(best, u.min(axis=0) - kind(edit))
        cost[k] = best - 1
        by_i[k], by_j[k] = cost[k] - ie[k], cost[k] - je[k]
    rest = np.maximum(n - 1 - i, m - 1 - j) * edit
    out = np.minimum(np.maximum(n, m) * edit, np.where(real, cost + rest, np.int64(1) << 62).min(axis=0, initial=np.int64(1) << 62))
    edits = -(-out // edit)
    return (edits * _EDIT - (edits * edit - out)).tolist()


def _groups(sizes: list[tuple[int, int, int]]) -> list[list[int]]:
    """Pairs that go together, by (class, logarithm of the width, steps).

    As many as keep all of them within CELLS and as long as filling the steps up costs less than steps of their own.
    """
    order, at, out = sorted(range(len(sizes)), key=sizes.__getitem__), 0, []
    while at < len(order):
        k, spare, (sort, width, n) = at + 1, 0, sizes[order[at]]
        wide = 2 << width
        while k < len(order) and sizes[order[k]][:2] == (sort, width) and (k - at + 1) * (sizes[order[k]][2] + 1) <= CELLS:
            spare += (k - at) * (sizes[order[k]][2] - n) * wide
            if spare > STEP * (wide + n):
                break
            k, n = k + 1, sizes[order[k]][2]
        out.append(order[at:k])
        at = k
    return out


def _kinds_of(pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A row (hits, substitutions, deletions, insertions) for each pair of arrays of numbers."""
    left, same, lengths, tabled, sizes, few, links = [], [], [], [], [], [], []
    for at, (r, h) in enumerate(pairs):
        lengths.append((len(r), len(h)))
        short = min(len(r), len(h))
        differ = np.flatnonzero(r[:short] != h[:short])
        a = int(differ[0]) if len(differ) else short  # equal ends align in any case
        differ = np.flatnonzero(r[a:][::-1][: short - a] != h[a:][::-1][: short - a])
        b = int(differ[0]) if len(differ) else short - a
        r, h = r[a : len(r) - b], h[a : len(h) - b]
        r, h = (h, r) if len(r) > len(h) else (r, h)  # the shorter side's words make the steps
        ids = np.unique(np.concatenate([r, h]), return_inverse=True)[1]
        ids = ids.astype(np.int16 if len(ids) < 1 << 15 else np.int32)
        left.append((ids[: len(r)], ids[len(r) :]))
        same.append(a + b)
        hits, met = _shared(*left[-1])
        if CHAIN * met * met <= len(r) * len(h):
            few.append(at)
            links.append((0, 0, met))
        else:
            tabled.append(at)
            sizes.append((int(min(len(r), len(h)) * (hits + 1) + hits * (hits + 2) >= 1 << 16), int(np.log2(len(h) + 1)), len(r)))
    cost = np.zeros(len(left), np.int64)
    for inner, places, by in ((_costs, tabled, sizes), (_chain_costs, few, links)):
        for group in _groups(by):
            mine = [places[k] for k in group]
            cost[mine] = inner([left[i] for i in mine])
    n, m = np.array(lengths, np.int64).reshape(-1, 2).T
    edits = -(-cost // _EDIT)
    hits = np.array(same, np.int64) + edits * _EDIT - cost
    subs = n + m - 2 * hits - edits  # n + m = 2 * (hits + subs) + dels + ins, and edits = subs + dels + ins
    return np.stack([hits, subs, n - hits - subs, m - hits - subs], axis=1)


def kinds_of(pairs: list[tuple[list[str], list[str]]]) -> list[tuple[int, int, int, int]]:
    """(hits, substitutions, deletions, insertions) of each (reference, hypothesis): fewest edits, then most hits.

    With both, the lengths of the two sides fix the kinds: n = hits + subs + dels and m = hits + subs + ins.
    """
    ids: dict[str, int] = {}
    numbers = [tuple(np.array([ids.setdefault(w, len(ids)) for w in x], np.int64) for x in p) for p in pairs]
    return [tuple(k) for k in _kinds_of(numbers).tolist()]


def kinds(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int, int]:
    return kinds_of([(reference, hypothesis)])[0]


def _numbered(reference: pa.Array, hypothesis: pa.Array, words: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of numbers for the words of each row; words: column -> the words of all rows and how many each row has."""
    for at in range(0, len(reference), ROWS):
        sides = [words(x.slice(at, ROWS)) for x in (reference, hypothesis)]
        ids = pa.concat_arrays([x for x, _ in sides]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        yield from zip(*(np.split(x, np.cumsum(n)[:-1]) for x, (_, n) in zip(np.split(ids, [len(sides[0][0])]), sides, strict=True)), strict=True)


def _of_array(x: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return x.flatten(), x.value_lengths().to_numpy(zero_copy_only=False)


def _of_text(x: pa.Array) -> tuple[pa.Array, np.ndarray]:
    lists = pc.split_pattern(x, " ")
    words = lists.flatten()
    real = pc.not_equal(words, "")
    return words.filter(real), np.bincount(pc.list_parent_indices(lists).filter(real).to_numpy(), minlength=len(x))


def _struct(kinds: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(x) for x in kinds.T], _NAMES)


def _kinds(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    return _struct(_kinds_of(_numbered(reference, hypothesis, _of_array)))


def _kinds_of_texts(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    return _struct(_kinds_of(_numbered(reference, hypothesis, _of_text)))


def word_errors(reference: Column, hypothesis: Column) -> Column:
    """KINDS of two arrays of words; a null array is empty. The row's memory is linear in its words."""
    empty = F.array().cast("array<string>")
    return F.arrow_udf(_kinds, KINDS)(F.coalesce(reference, empty), F.coalesce(hypothesis, empty))


def text_errors(reference: Column, hypothesis: Column) -> Column:
    """KINDS of two texts with blanks between words, which are smaller than arrays of their words; a null text is empty."""
    return F.arrow_udf(_kinds_of_texts, KINDS)(F.coalesce(reference, F.lit("")), F.coalesce(hypothesis, F.lit("")))
