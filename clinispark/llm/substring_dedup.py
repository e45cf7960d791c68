"""Substring dedup with difference-cover anchors.

For a cover D modulo v, any two word positions i and j have a shift below v after which both lie in D modulo v. So two
equal runs of `length` words share an anchor: a window of length - v + 1 words at cover positions of both. Only anchors
are hashed and exchanged; where one occurs again, the runs that can hold it are extended: windows of the full length
around it are hashed to 128 bits, by two independent hashes of every word, and exchanged in turn; those that occur again
are taken as equal.

Documents are dealt to chunks of bounded bytes by a hash of doc_id and text; rows alike in both are counted as they are
read, so a chunk gets few of them. In a chunk all texts are one stream of
words; hashes go out as one blob per range of values, each hash at most once per chunk, and answers come back as
positions in the stream. No group of equal passages ever meets as rows.

Defined cases: null or empty texts have no words; texts with fewer words than `length` lose nothing; rows that repeat
are documents like others, so their long passages all go; a null doc_id is a value like others; an empty table gives an
empty result; texts of any length are taken whole; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .exchange import collapsed, filled, merged, pack, pack_sorted, unpack, unpack_sorted
from .words import BASE, EMPTY, MIX1, U64, hashed, hashed_twice, trim, windows

LENGTH = 35
#: Perfect difference covers: modulus and cover.
COVERS = {7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
PERIOD = 21
CHUNK_BYTES, RANGE_HASHES = 6_000_000, 1_500_000
BLOB = "range int, chunk int, kind int, first binary, second binary, at binary"
ANSWER = "chunk int, at binary"
SECOND = BASE ^ MIX1 | U64(1)


class Stream:
    """The words of a chunk's documents, in an order that only their rows decide."""

    def __init__(self, table, length: int = LENGTH, period: int = PERIOD, twice: bool = True):
        from .words import binary

        rows = merged(table.column("doc_id").to_pylist(), [t or b"" for t in binary(table.column("text"))], table.column("copies").to_pylist())
        # a row that repeats stands twice, so that its windows repeat; the second has no row of its own
        each = [(d, t, k) for d, t, n in rows for k in ([n, 0] if n > 1 else [1])]
        self.docs, self.texts, self.copies = [d for d, _, _ in each], [t for _, t, _ in each], [n for _, _, n in each]
        if twice:
            self.words, self.second, self.starts = hashed_twice(self.texts)
        else:  # anchors need one hash
            self.words, self.starts = hashed(self.texts)
        self.length, self.period = length, period

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Anchor hashes, ascending, and their positions."""
        width = self.length - self.period + 1
        every = windows(self.words, width)
        cover = np.zeros(self.period, bool)
        cover[list(COVERS[self.period])] = True
        at = []
        for a, b in zip(self.starts[:-1], self.starts[1:], strict=True):
            if b - a >= self.length:
                p = np.arange(b - a - width + 1)
                at.append(a + p[cover[p % self.period]])
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        h = every[at] if len(at) else EMPTY
        order = np.argsort(h, kind="stable")
        return h[order], at[order]

    def candidates(self, anchors: np.ndarray) -> np.ndarray:
        """Starts of full windows that hold one of the anchors at a place the shift can reach."""
        mark = np.zeros(len(self.words) + 1, np.int32)
        doc = np.searchsorted(self.starts, anchors, side="right") - 1
        low = np.maximum(anchors - self.period + 1, self.starts[doc])
        high = np.minimum(anchors, self.starts[doc + 1] - self.length) + 1
        ok = low < high
        np.add.at(mark, low[ok], 1)
        np.add.at(mark, high[ok], -1)
        return np.flatnonzero(np.cumsum(mark)[:-1] > 0)

    def full(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """128-bit hashes of the full windows at starts, ascending, and the starts."""
        if not len(at):
            return EMPTY, EMPTY, at
        first, second = windows(self.words, self.length)[at], windows(self.second, self.length, SECOND)[at]
        order = np.lexsort((second, first))
        return first[order], second[order], at[order]


def runs_of(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal keys in sorted arrays."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, n))


def requests(chunk: int, ranges: int, first: np.ndarray, at: np.ndarray, second: np.ndarray | None = None) -> list[dict]:
    """A row per range of hashes: each hash of the chunk once, with its position, or 0xFFFFFFFF if it has several here."""
    starts, counts = runs_of(*([first] if second is None else [first, second]))
    h, p = first[starts], at[starts].astype(np.uint32)
    p = np.where(counts > 1, np.uint32(0xFFFFFFFF), p)
    g = None if second is None else second[starts]
    out = []
    for r, a, b in filled(h, ranges):
        out.append({"range": r, "chunk": chunk, "kind": 0, "first": pack_sorted(h[a:b]), "second": None if g is None else pack(g[a:b]), "at": pack(p[a:b])})
    return out


def answers(table) -> list[dict]:
    """For a range of hashes: to each chunk, the positions of its single hashes that other chunks have too."""
    chunks = table.column("chunk").to_pylist()
    firsts = [unpack_sorted(b) for b in table.column("first").to_pylist()]
    positions = [unpack(b, np.uint32) for b in table.column("at").to_pylist()]
    sizes = [len(f) for f in firsts]
    first, at = np.concatenate(firsts), np.concatenate(positions)
    owner = np.repeat(np.arange(len(chunks)), sizes)
    seconds = table.column("second").to_pylist()
    if seconds[0] is None:
        order = np.argsort(first, kind="stable")
        starts, counts = runs_of(first[order])
    else:
        second = np.concatenate([unpack(b, np.uint64) for b in seconds])
        order = np.lexsort((second, first))
        starts, counts = runs_of(first[order], second[order])
    again = order[np.repeat(counts > 1, counts)]
    again = again[at[again] != 0xFFFFFFFF]
    again = again[np.argsort(owner[again], kind="stable")]
    edge = np.searchsorted(owner[again], np.arange(len(chunks) + 1))
    return [{"chunk": c, "at": pack(np.sort(at[again[edge[k] : edge[k + 1]]]))} for k, c in enumerate(chunks) if edge[k] < edge[k + 1]]


def _rows(rows: list[dict], names: str):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in names.split(", "))])
    table = pa.Table.from_pylist(rows, schema=schema)
    trim()
    return table


def _gathered(table) -> np.ndarray:
    found = [unpack(b, np.uint32) for b in table.column("at").to_pylist()]
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def _several(*keys: np.ndarray) -> np.ndarray:
    """Which entries of sorted keys have an equal neighbour."""
    starts, counts = runs_of(*keys)
    return np.repeat(counts > 1, counts)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, copies int"


def dedup_substrings(docs: DataFrame, *, length: int = LENGTH, period: int = PERIOD, with_text: bool = True) -> DataFrame:
    """docs (doc_id, text) -> RESULT without copies: words outside repeated windows, joined by one blank."""
    docs = store.columns(docs, "doc_id", "text")
    size = store.text_bytes(docs)
    chunks = store.parts(size, store.grown(CHUNK_BYTES, size))
    ranges = store.parts(size * 0.16 * len(COVERS[period]) / period, store.grown(RANGE_HASHES, size))
    dealt = collapsed(docs).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    dealt = store.dealt(dealt, chunks, "chunk")

    def ask_anchors(key, table):
        h, at = Stream(table, length, period, twice=False).anchors()
        return _rows(requests(key[0].as_py(), ranges, h, at), BLOB)

    def known(stream, table):
        h, at = stream.anchors()
        return stream.candidates(np.concatenate([at[_several(h)], _gathered(table)]))

    def ask_windows(key, left, right):
        if not left.num_rows:
            return _rows([], BLOB)
        stream = Stream(left, length, period)
        first, second, at = stream.full(known(stream, right))
        return _rows(requests(key[0].as_py(), ranges, first, at, second), BLOB)

    def answer(key, table):
        return _rows(answers(table), ANSWER)

    def finish(key, left, right):
        stream = Stream(left, length, period)
        mark = right.column("kind").to_numpy(zero_copy_only=False)
        import pyarrow as pa

        anchored, certain = right.filter(pa.array(mark == 0)), right.filter(pa.array(mark == 1))
        first, second, at = stream.full(known(stream, anchored))
        gone = np.concatenate([at[_several(first, second)], _gathered(certain)])
        cover = np.zeros(len(stream.words) + 1, np.int32)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + length, -1)
        lost = np.cumsum(cover)[:-1] > 0
        out = []
        for doc, text, n_rows, a, b in zip(stream.docs, stream.texts, stream.copies, stream.starts[:-1], stream.starts[1:], strict=True):
            if not n_rows:
                continue
            words, bad = text.split(), lost[a:b]
            n = int(bad.sum())
            kept = b" ".join(words if not n else [w for w, x in zip(words, bad, strict=True) if not x])
            out.append({"doc_id": doc, "n_words": len(words), "n_removed": n, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept_text": kept.decode() if with_text else None, "copies": n_rows})
        return _rows(out, RESULT)

    by_chunk = dealt.groupBy("chunk")
    by_range = lambda df: store.dealt(df, ranges, "range").groupBy("range")
    of_chunk = lambda df: store.dealt(df, chunks, "chunk").groupBy("chunk")
    anchors = by_range(by_chunk.applyInArrow(ask_anchors, BLOB)).applyInArrow(answer, ANSWER)
    certain = by_range(by_chunk.cogroup(of_chunk(anchors)).applyInArrow(ask_windows, BLOB)).applyInArrow(answer, ANSWER)
    found = anchors.withColumn("kind", F.lit(0)).unionByName(certain.withColumn("kind", F.lit(1)))
    out = by_chunk.cogroup(of_chunk(found)).applyInArrow(finish, RESULT)
    return out.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies")


def query(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs, with_text=False).drop("kept_text")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
v AS (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d)),
t AS (SELECT r, i FROM v QUALIFY count(*) OVER (PARTITION BY k) > 1),
m AS (SELECT w.r, p, word, coalesce(max(t.i) OVER (PARTITION BY w.r ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) > 0 AS gone FROM w LEFT JOIN t ON t.r = w.r AND t.i = p)
SELECT d.doc_id, CAST(len(any_value(d.ws)) AS BIGINT) AS n_words, CAST(coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN m ON m.r = d.r GROUP BY d.r, d.doc_id
"""
