"""Benchmark decontamination by size-partitioned MinHash containment, then exact shingle containment.

Items are partitioned by the size of their shingle set. In a partition whose largest set has u shingles an item's sketch is
its k = floor((1 - t) * u) + HITS smallest shingle hashes, a bottom-k MinHash. The share of a sketch that a document's
shingles hold estimates the containment of the item, whatever the document's length. A document that holds a share t of the
n shingles lacks at most (1 - t) * n of them, so at least k - floor((1 - t) * n) of its sketch is there: an estimate below
that can't belong to a match and the others are candidates. A partition is passed over for documents with fewer shingles
than its smallest item needs. Candidates are verified on the shingles' words themselves, not on hashes.

Texts are lower-cased and freed of ASCII punctuation, then cut at blanks.

Defined cases: null or empty texts and items without words match nothing; an item of fewer than five words is one
shingle of all of them, sought as a run of words; rows that repeat match each; an empty benchmark or table gives an
empty result; documents are read whole; columns beside doc_id, item_id and text are ignored, and `stage` keeps them.
"""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .words import LOWER, U64, hashed, windows

WIDTH, LEAST = 5, 0.8
PUNCTUATION = string.punctuation.encode()
#: Hits of a sketch that a match has at the least, where its set is the largest of its partition.
HITS = 3
#: Bytes of item texts that one index holds; its sketches and words take about eight times that in each worker. A larger
#: benchmark is taken in slices of this size, each a pass over the documents, so no task ever holds more.
INDEX_BYTES = 8 << 20
PAIRS = "doc_id long, text_hash long, item_id long, n_item_shingles long, n_shared long, containment double, estimate double"


def normal(text: bytes) -> bytes:
    """Lower case, and ASCII punctuation deleted."""
    if text.isascii():
        return text.translate(LOWER, PUNCTUATION)
    return text.translate(None, PUNCTUATION).decode().lower().encode()


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, apart from those of other widths."""
    return windows(hashes, width) ^ U64(width * 0x9E3779B97F4A7C15 % (1 << 64))


def phrases(words: list[bytes], width: int) -> set[bytes]:
    """Distinct runs of `width` words; a blank can't be in a word."""
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


class Index:
    """Sketches of items by shingle width and size partition. items: ascending (item_id, words)."""

    def __init__(self, items: list[tuple[int, list[bytes]]], least: float):
        self.items, self.least = [], least
        groups: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for item, words in items:
            width = min(WIDTH, len(words))
            if width:
                s = np.unique(runs(hashed([b" ".join(words)])[0], width))
                groups.setdefault((width, len(s).bit_length()), []).append((len(self.items), s))
                self.items.append((item, width, phrases(words, width)))
        #: (width, least shingles of a document, ascending sketch hashes, their items, keys, lost + 1 of each item)
        self.partitions = []
        for (width, _), held in sorted(groups.items()):
            lacks = lambda n: int((1 - least) * n + 1e-9)  # noqa: E731  shingles that a match may lack
            k = lacks(max(len(s) for _, s in held)) + HITS
            h, owner = np.concatenate([s[:k] for _, s in held]), np.repeat([i for i, _ in held], [min(k, len(s)) for _, s in held])
            order = np.argsort(h, kind="stable")
            need = {i: min(k, len(s)) - lacks(len(s)) for i, s in held}
            size = {i: min(k, len(s)) for i, s in held}
            self.partitions.append((width, min(len(s) - lacks(len(s)) for _, s in held), h[order], owner[order], np.unique(h), need, size))

    def matches(self, hashes: np.ndarray, text: bytes) -> list[tuple[int, int, int, float]]:
        """(item_id, its shingles, those shared, estimate) of items contained in a document, given its word hashes and words."""
        out, found, words = [], {}, None
        for width, least, h, owner, keys, need, size in self.partitions:
            if width not in found:
                found[width] = runs(hashes, width)
            if len(found[width]) < least:
                continue
            place = np.minimum(np.searchsorted(keys, found[width]), len(keys) - 1)
            here = np.unique(found[width][keys[place] == found[width]])
            if not len(here):
                continue
            items, hits = np.unique(owner[np.isin(h, here)], return_counts=True)
            for i, n in zip(items.tolist(), hits.tolist(), strict=True):
                if n < need[i]:
                    continue
                words = words if words is not None else text.split()
                item, _, wanted = self.items[i]
                shared = len(wanted & phrases(words, width))
                if shared >= self.least * len(wanted) - 1e-9:
                    out.append((item, len(wanted), shared, n / size[i]))
        return out


def find(docs: DataFrame, benchmark: DataFrame, *, least: float = LEAST, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """PAIRS of documents and the benchmark items they contain."""
    spark = docs.sparkSession
    items = store.columns(benchmark, "item_id", "text").where("text IS NOT NULL")
    slices = store.parts(store.text_bytes(items), index_bytes)
    found = None
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k) if slices > 1 else items
        rows = [(r["item_id"], normal(r["text"].encode()).split()) for r in part.orderBy("item_id", "text").collect()]
        index = spark.sparkContext.broadcast(Index(rows, least))

        def scan(batches, index=index):
            import pyarrow as pa

            from .words import binary, slices

            one, names = index.value, [f.split()[0] for f in PAIRS.split(", ")]
            for batch in slices(batches):
                texts = [normal(t or b"") for t in binary(batch.column("text"))]
                hashes, at = hashed(texts)
                out = []
                for k, (doc, row) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), strict=True)):
                    out += [(doc, row, item, n, shared, shared / n, e) for item, n, shared, e in one.matches(hashes[at[k] : at[k + 1]], texts[k])]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=_pairs())

        keyed = docs.select("doc_id", "text", store.text_hash(docs).alias("text_hash"))
        part = keyed.mapInArrow(scan, PAIRS)
        found = part if found is None else found.unionByName(part)
    return found


def _pairs():
    import pyarrow as pa

    kinds = {"long": pa.int64(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in PAIRS.split(", "))])


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs with the exact containment; the estimate stays with `find`."""
    return find(docs, benchmark).drop("text_hash", "estimate")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, each row judged by its own text."""
    found = find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return store.without(docs, store.written(store.few(found.select("doc_id", "text_hash")), "leaks"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
i AS (SELECT row_number() OVER () AS r, item_id, list_filter(regexp_split_to_array(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT r, item_id, ws, least(5, len(ws)) AS w FROM i WHERE len(ws) > 0),
s AS (SELECT DISTINCT r, item_id, w, array_to_string(ws[k:k + w - 1], ' ') AS p FROM (SELECT *, unnest(range(1, len(ws) - w + 2)) AS k FROM n)),
z AS (SELECT r, count(*) AS n FROM s GROUP BY r),
h AS (SELECT DISTINCT r, doc_id, w, array_to_string(ws[k:k + w - 1], ' ') AS p FROM (SELECT d.*, v.w, unnest(range(1, len(ws) - v.w + 2)) AS k FROM d, (SELECT DISTINCT w FROM n) v))
SELECT h.doc_id, s.item_id, any_value(z.n) AS n_item_shingles, count(*) AS n_shared, CAST(count(*) AS DOUBLE) / any_value(z.n) AS containment
FROM h JOIN s ON s.p = h.p AND s.w = h.w JOIN z ON z.r = s.r GROUP BY h.r, h.doc_id, s.r, s.item_id HAVING count(*) >= 0.8::DOUBLE * any_value(z.n) - 1e-9
"""
