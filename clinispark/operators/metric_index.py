"""Exact search for the largest inner product, by pivots and balls.

Vectors go to the cell of their nearest pivot, a cell knows its pivot and how far its farthest vector lies. The products
between two cells are at most center . center + r |c'| + r' |c| + r r', so a first pass scores every left cell with one
promising right cell, and a second pass only those pairs of cells whose bound reaches the least of what the first
has found for the vectors of the left cell. Pivots are vectors of the right table, a bounded number; whatever they are, the
result is exact. Cells are put on shelves of bounded size, a crowded cell on several, and pairs of shelves are the tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pivots at most, the bytes they may take, how many vectors each stands for at least, and the right vectors multiplied at a time.
PIVOTS, PIVOT_BYTES, CELL, BLOCK = 256, 8 << 20, 1024, 2048
#: Buckets of a column that both sides must share.
BUCKETS = 64
#: Shelves of a side, unless that makes fewer than FEW or more than SHELF vectors a shelf.
SHELVES, FEW, SHELF = 6, 512, 1 << 18


def whole(column: pd.Series) -> np.ndarray:
    """Which vectors are not null and hold finite numbers only."""
    return np.array([x is not None and bool(np.isfinite(np.asarray(x, float)).all()) for x in column], bool)


def choose_pivots(rows: DataFrame, most: int = PIVOTS) -> dict[int, np.ndarray]:
    """Some vectors of rows by their length, one for each CELL rows.

    Of a bounded sample, the first ones by hash, each next pivot is the one farthest from all pivots so far.
    """
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    room = PIVOT_BYTES // (8 * max(1, width))
    k = max(1, min(most, room, n // CELL))
    found = rows.select("embedding").where("embedding IS NOT NULL").orderBy(F.xxhash64("embedding")).limit(max(1, min(room, 16 * k))).toPandas()["embedding"]
    out: dict[int, list] = {}
    for x in found[whole(found)]:
        out.setdefault(len(x), []).append(np.asarray(x, float))
    return {w: farthest_first(np.stack(v), k) for w, v in out.items()}


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k different rows of x, each the farthest from those before it."""
    at, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(at) < k and far.max(initial=0) > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


class Cells:
    """rows (embedding and keys) dealt to the cells of pivots; numbers, centers, counts and radii of the cells that occur.

    Rows are told apart by buckets of the column `same` besides.
    """

    def __init__(self, rows: DataFrame, pivots: dict[int, np.ndarray], same: str | None = None):
        first, at = {}, 0
        for w, p in pivots.items():
            first[w], at = at, at + len(p)

        def deal(batches):
            for pdf in batches:
                pdf = pdf[whole(pdf["embedding"])]
                for w, part in pdf.groupby(pdf["embedding"].map(len)):
                    x = np.stack(part["embedding"]).astype(float)
                    p = pivots.get(w, np.zeros((1, w)))  # vectors of a length that has no pivot are a cell around zero
                    near = ((x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None]).argmin(1) if w else np.zeros(len(x), int)
                    far = np.sqrt(((x - p[near]) ** 2).sum(1))
                    yield part.assign(cell=(near + first[w] if w in first else -1 - w), far=far).astype({"cell": "int32"})

        self.keys = [c for c in rows.columns if c != "embedding"]
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64(same), F.lit(BUCKETS)).cast("int") if same else F.lit(0))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        self.rows = rows.mapInPandas(deal, f"{kinds}, cell int, far double")
        stats = self.rows.groupBy("cell", "bucket").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # at most PIVOTS * BUCKETS
        self.sizes = sorted((r.bucket, r.cell, r.n) for r in stats)
        self.cell = np.array(sorted({r.cell for r in stats}), np.int64)
        at = np.searchsorted(self.cell, np.array([r.cell for r in stats], np.int64))
        self.count, self.radius = np.zeros(len(self.cell), np.int64), np.zeros(len(self.cell))
        np.add.at(self.count, at, np.array([r.n for r in stats], np.int64))
        np.maximum.at(self.radius, at, np.array([r.far for r in stats], float))
        flat = {first[w] + i: x for w, p in pivots.items() for i, x in enumerate(p)}
        self.center = [flat.get(c, np.zeros(max(0, -1 - c))) for c in self.cell.tolist()]

    def shelves(self, single: bool = False) -> list[tuple[int, int, int, int]]:
        """(bucket, cell, part, shelf): cells in order on shelves of bounded size, each of one bucket; a larger cell in parts.

        A single cell has a shelf of its own.
        """
        size = int(min(SHELF, max(FEW, -(-int(self.count.sum()) // SHELVES))))
        out, shelf, room, last = [], -1, 0, None
        for bucket, cell, n in self.sizes:
            parts = -(-n // size)
            for part in range(parts):
                if single or bucket != last or n // parts > room:
                    shelf, room, last = shelf + 1, size, bucket
                room -= n // parts
                out.append((bucket, cell, part, shelf))
        return out


def dealt(left: Cells, mine: list, right: Cells, others: list, meets: np.ndarray, spark) -> tuple[DataFrame, DataFrame]:
    """Rows of both sides once for each pair (i, j) of a left and a right shelf of a bucket on which cells that meet lie."""
    held, bucket = [], []
    for side, places in ((left, mine), (right, others)):
        has = np.zeros((max([-1, *[p[3] for p in places]]) + 1, len(side.cell)))
        own = np.zeros(len(has), int)
        for b, cell, _, shelf in places:
            has[shelf, np.searchsorted(side.cell, cell)], own[shelf] = 1, b
        held.append(has)
        bucket.append(own)
    pairs = (held[0] @ meets @ held[1].T > 0) & (bucket[0][:, None] == bucket[1][None])
    tasks = max(1, min(1024, 2 * int(pairs.sum())))  # a number that is asked for isn't made smaller

    def rows(side, places, along, name, other):
        shelves: dict[tuple[int, int], list[int]] = {}
        for b, cell, _, shelf in places:
            shelves.setdefault((b, cell), []).append(shelf)
        at = spark.createDataFrame([(b, c, x) for (b, c), x in shelves.items()], "bucket int, cell int, shelves array<int>")
        to = spark.createDataFrame([(i, np.flatnonzero(x).tolist()) for i, x in enumerate(along)], f"{name} int, _to array<int>")
        each = side.rows.drop("far").join(F.broadcast(at), ["bucket", "cell"])
        each = each.withColumn(name, F.get("shelves", F.pmod(F.xxhash64(*side.keys), F.size("shelves")).cast("int"))).drop("shelves", "bucket")
        return each.join(F.broadcast(to), name).withColumn(other, F.explode("_to")).drop("_to").repartition(tasks, "i", "j")

    return rows(left, mine, pairs, "i", "j"), rows(right, others, pairs.T, "j", "i")


def bounds(left: Cells, right: Cells) -> tuple[np.ndarray, np.ndarray]:
    """Largest possible products of the cells' vectors, and the products of their centers; -inf where lengths differ."""
    out = np.full((2, len(left.cell), len(right.cell)), -np.inf)
    for w in {len(c) for c in left.center}:
        i, j = (np.array([k for k, c in enumerate(side.center) if len(c) == w], int) for side in (left, right))
        if len(i) and len(j):
            a, b = np.stack([left.center[k] for k in i]), np.stack([right.center[k] for k in j])
            ra, rb = left.radius[i][:, None], right.radius[j][None]
            na, nb = np.linalg.norm(a, axis=1)[:, None], np.linalg.norm(b, axis=1)[None]
            dots = a @ b.T
            top = dots + ra * nb + rb * na + ra * rb
            out[:, i[:, None], j[None]] = top + 1e-9 * (np.abs(dots) + np.abs(top) + na * nb) + 1e-12, dots
    return out[0], out[1]


def first_pairs(middle: np.ndarray) -> list[tuple[int, int]]:
    """For each left cell the right one whose center has the largest product with its own."""
    return [(i, int(row.argmax())) for i, row in enumerate(middle) if row.max(initial=-np.inf) > -np.inf]


def other_pairs(top: np.ndarray, least: np.ndarray, done: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs whose bound reaches what the left cell has in hand, without those that are done."""
    over = (top >= least[:, None]) & (top > -np.inf)
    for i, j in done:
        over[i, j] = False
    return list(zip(*(x.tolist() for x in np.nonzero(over)), strict=True))
