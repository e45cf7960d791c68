"""Hard-negative mining by dual-tree search.

Anchors and candidates each get a tree: hyperplanes fitted on a bounded sample deal every row to a leaf, leaves are cut into
blocks of bounded size, and a block into small groups of rows. Every node has a ball that holds all its rows. The inner
products of a pair of nodes lie in an interval that follows from the balls, so a pair is left out, with all its anchors at
once, if none of them can use a product in it: first pairs of leaves, then pairs of groups within a pair of blocks. What is
left is scored exactly.

An anchor asks for the first k rows whose score lies in a window: of its own label for positives, of others for negatives.
A first pass scores each block of anchors with one promising block; what it finds narrows the windows for the second, which
visits all other pairs that the intervals leave. Blocks meet in cells of bounded size, and of each cell at most k rows an
anchor and window leave the task. If vectors are alike in all directions, the intervals leave nearly all pairs: the work is
then that of all anchors with all rows, as any exact search's is, but still in bounded pieces.

Defined cases: rows with a null label or vector, or null or non-finite components, take no part; a null vec_id is no anchor
and comes last among ties; rows of the same vec_id are never each other's positives or negatives; rows that repeat are rows
like others, but as an anchor a repeated row counts once; vectors shorter than the longest count as padded with zeros;
components too large for exact products (beyond 2 ** 22 after scaling, at width 64) count as that bound; an anchor without
positives, or a positive without negatives in its window, has no row in the result; an empty table gives an empty result;
other columns are ignored whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store
from .exchange import pack, unpack
from .vectors import integers, padded
from .words import trim

SCALE = 256
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Rows on which a tree is fitted, the bytes they may take, and its leaves at most.
SAMPLE, SAMPLE_BYTES, LEAVES = 4096, 16 << 20, 1024
#: Rows of a block and of a group in it, for candidates and for anchors; blocks of anchors in a cell.
BLOCK, GROUP, ANCHOR_BLOCK, ANCHOR_GROUP, CELL = 4096, 256, 2048, 32, 8
#: Columns that are scored at once.
STEP = 1024
FREE = 1 << 60
PART = "leaf int, n int, ids array<bigint>, labels array<bigint>, vectors binary, far double"
NODE = "block int, leaf int, n int, ids array<bigint>, labels array<bigint>, vectors binary, starts array<int>, centers binary, radii array<double>"
FOUND = "block int, at int, w int, score long, id long"


def largest(width: int) -> int:
    """The bound of components that keeps products of vectors exact in doubles."""
    return 1 << (52 - max(1, width).bit_length()) // 2


def direction(x: np.ndarray) -> np.ndarray:
    """From a far point to one far from it."""
    a = x[((x - x[0]) ** 2).sum(1).argmax()]
    return x[((x - a) ** 2).sum(1).argmax()] - a


def balls(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole-number centers and radii of runs of rows."""
    n = np.diff(np.append(starts, len(x)))
    centers = np.rint(np.add.reduceat(x, starts, 0) / n[:, None])
    far = ((x - np.repeat(centers, n, 0)) ** 2).sum(1)
    return centers, np.sqrt(np.maximum.reduceat(far, starts))


def grouped(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows in groups of at most `most`, halved at the median along a far direction."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= most:
            out.append(at)
            continue
        order = at[np.argsort(x[at] @ direction(x[at]), kind="stable")]
        todo += [order[len(at) // 2 :], order[: len(at) // 2]]
    return np.concatenate(out), np.cumsum([0, *map(len, out[:-1])])


class Tree:
    """Hyperplanes over a sample; nodes in an array, the root first. Radii are set once all rows have been dealt."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.plane, self.cut, self.child, self.leaf, self.center = [], [], [], [], []
        self.leaves, ends = 0, []
        width, todo, at = sample.shape[1], [(np.arange(len(sample)), leaves)], 0
        while at < len(todo):
            rows, share = todo[at]
            x = sample[rows]
            self.center.append(np.rint(x.mean(0)) if len(x) else np.zeros(width))
            plane = direction(x) if len(x) and share > 1 else np.zeros(width)
            along = x @ plane
            cut = np.median(along) if len(x) else 0.0
            if len(x) and along.max() == cut:
                cut = along[along < cut].max(initial=cut)
            right = along > cut
            if right.any() and not right.all():
                self.child.append(len(todo))
                self.leaf.append(-1)
                todo += [(rows[~right], share - share // 2), (rows[right], share // 2)]
            else:
                self.child.append(-1)
                self.leaf.append(self.leaves)
                ends.append(at)
                self.leaves += 1
            self.plane.append(plane)
            self.cut.append(cut)
            at += 1
        self.plane, self.center = np.array(self.plane).reshape(-1, width), np.array(self.center).reshape(-1, width)
        self.cut, self.child, self.leaf, self.ends = map(np.array, (self.cut, self.child, self.leaf, ends))
        self.radius = np.zeros(len(self.cut))

    def deal(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        node = np.zeros(len(x), np.int64)
        todo = [0] if self.child[0] >= 0 else []
        while todo:
            k = todo.pop()
            rows = np.flatnonzero(node == k)
            if len(rows):
                node[rows] = self.child[k] + (x[rows] @ self.plane[k] > self.cut[k])
                todo += [c for c in (self.child[k], self.child[k] + 1) if self.child[c] >= 0]
        return self.leaf[node]

    def enclose(self, far: dict[int, float]) -> None:
        """Sets radii from the farthest row of each leaf; a leaf without rows, and a node over such, is left out by -1."""
        for k in range(len(self.cut) - 1, -1, -1):
            if self.child[k] < 0:
                self.radius[k] = far.get(int(self.leaf[k]), -1.0)
            else:
                two = [c for c in (self.child[k], self.child[k] + 1) if self.radius[c] >= 0]
                self.radius[k] = max([np.linalg.norm(self.center[c] - self.center[k]) + self.radius[c] for c in two], default=-1.0)

    def over(self, leaf_values: np.ndarray, fold) -> np.ndarray:
        """Values of leaves folded up to all nodes."""
        out = np.zeros(len(self.cut), leaf_values.dtype)
        for k in range(len(self.cut) - 1, -1, -1):
            out[k] = leaf_values[self.leaf[k]] if self.child[k] < 0 else fold(out[self.child[k]], out[self.child[k] + 1])
        return out


def interval(dots: np.ndarray, na, ra, nc, rc) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of inner products between rows of two balls, from their centers' product and norms, and their radii."""
    spread = ra * nc + na * rc + ra * rc
    slack = 1e-9 * (np.abs(dots) + spread) + 1e-3
    return dots - spread - slack, dots + spread + slack


def traverse(anchors: Tree, rows: Tree, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves whose interval meets what some anchor below asks for, low to high by anchors' leaf, and upper bounds.

    Pairs of nodes are opened from the roots; one that is left out takes all pairs below with it.
    """
    low, high = anchors.over(low, min), anchors.over(high, max)
    na, nc = np.linalg.norm(anchors.center, axis=1), np.linalg.norm(rows.center, axis=1)
    pairs, out, bounds = np.zeros((1, 2), np.int64), [], []
    while len(pairs):
        new = []
        for i in range(0, len(pairs), 1 << 14):
            a, c = pairs[i : i + (1 << 14)].T
            least, most = interval((anchors.center[a] * rows.center[c]).sum(1), na[a], anchors.radius[a], nc[c], rows.radius[c])
            ok = (anchors.radius[a] >= 0) & (rows.radius[c] >= 0) & (most >= low[a]) & (least <= high[a])
            a, c, most = a[ok], c[ok], most[ok]
            inner_a, inner_c = anchors.child[a] >= 0, rows.child[c] >= 0
            out.append(np.stack([anchors.leaf[a], rows.leaf[c]], 1)[~inner_a & ~inner_c])
            bounds.append(most[~inner_a & ~inner_c])
            wide = inner_a & (~inner_c | (anchors.radius[a] >= rows.radius[c]))
            for part, first, held in ((wide, anchors.child[a], c), (inner_c & ~wide, rows.child[c], a)):
                for k in (0, 1):
                    new.append(np.stack([first[part] + k, held[part]] if part is wide else [held[part], first[part] + k], 1))
        pairs = np.concatenate(new) if new else pairs[:0]
    return np.concatenate(out) if out else pairs, np.concatenate(bounds) if bounds else np.zeros(0)


def first_k(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest allowed scores of each row and their ids, ties by smaller id; -FREE where there are fewer."""
    m = len(ids)
    rank = np.empty(m, np.int64)
    rank[np.argsort(-ids, kind="stable")] = np.arange(m)
    keyed = np.where(allowed, scores * m + rank, -FREE * 4)
    k = min(k, m)
    at = np.argpartition(keyed, m - k, axis=1)[:, m - k :] if k < m else np.broadcast_to(np.arange(m), keyed.shape)
    top = np.take_along_axis(keyed, at, 1)
    order = np.argsort(-top, axis=1)
    at, top = np.take_along_axis(at, order, 1), np.take_along_axis(top, order, 1)
    return np.where(top > -FREE * 4, np.take_along_axis(scores, at, 1), -FREE), ids[at]


def merged(held: tuple, new: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The first of two lists of scores and ids of each row, as many as the first list has."""
    k = held[0].shape[-1]
    scores, ids = np.concatenate([held[0], new[0]], -1), np.concatenate([held[1], new[1]], -1)
    order = np.lexsort((ids, -scores))[..., :k]
    return np.take_along_axis(scores, order, -1), np.take_along_axis(ids, order, -1)


class Block:
    """A row of NODE, opened."""

    def __init__(self, row: dict, width: int):
        self.block, self.starts = row["block"], np.array(row["starts"], np.int64)
        self.ids = np.array([store.LAST if i is None else i for i in row["ids"]], np.int64)
        self.labels, self.radii = np.array(row["labels"], np.int64), np.array(row["radii"], float)
        self.x = unpack(row["vectors"], np.int32).reshape(-1, width).astype(float)
        self.centers = unpack(row["centers"], np.int32).reshape(-1, width).astype(float)
        self.norms = np.linalg.norm(self.centers, axis=1)
        self.ends = np.append(self.starts[1:], len(self.x))


def searched(anchors: Block, rows: Block, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids, products made) of the first k rows in each window (low, high by anchor and window) of each anchor.

    Groups of rows are taken in the order of what they can reach at most, and left out once no anchor of the group can use them.
    """
    scores = np.full((*low.shape, k), -FREE)
    ids, made = np.full(scores.shape, store.LAST), 0
    for g, (a, b) in enumerate(zip(anchors.starts, anchors.ends, strict=True)):
        least, most = interval(rows.centers @ anchors.centers[g], anchors.norms[g], anchors.radii[g], rows.norms, rows.radii)
        todo = np.argsort(-most, kind="stable")
        need, top = np.maximum(low[a:b], scores[a:b, :, -1]), high[a:b]
        while len(todo):
            useful = [m for m in todo if ((most[m] >= need) & (least[m] <= top)).any()]
            if not useful:
                break
            size = np.cumsum([rows.ends[m] - rows.starts[m] for m in useful])
            n = max(1, int(np.searchsorted(size, STEP, side="right")))
            at = np.concatenate([np.arange(rows.starts[m], rows.ends[m]) for m in useful[:n]])
            todo = useful[n:]
            dots = (anchors.x[a:b] @ rows.x[at].T).astype(np.int64)
            made += dots.size
            pair = (anchors.labels[a:b, None] == rows.labels[at][None]) == same
            pair &= anchors.ids[a:b, None] != rows.ids[at][None]
            for w in range(low.shape[1]):
                ok = pair & (dots >= need[:, w, None]) & (dots <= top[:, w, None])
                if ok.any():
                    scores[a:b, w], ids[a:b, w] = merged((scores[a:b, w], ids[a:b, w]), first_k(dots, rows.ids[at], ok, k))
            need = np.maximum(need, scores[a:b, :, -1])
    return scores, ids, made


class Grown:
    """A tree over rows, and its blocks as a written table of NODE. first and count: the blocks of each leaf."""

    def __init__(self, rows: DataFrame, width: int, block: int, group: int):
        spark, self.width = rows.sparkSession, width
        limit = largest(width)

        def opened(batch):
            good, ints = integers(batch.column("embedding"), SCALE)
            return good, padded(ints, width, limit)

        n, piece = rows.count(), max(1, block // 8)
        some = min(SAMPLE, max(1, SAMPLE_BYTES // (8 * width)))
        sample = rows.select("embedding").orderBy(F.xxhash64("vec_id", "embedding")).limit(some).toArrow().combine_chunks()
        self.tree = tree = Tree(opened(sample)[1].astype(float), min(LEAVES, store.parts(n, block)))

        def deal(batches):
            import pyarrow as pa

            for batch in batches:
                good, x = opened(batch)
                part, leaf = batch.filter(pa.array(good)), tree.deal(x.astype(float))
                order = np.argsort(leaf, kind="stable")
                out = []
                for f in np.unique(leaf):
                    mine = order[np.searchsorted(leaf[order], f) : np.searchsorted(leaf[order], f, side="right")]
                    for i in range(0, len(mine), piece):
                        at = mine[i : i + piece]
                        far = ((x[at] - tree.center[tree.ends[f]]) ** 2).sum(1).max() ** 0.5
                        ids, labels = (part.column(c).take(pa.array(at)).to_pylist() for c in ("vec_id", "label"))
                        out.append({"leaf": int(f), "n": len(at), "ids": ids, "labels": labels, "vectors": pack(x[at].astype(np.int32).reshape(-1)), "far": float(far)})
                yield from pa.Table.from_pylist(out, schema=part_schema).to_batches()

        part_schema = _arrow(PART)
        parts = store.written(rows.mapInArrow(deal, PART).withColumn("nth", F.monotonically_increasing_id()), "parts")
        held = parts.groupBy("leaf").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()  # a row for each leaf at most
        tree.enclose({r.leaf: r.far for r in held})
        self.count = np.zeros(tree.leaves, np.int64)
        for r in held:
            self.count[r.leaf] = store.parts(r.n, block)
        self.first = np.cumsum(self.count) - self.count
        self.total = int(self.count.sum())
        places = store.table(spark, [(i, int(self.first[i]), int(c)) for i, c in enumerate(self.count) if c], "leaf int, first int, blocks int")
        dealt = parts.join(F.broadcast(places), "leaf").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("nth"), F.col("blocks"))).cast("int"))

        node_schema = _arrow(NODE)

        def gather(table):
            import pyarrow as pa

            x = np.concatenate([unpack(b, np.int32) for b in table.column("vectors").to_pylist()]).reshape(-1, width)
            order, starts = grouped(x.astype(float), group)
            x = x[order]
            centers, radii = balls(x.astype(float), starts)
            ids, labels = ([v[i] for i in order] for v in ([y for part in table.column(c).to_pylist() for y in part] for c in ("ids", "labels")))
            row = {"block": table.column("block")[0].as_py(), "leaf": table.column("leaf")[0].as_py(), "n": len(x), "ids": ids, "labels": labels, "vectors": pack(x.reshape(-1)), "starts": starts.tolist(), "centers": pack(centers.astype(np.int32).reshape(-1)), "radii": radii.tolist()}
            trim()
            return pa.Table.from_pylist([row], schema=node_schema)

        dealt = store.dealt(dealt.select("block", "leaf", "n", "ids", "labels", "vectors"), max(1, self.total), "block")
        self.blocks = store.written(dealt.groupBy("block").applyInArrow(gather, NODE), "nodes")
        store.drop(parts)


def _arrow(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _met(anchors: Grown, rows: Grown, tiles: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """FOUND of the tiles (ablock, cblock): blocks meet in cells, each of one block of rows and CELL blocks of anchors at most."""
    supers = store.parts(max(1, anchors.total), CELL)
    tiles = tiles.withColumn("cell", (F.col("cblock") * supers + F.floor(F.col("ablock") / CELL)).cast("int"))
    ask = F.struct("at", "w", "low", "high")
    asked = windows.groupBy(F.col("block").alias("ablock")).agg(F.collect_list(ask).alias("ask"))  # of one block's rows
    left = anchors.blocks.withColumnRenamed("block", "ablock").join(asked, "ablock").join(tiles, "ablock")
    right = rows.blocks.withColumnRenamed("block", "cblock").join(tiles.select("cell", "cblock").distinct(), "cblock")
    names = [c for c in NODE.replace(",", "").split() if c in ("leaf", "n", "ids", "labels", "vectors", "starts", "centers", "radii")]
    both = left.select("cell", F.col("ablock").alias("block"), *names, "ask").unionByName(right.select("cell", F.col("cblock").alias("block"), *names), allowMissingColumns=True)
    width = rows.width

    def score(table):
        held = table.to_pylist()
        mine = next(Block(r, width) for r in held if r["ask"] is None)
        out = [np.zeros((0, 5), np.int64)]
        for row in held:
            if row["ask"] is None:
                continue
            block = Block(row, width)
            ask = np.array([(x["at"], x["w"], x["low"], x["high"]) for x in row["ask"]], np.int64)
            low = np.full((len(block.x), int(ask[:, 1].max()) + 1), FREE)
            high = -low
            low[ask[:, 0], ask[:, 1]], high[ask[:, 0], ask[:, 1]] = ask[:, 2], ask[:, 3]
            scores, ids, _ = searched(block, mine, low, high, k, same)
            at, w, i = np.nonzero(scores > -FREE)
            out.append(np.stack([np.full(len(at), block.block), at, w, scores[at, w, i], ids[at, w, i]], 1))
        return _table(np.concatenate(out))

    return store.dealt(both, max(1, rows.total * supers), "cell").groupBy("cell").applyInArrow(score, FOUND)


def _table(rows: np.ndarray):
    import pyarrow as pa

    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    out = pa.Table.from_arrays([pa.array(c).cast(k) for c, k in zip(rows.T, kinds, strict=True)], names=["block", "at", "w", "score", "id"])
    trim()
    return out


def _first(found: DataFrame, k: int) -> DataFrame:
    """found with rank, up to k for each anchor and window; ties by smaller id."""
    order = Window.partitionBy("block", "at", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(anchors: Grown, rows: Grown, windows: DataFrame, k: int, *, same: bool) -> DataFrame:
    """FOUND and rank of the first k rows in each window (block, at, w, low, high) of each anchor."""
    spark = windows.sparkSession
    leaf = store.table(spark, [(int(b), i) for i in range(anchors.tree.leaves) for b in range(anchors.first[i], anchors.first[i] + anchors.count[i])], "block int, leaf int") if anchors.total <= LEAVES else anchors.blocks.select("block", "leaf")

    def pairs(asked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        needs = asked.join(F.broadcast(leaf) if anchors.total <= LEAVES else leaf, "block").groupBy("leaf").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        low, high = np.full(anchors.tree.leaves, float(FREE) * 4), np.full(anchors.tree.leaves, -float(FREE) * 4)
        for r in needs.collect():  # a row for each leaf at most
            low[r.leaf], high[r.leaf] = r.low, r.high
        return traverse(anchors.tree, rows.tree, low, high)

    def tiles(held: np.ndarray) -> DataFrame:
        some = [(int(anchors.first[a]), int(anchors.count[a]), int(rows.first[c]), int(rows.count[c])) for a, c in held]
        each = store.table(spark, some, "af int, an int, cf int, cn int")
        each = each.select("cf", "cn", F.explode(F.sequence(F.col("af"), F.col("af") + F.col("an") - 1)).alias("ablock"))
        return each.select("ablock", F.explode(F.sequence(F.col("cf"), F.col("cf") + F.col("cn") - 1)).alias("cblock"))

    held, bounds = pairs(windows)
    order = np.lexsort((-bounds, held[:, 0])) if len(held) else np.zeros(0, np.int64)
    best = held[order[np.unique(held[order, 0], return_index=True)[1]]] if len(held) else held
    head = {int(a): int(rows.first[c]) for a, c in best}
    start = tiles(best).groupBy("ablock").agg(F.min("cblock").alias("cblock"))
    found = store.written(_met(anchors, rows, start, windows, k, same), "first")
    last = found.transform(lambda d: _first(d, k)).where(F.col("rank") == k).select("block", "at", "w", "score")
    narrower = store.written(windows.join(last, ["block", "at", "w"], "left").select("block", "at", "w", F.greatest("low", F.coalesce("score", "low")).alias("low"), "high"), "windows")
    held, _ = pairs(narrower)
    seeds = store.table(spark, [(int(b), head[i]) for i in head for b in range(anchors.first[i], anchors.first[i] + anchors.count[i])], "ablock int, cblock int") if anchors.total <= LEAVES else start
    rest = tiles(held).join(seeds, ["ablock", "cblock"], "left_anti")
    return _first(found.unionByName(_met(anchors, rows, rest, narrower, k, same)), k)


def mine(vectors: DataFrame, anchor, *, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """vectors (vec_id, label, embedding) and a condition for anchors -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Of each anchor's first `positives` rows of its label, the first `negatives` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    rows = vectors.where("label IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    width = max(1, rows.agg(F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()[0])
    everyone = Grown(rows, width, BLOCK, GROUP)
    asking = Grown(rows.where(anchor & F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "label", "embedding"]), width, ANCHOR_BLOCK, ANCHOR_GROUP)
    each = asking.blocks.select("block", F.posexplode("ids").alias("at", "anchor_id"))
    free = each.select("block", "at", F.lit(0).alias("w"), F.lit(-FREE).alias("low"), F.lit(FREE).alias("high"))
    near = store.written(search(asking, everyone, free, positives, same=True).select("block", "at", F.col("rank").alias("w"), "score", "id"), "positives")
    floored = lambda c: F.expr(f"({c} * score - pmod({c} * score, 100)) div 100")
    windows = near.select("block", "at", "w", (-floored(-low)).alias("low"), floored(high).alias("high")).where("low <= high")
    far = search(asking, everyone, store.written(windows, "asked"), negatives, same=False)
    out = far.select("block", "at", "w", "rank", F.nullif("id", F.lit(store.LAST)).alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(near.select("block", "at", "w", F.nullif("id", F.lit(store.LAST)).alias("positive_id"), F.col("score").alias("positive_score")), ["block", "at", "w"])
    return out.join(each, ["block", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(vectors: DataFrame) -> DataFrame:
    rows = store.columns(vectors, "vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


SQL = f"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS s
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= {POSITIVES})
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank,
  n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND {LOW} * p.s <= 100 * n.s AND 100 * n.s <= {HIGH} * p.s
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) <= {NEGATIVES}
"""
