"""Concepts: dense nearest reference, threshold, hard-negative gate, and the gloss that follows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinispark.functions import spans
from clinispark.functions import text as T
from clinispark.operators import metric_index
from clinispark.sources import backends
from clinispark.sources.tables import small

LEAST, MARGIN = 0.65, 0.05
#: Vectors that are multiplied at a time with a block.
SLICE = 256


def _best(x: np.ndarray, y: np.ndarray, rank: np.ndarray, out: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the row of y with the largest product, the smaller rank of equals, and the product; -1 and -inf for none.

    out: pairs of rows that don't meet; own: groups of both sides, of which only equal ones meet. Products of low precision only
    find who may be best; the similarity is then summed in the order of scores.dot, so equal vectors tie exactly.
    """
    size = lambda v: np.sqrt((v.astype(float) ** 2).sum(1))
    nx, ny = size(x), size(y)
    both = np.concatenate([nx, ny])
    kind = np.float32 if both.max() < 1e12 and both[both > 0].min(initial=1) > 1e-12 else np.float64
    slack = 4 * (x.shape[1] + 4) * float(np.finfo(kind).eps) * nx * ny.max()
    xs, ys = x.astype(kind), np.ascontiguousarray(y.astype(kind))
    best, at = np.full(len(x), -np.inf), np.full(len(x), -1)
    order = np.argsort(out[0], kind="stable")
    oi, oj = out[0][order], out[1][order]
    for i in range(0, len(x), SLICE):
        j0, j1 = np.searchsorted(oi, [i, i + SLICE])
        gi, gj = oi[j0:j1] - i, oj[j0:j1]
        mine = slice(i, i + SLICE)
        for j in range(0, len(y), metric_index.BLOCK):
            dots = xs[mine] @ ys[j : j + metric_index.BLOCK].T
            if len(gi):
                here = (gj >= j) & (gj < j + metric_index.BLOCK)
                dots[gi[here], gj[here] - j] = -np.inf
            if own is not None:
                dots[own[0][mine, None] != own[1][None, j : j + metric_index.BLOCK]] = -np.inf
            top = dots.max(axis=1)
            rows = np.flatnonzero((top > -np.inf) & (top >= best[mine] - slack[mine]))
            if not len(rows):
                continue
            least = np.maximum(top[rows], best[mine][rows]) - slack[mine][rows]
            r, c = np.nonzero((dots[rows] >= least[:, None]) & (dots[rows] > -np.inf))
            r, c = rows[r] + i, c + j
            exact = np.zeros(len(r))
            for k in range(x.shape[1]):
                exact += x[r, k].astype(float) * y[c, k].astype(float)
            first = np.lexsort((rank[c], -exact, r))
            first = first[np.unique(r[first], return_index=True)[1]]
            r, c, exact = r[first], c[first], exact[first]
            won = (exact > best[r]) | (exact == best[r]) & (rank[c] < rank[at[r]])
            best[r[won]], at[r[won]] = exact[won], c[won]
    return at, best


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _few(y: np.ndarray, group: np.ndarray, rank: np.ndarray, most: int) -> np.ndarray:
    """Rows of y without copies: of equal vectors in a group those of the `most` smallest ranks, the only ones that can win."""
    same = np.unique(np.ascontiguousarray(y).view(np.dtype((np.void, y.dtype.itemsize * y.shape[1]))).ravel(), return_inverse=True)[1] if y.shape[1] else np.zeros(len(y), int)
    order = np.lexsort((rank, group, same))
    again = (np.diff(same[order]) == 0) & (np.diff(group[order]) == 0) & (np.diff(rank[order]) == 0)
    order = order[np.concatenate([[True], ~again])]
    new = np.concatenate([[True], (same[order][1:] != same[order][:-1]) | (group[order][1:] != group[order][:-1])])
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return np.sort(order[np.arange(len(order)) - start < most])


def _equal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in a and b that hold the same."""
    order = np.argsort(b, kind="stable")
    lo, hi = (np.searchsorted(b[order], a, side=s) for s in ("left", "right"))
    n = hi - lo
    i = np.repeat(np.arange(len(a)), n)
    return i, order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]


def _products(left: DataFrame, right: DataFrame, key: str, out: str, apart: list[tuple[str, str]], same: str | None = None) -> DataFrame:
    """The best vector of `right` in each pair of shelves of cells that can hold it, for each row of `left`.

    Only vectors of one length meet; rows don't where a pair of columns of `apart` is equal, or, given `same`, where that column
    of both is not. A pair of shelves is a task's work of bounded memory; what is dealt out stays a fixed multiple of the vectors
    up to SHELVES * SHELF rows.
    """
    spark = left.sparkSession
    rights = [c for c in right.columns if c != "embedding"]
    kinds = ", ".join([f"{key} {left.schema[key].dataType.simpleString()}", *[f"{c} {right.schema[c].dataType.simpleString()}" for c in rights]])
    groups = 1
    if same:
        left, right = left.where(F.col(same).isNotNull()), right.where(F.col(same).isNotNull())
        groups = min(metric_index.BUCKETS, max(1, right.agg(F.approx_count_distinct(same)).first()[0]))
    pivots = metric_index.choose_pivots(right, max(1, metric_index.PIVOTS // groups))
    a, b = metric_index.Cells(left, pivots, same), metric_index.Cells(right, pivots, same)

    def met(pairs: list, single: bool = False) -> DataFrame:
        meets = np.zeros((len(a.cell), len(b.cell)), bool)
        if pairs:
            meets[tuple(np.array(pairs).T)] = True
        mine, others = a.shelves(single), b.shelves(single)
        x, y = metric_index.dealt(a, mine, b, others, meets, spark)
        cells = a.cell, b.cell

        def compare(p: pa.Table, q: pa.Table) -> pa.Table:
            (ci, wi), (cj, wj) = ((z["cell"].to_numpy(), pc.list_value_length(z["embedding"]).to_numpy()) for z in (p, q))
            ids = {c: q[c].to_numpy() for c in rights}
            rank = np.unique(ids[out], return_inverse=True)[1]
            parts = []
            for w in np.intersect1d(wi, wj):
                jw = np.flatnonzero(wj == w)
                y = _vectors(q["embedding"].take(jw))
                group = np.unique(ids[same][jw], return_inverse=True)[1] if same else np.zeros(len(jw), int)
                few = _few(y, group, rank[jw], 1 + len(apart))
                jw, y = jw[few], y[few]
                at = np.searchsorted(cells[1], cj[jw])
                for cell in np.unique(ci[wi == w]):
                    iw = np.flatnonzero((ci == cell) & (wi == w))
                    own = meets[np.searchsorted(cells[0], cell)][at]
                    if not own.any():
                        continue
                    jc, yc = (jw, y) if own.all() else (jw[own], y[own])
                    out_ = [_equal(p[l].to_numpy()[iw], ids[r][jc]) for l, r in apart]
                    out_ = tuple(np.concatenate([o[k] for o in out_]) if out_ else np.zeros(0, int) for k in (0, 1))
                    codes = None
                    if same:
                        kind, code = np.unique(np.concatenate([p[same].to_numpy()[iw], ids[same][jc]]), return_inverse=True)
                        codes = (code[: len(iw)], code[len(iw) :]) if len(kind) > 1 else None
                    best, s = _best(_vectors(p["embedding"].take(iw)), yc, rank[jc], out_, codes)
                    has = np.flatnonzero(best >= 0)
                    parts.append(pa.table({key: p[key].take(iw[has]), **{c: q[c].take(jc[best[has]]) for c in rights}, "similarity": s[has], "cell": np.full(len(has), cell, np.int32)}))
            return pa.concat_tables(parts) if parts else pa.table({key: p[key][:0], **{c: q[c][:0] for c in rights}, "similarity": np.zeros(0), "cell": np.zeros(0, np.int32)})

        return x.groupBy("i", "j").cogroup(y.groupBy("i", "j")).applyInArrow(compare, f"{kinds}, similarity double, cell int")

    top, middle = metric_index.bounds(a, b)
    if len(b.cell) < 4:  # too few cells to leave any out
        return met(metric_index.other_pairs(top, np.full(len(a.cell), -np.inf), [])).drop("cell")
    done = metric_index.first_pairs(middle)
    near = met(done, single=True).persist()  # a row a left vector; read here and with the second pass
    # of a cell some of whose vectors have found nothing yet, all pairs remain
    held = {r.cell: r.least for r in near.groupBy("cell", key).agg(F.max("similarity").alias("s")).groupBy("cell").agg(F.min("s").alias("least"), F.count("*").alias("n")).collect() if r.n == a.count[np.searchsorted(a.cell, r.cell)]}
    least = np.array([held.get(int(c), -np.inf) for c in a.cell])
    return near.unionByName(met(metric_index.other_pairs(top, least, done))).drop("cell")


def nearest(found: DataFrame, references: DataFrame, *, apart: bool = False) -> DataFrame:
    """found (span_id, embedding) x references (ref_idx, concept_idx, embedding) -> the best reference of each span.

    Exact; ties go to the smaller ref_idx. Both sides may be the same table: with `apart`, no vector is its own reference.
    """
    refs = references.select("ref_idx", "concept_idx", "embedding")
    pairs = _products(found.select("span_id", "embedding"), refs, "span_id", "ref_idx", [("span_id", "ref_idx")] * apart)
    best = F.max_by(F.struct("ref_idx", "concept_idx", "similarity"), F.struct("similarity", -F.col("ref_idx")))
    return pairs.groupBy("span_id").agg(best.alias("m")).select("span_id", "m.*")


def above(matched: DataFrame, least: float = LEAST) -> DataFrame:
    return matched.where(F.col("similarity") >= F.lit(least))


def gate(matched: DataFrame, found: DataFrame, negatives: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Matches whose best hard negative of their own concept lies more than margin below; negatives (concept_idx, embedding).

    With a column neg_idx, negatives come from the table of spans and references, and neither the span nor its match is one.
    """
    apart = "neg_idx" in negatives.columns
    matched = matched.persist()  # a row a span, read by each pass below
    neg = negatives.select("concept_idx", "neg_idx" if apart else F.lit(0).alias("neg_idx"), "embedding")
    left = matched.join(found, "span_id").select("span_id", "concept_idx", *["ref_idx"] * apart, "embedding")

    near = _products(left, neg, "span_id", "neg_idx", [("span_id", "neg_idx"), ("ref_idx", "neg_idx")] * apart, "concept_idx").groupBy("span_id").agg(F.max("similarity").alias("max_negative"))
    out = matched.join(near, "span_id", "left")
    return out.where(F.col("max_negative").isNull() | (F.col("max_negative") < F.col("similarity") - F.lit(margin)))


def lexicon_spans(turns: DataFrame, terms: DataFrame) -> DataFrame:
    """turns (recording_id, turn_idx, text) and terms (span, label, score) -> matches of each turn as an array."""
    each = turns.select("recording_id", "turn_idx", F.posexplode(spans.ngrams(T.words(F.col("text")))).alias("nth", "s")).select("recording_id", "turn_idx", "nth", "s.*")
    hit = F.struct("start_word", "end_word", "label", "score", "nth")
    return each.join(small(terms), "span").groupBy("recording_id", "turn_idx").agg(F.array_sort(F.collect_list(hit)).alias("matches"))


def gloss_turns(turns: DataFrame, matches: DataFrame) -> DataFrame:
    """turns with labels after the best spans; the others as they were."""
    joined = turns.join(matches, ["recording_id", "turn_idx"], "left")
    chosen = spans.best_score(F.coalesce("matches", F.array().cast(spans.MATCH)))
    return joined.withColumn("text", spans.gloss(F.col("text"), T.words(F.col("text")), chosen)).drop("matches")


#: Wordings that a concept has at most.
WORDINGS = 1 << 20


def reference_terms(concepts: DataFrame) -> DataFrame:
    """concepts (concept_idx, term, variants) -> (ref_idx, concept_idx, text): each term, then its variants, in order.

    Numbers ascend in that order, with gaps between concepts, so no row waits for another.
    """
    each = concepts.select("concept_idx", F.posexplode(F.concat(F.array("term"), F.coalesce("variants", F.array().cast("array<string>")))).alias("nth", "text"))
    return each.select((F.col("concept_idx").cast("long") * WORDINGS + F.col("nth")).alias("ref_idx"), "concept_idx", "text")


def embedding_matches(turns: DataFrame, concepts: DataFrame, embedder: Callable, *, least: float = LEAST, margin: float = MARGIN) -> DataFrame:
    """turns (recording_id, turn_idx, text) and a concept lexicon -> matches of each turn, as gloss_turns takes them.

    Each distinct span of one to three words is embedded once, matched with its nearest wording, and kept if it is close
    enough and further from all hard negatives of that concept.
    """
    keys = ["recording_id", "turn_idx"]
    each = turns.select(*keys, F.posexplode(spans.ngrams(T.words(F.col("text")))).alias("nth", "s")).select(*keys, "nth", "s.*")
    refs = reference_terms(concepts)
    negatives = concepts.select("concept_idx", F.explode("hard_negatives").alias("text"))
    wanted = refs.select("text").unionByName(negatives.select("text"))
    known = backends.embed(wanted, embedder)
    refs = refs.join(known, "text").select("ref_idx", "concept_idx", "embedding")
    negatives = negatives.join(known, "text").select("concept_idx", "embedding")
    found = backends.embed(each.select(F.col("span").alias("text")), embedder).withColumnRenamed("text", "span_id")
    near = gate(above(nearest(found, refs), least), found, negatives, margin)
    terms = small(concepts.select("concept_idx", F.col("term").alias("label")))
    labels = near.join(terms, "concept_idx").select(F.col("span_id").alias("span"), "label", F.col("similarity").alias("score"))
    hit = F.struct("start_word", "end_word", "label", "score", "nth")
    return each.join(labels, "span").groupBy(*keys).agg(F.array_sort(F.collect_list(hit)).alias("matches"))
