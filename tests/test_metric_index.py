"""Nearest vectors through cells: exact on any data, and most pairs of cells left out where vectors lie in clusters."""

import numpy as np
import pytest

from clinispark.operators import concepts, metric_index


def clustered(n, k=24, width=12, seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(k, width))
    centers /= np.linalg.norm(centers, axis=1)[:, None]
    return centers[rng.integers(k, size=n)] + 0.02 * rng.normal(size=(n, width))


def table(spark, x, extra=()):
    rows = [(i, i % 5, [float(v) for v in r]) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "ref_idx int, concept_idx int, embedding array<double>").repartition(3)


@pytest.mark.parametrize("block", [20, 2048])
def test_nearest_of_clusters_is_exact_and_skips(spark, monkeypatch, block):
    monkeypatch.setattr(metric_index, "BLOCK", block)
    monkeypatch.setattr(metric_index, "CELL", 10)
    x = clustered(400)
    x[50:60] = x[49]  # ties
    refs = table(spark, x, [(900, 1, None), (901, 1, [float("nan")] * 12), (902, 1, [1.0, 2.0]), (903, 2, [])])
    found = refs.withColumnRenamed("ref_idx", "span_id").drop("concept_idx")
    met = []
    inner = metric_index.other_pairs
    monkeypatch.setattr(metric_index, "other_pairs", lambda top, least, done: met.append((top, inner(top, least, done), done)) or met[-1][1])
    got = {r.span_id: (r.ref_idx, r.concept_idx) for r in concepts.nearest(found, refs, apart=True).collect()}
    dots = x @ x.T
    np.fill_diagonal(dots, -np.inf)
    want = {}
    for i, row in enumerate(dots):
        best = np.flatnonzero(row >= row.max() - 1e-12)
        want[i] = (int(best[0]), int(best[0] % 5))
    assert {k: v for k, v in got.items() if k < 400} == want and set(got) - set(want) <= {902, 903}
    top, rest, done = met[0]
    pairs = int((top > -np.inf).sum())
    assert len(rest) + len(done) < 0.5 * pairs  # most pairs of cells are never scored


def test_bounds_hold(spark, monkeypatch):
    monkeypatch.setattr(metric_index, "CELL", 10)
    x = np.random.default_rng(5).normal(size=(150, 6))
    refs = table(spark, x)
    pivots = metric_index.choose_pivots(refs, 9)
    a, b = metric_index.Cells(refs, pivots), metric_index.Cells(refs.where("ref_idx < 80"), pivots)
    top, _ = metric_index.bounds(a, b)
    left = {r.ref_idx: r.cell for r in a.rows.collect()}
    right = {r.ref_idx: r.cell for r in b.rows.collect()}
    at = lambda side, c: int(np.searchsorted(side.cell, c))
    assert all(x[i] @ x[j] <= top[at(a, c), at(b, d)] for i, c in left.items() for j, d in right.items())


def test_gate_through_cells(spark, monkeypatch):
    monkeypatch.setattr(metric_index, "CELL", 10)
    x = clustered(200, seed=9)
    v = table(spark, x).withColumnRenamed("ref_idx", "vec")
    found = v.selectExpr("vec AS span_id", "embedding")
    near = concepts.nearest(found, v.selectExpr("vec AS ref_idx", "concept_idx", "embedding"), apart=True)
    got = {r.span_id: round(r.max_negative, 9) for r in concepts.gate(near, found, v.selectExpr("concept_idx", "vec AS neg_idx", "embedding"), 0.0).collect()}
    dots = x @ x.T
    want = {}
    for i in range(200):
        row = np.where(np.arange(200) == i, -np.inf, dots[i])
        j = int(np.flatnonzero(row >= row.max() - 1e-12)[0])
        own = [k for k in range(200) if k % 5 == j % 5 and k not in (i, j)]
        if dots[i][own].max() < row[j]:
            want[i] = round(float(dots[i][own].max()), 9)
    assert got == want


def test_shelves_bound_what_a_task_holds(spark, monkeypatch):
    # more vectors than shelves hold, copies and equal products among them: tasks are many, their tables small
    monkeypatch.setattr(metric_index, "CELL", 20)
    monkeypatch.setattr(metric_index, "FEW", 16)
    monkeypatch.setattr(metric_index, "SHELF", 80)
    x = np.random.default_rng(8).integers(-2, 3, size=(240, 4)).astype(float)
    x[100:180] = x[7]
    v = table(spark, x)
    found = v.selectExpr("ref_idx AS span_id", "embedding")
    sides = []
    inner = metric_index.dealt
    monkeypatch.setattr(metric_index, "dealt", lambda *args: sides.append(inner(*args)) or sides[-1])
    near = concepts.nearest(found, v, apart=True)
    dots = x @ x.T
    np.fill_diagonal(dots, -np.inf)
    best = dots.argmax(1)
    assert {r.span_id: (r.ref_idx, r.similarity) for r in near.collect()} == {i: (int(j), dots[i, j]) for i, j in enumerate(best)}
    held = [r.n for pair in sides for s in pair for r in s.groupBy("i", "j").agg({"*": "count"}).toDF("i", "j", "n").collect()]
    assert max(held) <= 2 * 80 and len(held) > 20
    # negatives meet by their concept, not by a mask over all pairs
    sides.clear()
    got = {r.span_id: r.max_negative for r in concepts.gate(near, found, v.selectExpr("concept_idx", "ref_idx AS neg_idx", "embedding"), -1e9).collect()}
    want = {i: max(dots[i, k] for k in range(240) if k % 5 == j % 5 and k not in (i, j)) for i, j in enumerate(best)}
    assert got == want
    for p, q in sides:
        left, right = ({(r.i, r.j): {*r.c} for r in s.groupBy("i", "j").agg({"concept_idx": "collect_set"}).toDF("i", "j", "c").collect()} for s in (p, q))
        assert all(len(c) == 1 and left.get(at, c) == c for at, c in right.items())
