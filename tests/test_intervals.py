"""Interval joins against all pairs: lengths of many scales, ties, empty and broken intervals, hot bins, plans."""

import collections
import random

import pytest

from clinispark.operators import intervals

SCHEMA = "id int, room string, start long, end long"


def some(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at, size = rng.randint(-5000, 5000), rng.choice([0, 1, 2, 3, 7, 64, 65, 900, 20_000])
        rows.append((i, rng.choice(["a", "a", "b", None]), at, at + size))
    return rows + [(n, "a", None, 5), (n + 1, "a", 9, 3), (n + 2, "b", 0, None), rows[0], rows[0]]


def pairs(left, right, keyed=True):
    out = collections.Counter()
    for a in left:
        for b in right:
            if None in a[2:] or None in b[2:] or a[2] >= a[3] or b[2] >= b[3] or keyed and (a[1] != b[1] or a[1] is None):
                continue
            if (n := min(a[3], b[3]) - max(a[2], b[2])) > 0:
                out[a[0], b[0], n] += 1
    return out


@pytest.mark.parametrize("split", [5, 20_000])
def test_pairs_equal_all_pairs(spark, split):
    left, right = some(150, 1), some(170, 2)
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    for keys in (["room"], []):
        got = intervals.overlaps(a, b, keys, split=split)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert collections.Counter((r.left.id, r.right.id, r.overlap) for r in got.collect()) == pairs(left, right, bool(keys))
    assert intervals.overlaps(a, b.limit(0), ["room"]).count() == 0


def test_largest_overlap_and_ties(spark):
    left, right = [r for r in some(120, 3)[:-2]], [r for r in some(120, 4)[:-2]]
    by = {r[0]: r for r in right}
    best = {}
    for a, b, n in pairs(left, right):
        best[a] = min(best.get(a, (0, 0, 0)), (-n, by[b][2], b)) if a in best else (-n, by[b][2], b)
    got = intervals.largest(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["room"], ["id"], ["start", "id"]).collect()
    assert {r.left.id: r.right and (-r.overlap, r.right.start, r.right.id) for r in got} == {r[0]: best.get(r[0]) for r in left}


def test_words_get_their_speakers(spark):
    words = [(1, i, w, s, e) for i, (w, s, e) in enumerate([("how", 0.0, 0.4), ("are", 0.4, 0.7), ("you", 0.9, 1.3), ("fine", 1.25, 1.9), ("hm", 5.0, 5.2), ("thanks", 2.0, 2.5)])]
    words += [(2, 0, "alone", 0.0, 1.0)]
    segments = [(1, 0.0, 1.0, "A"), (1, 1.0, 3.0, "B"), (1, 0.0, 1.0, "C")]
    found = intervals.speakers_of_words(spark.createDataFrame(words, "recording_id int, word_idx int, word string, start double, end double"), spark.createDataFrame(segments, "recording_id int, start double, end double, speaker string"))
    assert {(r.recording_id, r.word): r.speaker for r in found.collect()} == {(1, "how"): "A", (1, "are"): "A", (1, "you"): "B", (1, "fine"): "B", (1, "hm"): None, (1, "thanks"): "B", (2, "alone"): None}
    turns = {(r.recording_id, r.turn_idx): (r.speaker, r.text) for r in intervals.spoken_turns(found).collect()}
    assert turns == {(1, 0): ("A", "how are"), (1, 1): ("B", "you fine hm thanks"), (2, 0): ("UNKNOWN", "alone")}


def test_largest_makes_no_pairs(spark):
    # everything overlaps everything: 1.44 million pairs, of which none may be made
    n = 1200
    rows = lambda seed: [(i, "a", i % 40, 5000 + random.Random(seed + i).randint(0, 300)) for i in range(n)]
    left, right = rows(1), rows(5000)
    assert sum(min(a[3], b[3]) > max(a[2], b[2]) for a in left for b in right) == n * n
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    want = {}
    for x in left:
        want[x[0]] = min((max(x[2], y[2]) - min(x[3], y[3]), y[2], y[0]) for y in right)
    for sizes in ({}, {"split": 100, "rows": 3}):
        for keys in (["room"], []):
            got = intervals.largest(a, b, keys, ["id"], ["start", "id"], **sizes)
            assert {r.left.id: (-r.overlap, r.right.start, r.right.id) for r in got.collect()} == want
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "FlatMapCoGroupsInArrow" in plan and "left_start" not in plan  # no rows of both sides' bins
    assert intervals.outermost(intervals._sides(b, [], "start", "end"), ["start", "id"], 100).count() < 100


def test_best_of_staggered_intervals():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        c, d = np.sort(rng.integers(0, 60, n)), np.cumsum(rng.integers(1, 6, n)) + 30
        c = np.minimum(c, d - 1)
        c = np.maximum.accumulate(c)
        c, d = c[c < d], d[c < d]
        a = rng.integers(-5, 120, 40)
        b = a + rng.integers(1, 70, 40)
        at, most = intervals.best_of(a, b, c, d)
        for i in range(40):
            share = np.minimum(b[i], d) - np.maximum(a[i], c)
            assert most[i] == max(0, share.max()) and (most[i] == 0 or at[i] == share.argmax())


@pytest.mark.parametrize("sizes", [{"split": 5, "rows": 4}, {"split": 40, "rows": 25}])
def test_largest_by_slices(spark, sizes):
    left, right = some(120, 3)[:-2], some(120, 4)[:-2]
    by = {r[0]: r for r in right}
    for keys in (["room"], []):
        best = {}
        for a, b, n in pairs(left, right, bool(keys)):
            best[a] = min(best.get(a, (0, 0, 0)), (-n, by[b][2], b))
        got = intervals.largest(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), keys, ["id"], ["start", "id"], **sizes).collect()
        assert {r.left.id: r.right and (-r.overlap, r.right.start, r.right.id) for r in got} == {r[0]: best.get(r[0]) for r in left}
