"""Interval joins: which intervals of two tables overlap, and for each of one table the one of the other it overlaps most.

An interval lies in at most two bins of its own level, whose bins are as wide as the power of two that holds its length. Of
two intervals the longer one's level decides where they meet, so each interval is put into the bins of its own level and of
the coarser ones that the other table has: two bins a level, whatever its length. Pairs come from an equality on key, level
and bin, and count in the first bin that both lie in. A bin that holds more than SPLIT intervals of the left table is dealt
to several tasks, to each of which its right intervals go.

The largest overlap needs no pairs: of the right table only intervals that no other contains can win, these ascend by start
and by end, and each left interval finds its best one among them by binary search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from clinispark.sources.tables import small

#: Left intervals of a bin that one task meets at once.
SPLIT = 20_000
#: Right intervals that largest() takes as one slice of time.
SLICE = 100_000


def level(start: Column, end: Column) -> Column:
    """The level whose bins are at least as wide as the interval: 2 ** level >= end - start."""
    return F.length(F.conv((end - start - 1).cast("string"), 10, 2)) * (end - start > 1).cast("int")


def _levels(df: DataFrame) -> list[int]:
    """The levels that occur; 64 at most."""
    return sorted(r[0] for r in df.select(level(F.col("start"), F.col("end")).alias("level")).distinct().collect())


def _binned(df: DataFrame, levels: list[int], side: str) -> DataFrame:
    """df (key, start, end, held) once for each bin: level, bin, own, first."""
    own = level(F.col("start"), F.col("end"))
    at = F.explode(F.filter(F.array_distinct(F.concat(F.array(own), F.array(*[F.lit(x) for x in levels]).cast("array<int>"))), lambda x: x >= own))
    each = df.select("*", own.alias("_own"), at.alias("level"))
    first, last = F.expr("shiftright(start, level)"), F.expr("shiftright(end - 1, level)")
    each = each.withColumn("first", first).withColumn("bin", F.explode(F.sequence(first, last)))
    return each.select("key", "level", "bin", (F.col("level") == F.col("_own")).alias(f"{side}_own"), F.col("first").alias(f"{side}_first"), F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), F.col("held").alias(side))


def _sides(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """df as (key, start, end, held); empty intervals and those with a null bound or key stay out."""
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("k0"))
    known = df.where(F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))) if keys else df
    out = known.select(key.alias("key"), F.col(start).cast("long").alias("start"), F.col(end).cast("long").alias("end"), F.struct("*").alias("held"))
    return out.where("start < end")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], *, start: str = "start", end: str = "end", split: int = SPLIT) -> DataFrame:
    """(left, right, overlap): all pairs of rows with equal keys whose intervals [start, end) share a point, and how much.

    Bounds are whole numbers. Rows that repeat make pairs of their own.
    """
    a, b = _sides(left, keys, start, end), _sides(right, keys, start, end)
    levels_a, levels_b = _levels(a), _levels(b)
    x, y = _binned(a, levels_b, "left"), _binned(b, levels_a, "right")
    bins = ["key", "level", "bin"]
    hot = x.groupBy(*bins).count().where(F.col("count") > split).select(*bins, F.ceil(F.col("count") / split).cast("int").alias("n"))
    hot = small(hot)  # at most one for each `split` rows
    x = x.join(hot, bins, "left").withColumn("part", F.when(F.col("n") > 1, F.pmod(F.xxhash64("left"), F.col("n")).cast("int")).otherwise(0)).drop("n")
    y = y.join(hot, bins, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("n"), F.lit(1)) - 1))).drop("n")
    share = F.least("left_end", "right_end") - F.greatest("left_start", "right_start")
    met = x.join(y, [*bins, "part"]).where((F.col("left_own") | F.col("right_own")) & (F.col("bin") == F.greatest("left_first", "right_first")))
    return met.withColumn("overlap", share).where("overlap > 0").select("left", "right", "overlap")


def _slice_of(bounds: list[int]):
    """Number of the slice of time that holds a moment."""
    edges = np.array(bounds, np.int64)
    return F.pandas_udf(lambda at: pd.Series(np.searchsorted(edges, at.to_numpy(np.int64), side="right").astype("int32")), "int")


def _cuts(df: DataFrame, rows: int) -> list[int]:
    """Moments between which about `rows` intervals of df start; none if there are no more."""
    n = df.count()
    k = -(-n // rows)
    if k < 2:
        return []
    return sorted(set(df.agg(F.percentile_approx("start", [i / k for i in range(1, k)], 10 * k)).first()[0]))


def outermost(df: DataFrame, order: list[str], rows: int = SLICE) -> DataFrame:
    """Those of df (key, start, end, held) that no interval of an equal key and a smaller (start, order) contains.

    A contained one never overlaps anything more than the one around it, and loses the tie, so for largest() it can go. What is
    left ascends by start and by end. Each slice of time finds its own, then looks at the farthest end of those before it.
    """
    ties = F.struct(*[F.col(f"held.{c}").alias(f"t{i}") for i, c in enumerate(order)])
    one = df.groupBy("key", "start", "end").agg(F.min_by("held", ties).alias("held"))
    cuts = _cuts(df, rows)
    one = one.withColumn("slice", _slice_of(cuts)("start") if cuts else F.lit(0))
    before = Window.partitionBy("key", "slice").orderBy("start", ties).rowsBetween(Window.unboundedPreceding, -1)
    kept = one.withColumn("_before", F.max("end").over(before)).where("_before IS NULL OR end > _before").drop("_before")
    if cuts:
        w = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        reach = kept.groupBy("key", "slice").agg(F.max("end").alias("e")).withColumn("_reach", F.max("e").over(w)).drop("e")
        kept = kept.join(reach, ["key", "slice"]).where("_reach IS NULL OR end > _reach").drop("_reach")
    return kept.drop("slice")


def _codes(left: pa.ChunkedArray, right: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for equal keys of both sides."""
    out = np.zeros(len(left) + len(right), np.int64)
    for a, b in zip(left.combine_chunks().flatten(), right.combine_chunks().flatten(), strict=True):
        one = pa.concat_arrays([a, b]).dictionary_encode().indices.to_numpy()
        out = np.unique(np.stack([out, one.astype(np.int64)]), axis=1, return_inverse=True)[1].ravel()
    return out[: len(left)], out[len(left) :]


def best_of(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each [a, b) the first of [c, d) that it overlaps most, and how much (0 or less: none).

    c and d ascend, d strictly, and one is there at least. The best is the first that ends at b or later, the last that starts
    at a or earlier, or the longest between these two.
    """
    n = len(c)
    first, last = np.searchsorted(d, b, side="left"), np.searchsorted(c, a, side="right") - 1
    share = lambda i: np.where((i >= 0) & (i < n), np.minimum(b, d[i.clip(0, n - 1)]) - np.maximum(a, c[i.clip(0, n - 1)]), 0)
    # longest of each run of 2 ** k: the first of equals
    runs, k = [np.arange(n)], 1
    size = d - c
    while 2 * k <= n:
        x, y = runs[-1][: n - 2 * k + 1], runs[-1][k : n - k + 1]
        runs.append(np.where(size[y] > size[x], y, x))
        k *= 2
    at, most = np.full(len(a), n), np.zeros(len(a), np.int64)

    def offer(i):
        o = share(i)
        better = (o > most) | (o == most) & (o > 0) & (i < at)
        at[better], most[better] = i[better], o[better]

    offer(last)
    lo, hi = np.maximum(last + 1, 0), np.minimum(first, n)
    wide = hi - lo
    for k, run in enumerate(runs):
        own = np.flatnonzero((wide >= 1 << k) & (wide < 2 << k))
        if len(own):
            for i in (run[lo[own]], run[hi[own] - (1 << k)]):
                full = np.full(len(a), -1)
                full[own] = i
                offer(full)
    offer(first)
    return at, most


def largest(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], order: list[str], *, start: str = "start", end: str = "end", split: int = SPLIT, rows: int = SLICE) -> DataFrame:
    """(left, right, overlap): each row of left with the row of right it overlaps most, nulls where there is none.

    by names the columns that tell left rows apart; ties go to the earlier of right, then to the smaller `order`. No pairs are
    made: the outermost rows of right ascend by both bounds, so each left row looks its best one up. Both go by slices of time
    that hold about `rows` of those; a slice of more than `split` left rows is dealt to several tasks.
    """
    a, b = _sides(left, keys, start, end), outermost(_sides(right, keys, start, end), order, rows)
    cuts = _cuts(b, rows)
    bucket = F.pmod(F.xxhash64("key"), F.lit(len(cuts) + 1 if keys else 1)).cast("int")
    names = [f"_{i}" for i in range(len(by))]

    def dealt(df):
        at = F.explode(F.sequence(_slice_of(cuts)("start"), _slice_of(cuts)(F.col("end") - 1))) if cuts else F.lit(0)
        return df.withColumn("bucket", bucket).withColumn("slice", at)

    x = dealt(a.select("key", "start", "end", *[F.col(f"held.{c}").alias(n) for c, n in zip(by, names, strict=True)]))
    y = dealt(b)
    groups = ["bucket", "slice"]
    hot = x.groupBy(*groups).count().select(*groups, F.ceil(F.col("count") / split).cast("int").alias("n"))
    x = x.join(small(hot), groups).withColumn("part", F.pmod(F.xxhash64("start", "end", *names), F.col("n")).cast("int")).drop("n")
    y = y.join(small(hot), groups).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")

    def meet(p: pa.Table, q: pa.Table) -> pa.Table:
        k, l = _codes(p["key"], q["key"])
        (s, e), (t, f) = ([z[c].to_numpy() for c in ("start", "end")] for z in (p, q))
        mine, theirs = np.argsort(k, kind="stable"), np.lexsort((f, t, l))
        at, most = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        for one in np.intersect1d(k, l):
            i = mine[slice(*np.searchsorted(k[mine], [one, one + 1]))]
            j = theirs[slice(*np.searchsorted(l[theirs], [one, one + 1]))]
            r, most[i] = best_of(s[i], e[i], t[j], f[j])
            at[i] = j[r.clip(0, len(j) - 1)]
        has = np.flatnonzero(most > 0)
        return pa.table({**{n: p[n].take(has) for n in names}, "right": q["held"].take(at[has]), "overlap": most[has]})

    kinds = T.StructType([*[T.StructField(n, left.schema[c].dataType) for c, n in zip(by, names, strict=True)], T.StructField("right", b.schema["held"].dataType), T.StructField("overlap", T.LongType())])
    groups.append("part")
    met = x.groupBy(*groups).cogroup(y.groupBy(*groups)).applyInArrow(meet, kinds)
    rank = F.struct((-F.col("overlap")).alias("o"), F.col(f"right.{start}").cast("long").alias("s"), *[F.col(f"right.{c}").alias(f"t{i}") for i, c in enumerate(order)])
    best = met.groupBy(*names).agg(F.min_by(F.struct("right", "overlap"), rank).alias("best"))
    whole = left.select(F.struct("*").alias("left"))
    same = [F.col(f"left.{c}") == F.col(n) for c, n in zip(by, names, strict=True)]
    return whole.join(best, same, "left").select("left", F.col("best.right").alias("right"), F.col("best.overlap").alias("overlap"))


def speakers_of_words(words: DataFrame, segments: DataFrame) -> DataFrame:
    """words (recording_id, word_idx, word, start, end) of a whole recording, with the speaker whose segment each overlaps most.

    segments (recording_id, start, end, speaker). Seconds become milliseconds. Ties go to the earlier segment, then by
    speaker; a word that meets none has no speaker.
    """
    ms = lambda df: df.withColumns({"_start": F.round(F.col("start") * 1000).cast("long"), "_end": F.round(F.col("end") * 1000).cast("long")})
    found = largest(ms(words), ms(segments), ["recording_id"], ["recording_id", "word_idx"], ["start", "speaker"], start="_start", end="_end")
    return found.select(*[F.col(f"left.{c}").alias(c) for c in words.columns], F.col("right.speaker").alias("speaker"))


def spoken_turns(words: DataFrame) -> DataFrame:
    """words with their speakers -> turns (recording_id, turn_idx, speaker, text, start, end): runs of words of one speaker.

    Words without a speaker belong to the run before them.
    """
    w = Window.partitionBy("recording_id").orderBy("word_idx")
    known = words.withColumn("speaker", F.coalesce(F.last("speaker", ignorenulls=True).over(w), F.lit("UNKNOWN")))
    new = (F.col("speaker") != F.lag("speaker").over(w)).cast("int")
    runs = known.withColumn("turn_idx", F.sum(F.coalesce(new, F.lit(0))).over(w).cast("int"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), " ")
    return runs.groupBy("recording_id", "turn_idx").agg(F.first("speaker").alias("speaker"), said.alias("text"), F.min("start").alias("start"), F.max("end").alias("end"))


def sessions(events: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """events -> (key, session, start, end, n): runs of a key's events no more than `gap` apart; at and gap in whole numbers."""
    w = Window.partitionBy(key).orderBy(at)
    new = F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(False)).cast("int")
    return events.withColumn("session", F.sum(new).over(w).cast("int")).groupBy(key, "session").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))
