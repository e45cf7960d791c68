"""Quality rules whose cutoffs come from mergeable quantile sketches per language and source.

A sketch counts the values of a metric in buckets of relative width 1/64, those of zero apart, found by integer arithmetic,
so two sketches merge by adding counts and give the same quantiles in any order. The upper fence of a group of documents is
q75 + reach * (q75 - q25) of its own values over zero: it follows the group's spread and holds no constant of the metric's
scale. Few values say little, so a fence is the mean of the group's own, weighed by its number of values, and that of its
language, weighed by `prior`; a language leans on all documents in the same way. A source full of junk can't raise its
cutoff at will: no fence lies beyond that of the wider group with twice the reach. Nor can junk that makes up most of the
values over zero, where it stands apart: halfway between the median of all values, zeros among them, and one of the upper
quantiles TOPS there is a cut if at least LEAST documents, and eight times as many as lie in the third below the cut, lie
beyond it, if it is a tenth or more, and if the quantile is half again the median. No fence lies beyond the cut of its group
or, where that has fewer than `prior` documents, of its language or in the same way of all. So junk of up to half of all documents is found wherever its level is, while values that thin
out steadily have no cut. A document is rejected when a metric lies over
its fence, or when it fails the base rules.

Defined cases: a null text has no words and fails the base rules; null lang or source are groups of their own; rows that
repeat count each; metrics without a value over zero anywhere reject nothing; an empty table gives an empty result; texts
of any length are read whole; other columns are kept by `stage` whatever their names, and ignored by `query`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store
from .words import hashed, slices, windows

BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: Metrics as ratios of counts.
METRICS = {"symbol_rate": ("n_symbols", "word_chars"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
REACH, PRIOR = 3.0, 200
#: Quantiles (of 1000) that may lie in a cluster of junk, how many documents one has, and the least cut.
TOPS, LEAST, LOWEST = (999, 990, 970, 900, 750), 10, 0.1
#: Buckets count in units of one millionth; 64 buckets for each power of two.
UNIT, FINE = 1_000_000, 128
#: Groups whose fences may go to all tasks; with more, rejected rows are taken out by a join.
BROADCAST_GROUPS = 100_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: np.ndarray, width: int = 8) -> int:
    """Words in windows of `width` words that occur twice or more."""
    if len(words) <= width:
        return 0
    found = windows(words, width)
    order = np.sort(found)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    marks = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(found, twice))
    np.add.at(marks, at, 1)
    np.add.at(marks, at + width, -1)
    return int((np.cumsum(marks) > 0).sum())


def repeated_lines(lines: list[bytes]) -> int:
    """Lines with a word that equal an earlier line."""
    if len(set(lines)) == len(lines):
        return 0
    seen: set[bytes] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += bool(line.split())
        else:
            seen.add(line)
    return dup


def measure(texts: list[bytes]) -> np.ndarray:
    """COUNTS of each text, a row a text."""
    words, starts = hashed(texts)
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    for i, text in enumerate(texts):
        lines, n = text.split(b"\n"), int(starts[i + 1] - starts[i])
        blanks = len(text) - len(text.translate(None, BLANKS))
        chars = len(text) if text.isascii() else len(text.decode())
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        out[i] = n, chars - blanks, symbols, len(lines), repeated_lines(lines), repeated_words(words[starts[i] : starts[i + 1]])
    return out


def measured(docs: DataFrame) -> DataFrame:
    """docs (text and any other columns) with COUNTS in place of text."""
    rest = [c for c in docs.columns if c != "text"]
    schema = docs.select(*[f"`{c}`" for c in rest]).schema
    for name in COUNTS:
        schema = schema.add(name, "long")

    def scan(batches):
        import pyarrow as pa

        from .words import binary

        for batch in slices(batches):
            counts = measure([t or b"" for t in binary(batch.column("text"))]).T
            names = batch.schema.names
            kept = [batch.column(i) for i, c in enumerate(names) if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(np.ascontiguousarray(c)) for c in counts]], names=[*rest, *COUNTS])

    return docs.mapInArrow(scan, schema)


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def bucket(v: str):
    """The bucket of a whole number: its leading seven bits and how many follow."""
    return F.expr(f"cast(greatest(0, length(bin({v})) - 7) * {FINE} + shiftright({v}, greatest(0, length(bin({v})) - 7)) as int)")


def sketches(x: DataFrame) -> DataFrame:
    """COUNTS with lang and source -> (lang, source, metric, bucket, n): sketches of two tables merge by their sum."""
    values = [F.struct(F.lit(m).alias("metric"), F.expr(f"({a} * {UNIT}) div greatest({b}, 1)").alias("v")) for m, (a, b) in METRICS.items()]
    long = x.where(~base_failed()).select("lang", "source", F.explode(F.array(*values)).alias("x")).select("lang", "source", "x.*")
    return long.select("lang", "source", "metric", bucket("v").alias("bucket")).groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def value(b: str):
    """The middle of a bucket."""
    return (F.col(b) % FINE + 0.5) * F.pow(F.lit(2.0), F.expr(f"{b} div {FINE}")) / UNIT


def quartiles(found: DataFrame, *groups: str, tops: tuple[int, ...] = TOPS, least: int = LEAST) -> DataFrame:
    """(groups, metric, every, total, q25, q75, cut) from merged sketches; a quantile is the middle of its bucket.

    total and the quartiles are of the values over zero; cut is the least one, null where there is none.
    """
    merged = found.groupBy(*groups, "metric", "bucket").agg(F.sum("n").alias("n"))
    each = Window.partitionBy(*groups, "metric")
    merged = merged.withColumns({"upto": F.sum("n").over(each.orderBy("bucket")), "every": F.sum("n").over(each), "zeros": F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)).over(each), "v": value("bucket")})
    of_all = lambda k: F.min(F.when(1000 * F.col("upto") >= k * F.col("every"), F.col("v"))).over(each)
    merged = merged.withColumns({f"at{k}": of_all(k) for k in (500, *tops)})
    low, middle = F.col("bucket") > 0, F.col("at500")
    at = lambda k: F.min(F.when(low & (4 * (F.col("upto") - F.col("zeros")) >= k * (F.col("every") - F.col("zeros"))), F.col("v")))
    cut = {k: middle + 0.5 * (F.col(f"at{k}") - middle) for k in tops}
    beyond = lambda k: F.sum(F.when(F.col("v") > cut[k], F.col("n")).otherwise(0))
    below = lambda k: F.sum(F.when((F.col("v") <= cut[k]) & (F.col("v") > middle + (F.col(f"at{k}") - middle) / 3), F.col("n")).otherwise(0))
    apart = lambda k: F.first((cut[k] >= LOWEST) & (F.col(f"at{k}") >= 1.5 * middle))
    cuts = [F.when(apart(k) & (beyond(k) >= least) & (8 * below(k) <= beyond(k)), F.first(cut[k])) for k in tops]
    return merged.groupBy(*groups, "metric").agg(F.first("every").alias("every"), F.first(F.col("every") - F.col("zeros")).alias("total"), at(1).alias("q25"), at(3).alias("q75"), F.array_min(F.array_compact(F.array(*cuts))).alias("cut"))


def fences(found: DataFrame, *, reach: float = REACH, prior: int = PRIOR) -> DataFrame:
    """Upper fences (lang, source, then one column a metric) of all groups that a sketch knows."""

    def of(total: str, q25: str, q75: str, wide: str, wide25: str, wide75: str):
        """A group's own fence leaning on the wider group's, and not beyond that one's with twice the reach."""
        own = F.col(q75) + reach * (F.col(q75) - F.col(q25))
        most = F.col(wide75) + 2 * reach * (F.col(wide75) - F.col(wide25))
        return F.when(F.col(total) > 0, F.least((F.col(total) * own + prior * F.col(wide)) / (F.col(total) + prior), most)).otherwise(F.col(wide))

    named = lambda p, *groups: quartiles(found, *groups).withColumnsRenamed({"every": f"{p}_every", "total": f"{p}_n", "q25": f"{p}25", "q75": f"{p}75", "cut": f"{p}_cut"})
    every = named("all").where("all_n > 0").withColumn("all_fence", F.col("all75") + reach * (F.col("all75") - F.col("all25")))
    lang = named("lang", "lang").where("lang_n > 0").join(every, "metric")
    cut = lambda p, wide: F.when(F.col(f"{p}_every") >= prior, F.col(f"{p}_cut")).otherwise(F.least(f"{p}_cut", wide))
    lang = lang.withColumns({"lang_fence": of("lang_n", "lang25", "lang75", "all_fence", "all25", "all75"), "lang_cut": cut("lang", "all_cut")})
    # a group has a row for every metric, and a fence where its language has one
    fine = named("own", "lang", "source").withColumnsRenamed({"lang": "_lang", "source": "_source", "metric": "_metric"})
    both = fine.join(lang, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("metric") == F.col("_metric")), "left")
    fence = F.when(F.col("lang_fence").isNotNull(), F.least(of("own_n", "own25", "own75", "lang_fence", "lang25", "lang75"), cut("own", "lang_cut")))
    both = both.select(F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("_metric").alias("m"), fence.alias("fence"))
    return both.groupBy("lang", "source").agg(*[F.max(F.when(F.col("m") == m, F.col("fence"))).alias(f"max_{m}") for m in METRICS])


def judged(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source) -> COUNTS, base_failed, kept and `over`, the metrics over their fence, for each row."""
    x = store.written(store.few(measured(docs)), "measured")
    limits = fences(sketches(x)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    # groups are as many as pairs of language and source: left to the optimizer, which broadcasts only below its size limit
    y = x.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    over = [F.coalesce(F.col(a) / F.greatest(F.col(b), F.lit(1)) > F.col(f"max_{m}"), F.lit(False)) for m, (a, b) in METRICS.items()]
    failed = F.array_compact(F.array(*[F.when(o, F.lit(m)) for m, o in zip(METRICS, over, strict=True)]))
    y = y.withColumns({"over": failed, "base_failed": base_failed()})
    return y.withColumn("kept", ~F.col("base_failed") & (F.size("over") == 0))


def query(docs: DataFrame) -> DataFrame:
    return judged(store.columns(docs, "doc_id", "text", "lang", "source")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("over", ",").alias("over_fence"))


def keeps(counts: np.ndarray, groups: list[tuple], limits: dict[tuple, tuple]) -> np.ndarray:
    """Which rows of COUNTS pass the base rules and the fences of their groups."""
    at = {name: counts[:, i] for i, name in enumerate(COUNTS)}
    good = (at["n_words"] >= 20) & (100 * at["n_repeat_words"] <= 30 * at["n_words"])
    none = (None,) * len(METRICS)
    most = np.array([[np.inf if x is None else x for x in limits.get(g, none)] for g in groups], float).reshape(len(groups), len(METRICS))
    for i, (a, b) in enumerate(METRICS.values()):
        good &= ~(at[a] / np.maximum(at[b], 1) > most[:, i])
    return good


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, each row judged by itself.

    The texts are read twice and never shuffled: once for the sketches, once to be judged by the fences, which go to all
    tasks while they are few.
    """
    # the bound is tested on the rows that come, so no more than it allows ever reach the driver
    limits = fences(sketches(measured(store.columns(docs, "text", "lang", "source")))).limit(BROADCAST_GROUPS + 1).collect()
    if len(limits) > BROADCAST_GROUPS:
        keyed = docs.select("doc_id", "text", "lang", "source", store.text_hash(docs).alias("text_hash"))
        bad = judged(keyed).where("NOT kept").select("doc_id", "text_hash").distinct()
        return store.without(docs, store.written(store.few(bad), "rejected"))
    known = {(r["lang"], r["source"]): tuple(r[f"max_{m}"] for m in METRICS) for r in limits}
    held = spark.sparkContext.broadcast(known)

    def scan(batches):
        import pyarrow as pa

        from .words import binary

        for batch in slices(batches):
            groups = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            yield batch.filter(pa.array(keeps(measure([t or b"" for t in binary(batch.column("text"))]), groups, held.value)))

    return docs.mapInArrow(scan, docs.schema)



SQL = r"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, row_number() OVER () AS r,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
v AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
d AS (SELECT r, i FROM v QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
m AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM d) GROUP BY r),
c AS (SELECT w.r, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(m.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN m ON m.r = w.r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
x AS (SELECT r, lang, source, base_failed, unnest([{'m': 'symbol_rate', 'a': n_symbols, 'b': word_chars}, {'m': 'dup_line_rate', 'a': n_dup_lines, 'b': n_lines},
        {'m': 'repeat_rate', 'a': n_repeat_words, 'b': n_words}, {'m': 'word_length', 'a': word_chars, 'b': n_words}], recursive := true) FROM b),
y AS (SELECT lang, source, m, (a * 1000000) // greatest(b, 1) AS v FROM x WHERE NOT base_failed),
s AS (SELECT lang, source, m, greatest(0, length(bin(v)) - 7) * 128 + (v >> greatest(0, length(bin(v)) - 7)) AS k, count(*) AS n FROM y GROUP BY ALL),
g AS (SELECT 0 AS level, NULL AS lang, NULL AS source, m, k, sum(n) AS n FROM s GROUP BY m, k
      UNION ALL SELECT 1, lang, NULL, m, k, sum(n) FROM s GROUP BY lang, m, k UNION ALL SELECT 2, lang, source, m, k, n FROM s),
u AS (SELECT *, (k % 128 + 0.5::DOUBLE) * pow(2.0, k // 128) / 1000000 AS v, sum(n) OVER (PARTITION BY level, lang, source, m ORDER BY k) AS upto, sum(n) OVER (PARTITION BY level, lang, source, m) AS every,
        sum(CASE WHEN k = 0 THEN n ELSE 0 END) OVER (PARTITION BY level, lang, source, m) AS zeros FROM g),
q AS (SELECT level, lang, source, m, any_value(every) AS every, CAST(any_value(every) - any_value(zeros) AS DOUBLE) AS total, min(v) FILTER (WHERE k > 0 AND 4 * (upto - zeros) >= every - zeros) AS lo,
        min(v) FILTER (WHERE k > 0 AND 4 * (upto - zeros) >= 3 * (every - zeros)) AS hi, min(v) FILTER (WHERE 1000 * upto >= 500 * every) AS mid FROM u GROUP BY level, lang, source, m),
t AS (SELECT level, lang, source, m, p, min(v) FILTER (WHERE 1000 * upto >= p * every) AS top FROM u, (SELECT unnest([999, 990, 970, 900, 750]) AS p) ps GROUP BY level, lang, source, m, p),
j AS (SELECT q.level, q.lang, q.source, q.m, p, top, mid, mid + 0.5::DOUBLE * (top - mid) AS cut, mid + (top - mid) / 3 AS below FROM q JOIN t ON t.level = q.level AND t.m = q.m AND t.lang IS NOT DISTINCT FROM q.lang AND t.source IS NOT DISTINCT FROM q.source),
h AS (SELECT level, lang, source, m, min(cut) AS cut FROM (SELECT j.level, j.lang, j.source, j.m, j.p, any_value(j.cut) AS cut, any_value(j.cut >= 0.1::DOUBLE AND j.top >= 1.5::DOUBLE * j.mid) AS apart, coalesce(sum(n) FILTER (WHERE v > j.cut), 0) AS above, coalesce(sum(n) FILTER (WHERE v <= j.cut AND v > below), 0) AS under
        FROM j JOIN u ON u.level = j.level AND u.m = j.m AND u.lang IS NOT DISTINCT FROM j.lang AND u.source IS NOT DISTINCT FROM j.source GROUP BY ALL) WHERE apart AND above >= 10 AND 8 * under <= above GROUP BY level, lang, source, m),
z AS (SELECT q.*, h.cut FROM q LEFT JOIN h ON h.level = q.level AND h.m = q.m AND h.lang IS NOT DISTINCT FROM q.lang AND h.source IS NOT DISTINCT FROM q.source),
e AS (SELECT l.lang, l.m, l.lo, l.hi, least((l.total * (l.hi + 3.0::DOUBLE * (l.hi - l.lo)) + 200 * (a.hi + 3.0::DOUBLE * (a.hi - a.lo))) / (l.total + 200), a.hi + 6.0::DOUBLE * (a.hi - a.lo)) AS fence, CASE WHEN l.every >= 200 THEN l.cut ELSE least(l.cut, a.cut) END AS cut
      FROM z l JOIN z a ON a.level = 0 AND a.m = l.m WHERE l.level = 1 AND l.total > 0),
f AS (SELECT z.lang, z.source, e.m, least(CASE WHEN z.every >= 200 THEN z.cut ELSE least(z.cut, e.cut) END, CASE WHEN z.total = 0 THEN e.fence ELSE
        least((z.total * (z.hi + 3.0::DOUBLE * (z.hi - z.lo)) + 200 * e.fence) / (z.total + 200), e.hi + 6.0::DOUBLE * (e.hi - e.lo)) END) AS fence
      FROM z JOIN e ON e.lang IS NOT DISTINCT FROM z.lang AND z.m = e.m WHERE z.level = 2),
o AS (SELECT x.r, string_agg(x.m, ',' ORDER BY list_position(['symbol_rate', 'dup_line_rate', 'repeat_rate', 'word_length'], x.m)) AS over_fence
      FROM x JOIN f ON f.lang IS NOT DISTINCT FROM x.lang AND f.source IS NOT DISTINCT FROM x.source AND f.m = x.m
      WHERE CAST(x.a AS DOUBLE) / greatest(x.b, 1) > f.fence GROUP BY x.r)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND o.r IS NULL AS kept, coalesce(over_fence, '') AS over_fence
FROM b LEFT JOIN o ON o.r = b.r
"""
