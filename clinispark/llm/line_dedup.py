"""Line dedup over levelled sorted runs of line hashes. Native: DataFrame functions only.

A run is a table of line keys (two 64-bit hashes), bucketed and sorted by them, one file a bucket. A batch of documents is
aggregated to its line keys once; these meet every run in a merge join for which the run is neither dealt nor sorted again.
What no run knows is the batch's own run, at level 0; `fanout` runs of a level are merged, two sorted tables at a time, into
one of the next. Runs never share a key, so a key is known by one run at most.

A line that a large share of the documents holds would bring all its occurrences to one task. Lines with more occurrences
than a task's fair share, fewer than there are shuffle partitions, are therefore broadcast, and only the others are joined
by a shuffle.

Defined cases: a null or empty text is one empty line; a null doc_id comes after all others; rows that repeat a doc_id
are one document, each row keeps its own text, and so are all rows without one: a line that only these hold stays in each; an empty table gives an empty result; columns beside doc_id and text stay as
they are, whatever their names; a document of any length is cut whole, and only hashes of its lines are shuffled for the
search.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]
#: Settings under which Spark takes the order of bucketed tables as it is.
ORDERED = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


def ascii_lower(x):
    """A-Z lower-cased, all else unchanged; the quick way where all characters are ASCII."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def line_key(line):
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def text_lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


@contextlib.contextmanager
def _set(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class LineRuns:
    """The runs of all batches so far, in the shared folder.

    Batches must come in ascending doc_id ranges for the smallest doc_id to win; otherwise the first batch does.
    """

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        #: One number of buckets for all runs: that of shuffle partitions, so that a batch's keys are dealt alike.
        self.buckets = store.partitions(spark)
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _save(self, df: DataFrame, name: str) -> str:
        table = f"lines_{name}_{uuid.uuid4().hex}"
        self.paths[table] = store.new_dir(self.spark, table)
        with _set(self.spark, ORDERED):
            df.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self.paths[table]).option("compression", "zstd").format("parquet").saveAsTable(table)
        return table

    def _drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        store.drop_dir(self.spark, self.paths.pop(table))

    def close(self) -> None:
        for table in list(self.paths):
            self._drop(table)

    def runs(self) -> list[DataFrame]:
        """(h1, h2, first_doc) of each run, newest last; a batch's table also holds keys that older runs knew."""
        return [self.spark.table(t).where("kept_in IS NULL").select(*KEY, "first_doc") for level in reversed(self.levels) for t in level]

    def _push(self, table: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def compact(self) -> None:
        """Merges full levels, from the lowest up; called before a batch comes, so a last batch isn't merged for nothing."""
        for level in range(len(self.levels) + 1):
            if level >= len(self.levels) or len(self.levels[level]) < self.fanout:
                continue
            old, self.levels[level] = self.levels[level], []
            tables = [self.spark.table(t).where("kept_in IS NULL").select(*KEY, "first_doc") for t in old]
            merged = tables[0]
            with _set(self.spark, ORDERED):
                for i, right in enumerate(tables[1:]):
                    right = right.withColumnRenamed("first_doc", f"f{i}").hint("merge")
                    merged = merged.join(right, KEY, "full").select(*KEY, F.coalesce("first_doc", f"f{i}").alias("first_doc"))
                self._push(self._save(merged.withColumn("kept_in", F.lit(None).cast("long")), f"level{level + 1}"), level + 1)
            for t in old:
                self._drop(t)

    def marked(self, occurrences: DataFrame) -> DataFrame:
        """(h1, h2, first_doc, last_doc, n, kept_in) of a batch's keys: kept_in is the document of an older run, if one knows the key."""
        keys = occurrences.groupBy(*KEY).agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.count("*").alias("n"))
        known = []
        for i, run in enumerate(self.runs()):
            known.append(f"kept_{i}")
            keys = keys.join(run.withColumnRenamed("first_doc", known[-1]).hint("merge"), KEY, "left")
        return keys.select(*KEY, "first_doc", "last_doc", "n", (F.coalesce(*known) if known else F.lit(None).cast("long")).alias("kept_in"))

    def add(self, occurrences: DataFrame) -> DataFrame:
        """(doc, row, pos, h1, h2) of a batch -> (doc, row, pos) of the lines to drop; the batch's new keys become a run."""
        self.compact()
        with _set(self.spark, ORDERED):
            table = self._save(self.marked(occurrences), "batch")
        keys = self.spark.table(table)
        total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        home = F.coalesce("kept_in", "first_doc")
        repeated = keys.where(F.col("last_doc") > home).select(*KEY, home.alias("home"), "n")
        # more than a share of all occurrences: at most as many keys as buckets
        often = F.col("n") * self.buckets > total
        hot = F.broadcast(repeated.where(often).drop("n"))
        at_once = occurrences.join(hot, KEY)
        rest = occurrences.join(hot, KEY, "left_anti").join(repeated.where(~often).drop("n"), KEY)
        dropped = store.written(at_once.unionByName(rest).where("doc > home").select("doc", "row", "pos"), "dropped", total)
        self._push(table, 0)
        return dropped


def dedup_lines(docs: DataFrame, *, min_length: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs (doc_id, text, ...) -> (held, kept_text, n_lines, n_dropped): held is the whole row as it came, as a struct.

    docs is split into `batches` ascending doc_id ranges, each put through the runs.
    """
    spark = docs.sparkSession
    doc, row = F.coalesce(F.col("doc_id"), F.lit(store.LAST)), store.text_hash(docs)
    lines = (
        docs.select(doc.alias("doc"), row.alias("row"), F.posexplode(text_lines(F.col("text"))).alias("pos", "line"))
        .select("doc", "row", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_length)
        .select("doc", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    edges = docs.select(F.percentile_approx(doc, [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    batch = sum([(F.col("doc") > F.lit(e)).cast("int") for e in edges or []], F.lit(0))
    path, each = store.new_dir(spark, "lines"), store.parts(store.partitions(spark), 8)
    # a task writes lines of one batch
    lines = lines.withColumn("batch", batch).repartitionById(each * batches, F.col("batch") * each + F.pmod(F.col("row"), F.lit(each)).cast("int"))
    lines.write.option("compression", "zstd").partitionBy("batch").parquet(path)
    found = spark.read.schema("doc long, row long, pos int, h1 long, h2 long, batch int").parquet(path)
    runs, dropped = LineRuns(spark, fanout), None
    for i in range(len(edges or []) + 1):
        part = runs.add(found.where(F.col("batch") == i).drop("batch"))
        dropped = part if dropped is None else dropped.unionByName(part)
    runs.close()
    store.drop_dir(spark, path)
    by_row = dropped.groupBy("doc", "row").agg(F.collect_set("pos").alias("gone"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"), doc.alias("_doc"), row.alias("_row"))
    held = held.join(by_row, [F.col("_doc") == F.col("doc"), F.col("_row") == F.col("row")], "left").withColumn("lines", text_lines(F.col("held.text")))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")), lambda i: F.col("lines")[i])
    return held.select(
        "held",
        F.when(F.col("gone").isNull(), F.coalesce("held.text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def query(docs: DataFrame) -> DataFrame:
    return dedup_lines(store.columns(docs, "doc_id", "text")).select(
        F.col("held.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their repeated lines gone; one that lost lines and has no word left goes too.

    All columns stay as they are but text, and n_chars where there is one, which becomes the length of the new text.
    """
    out = dedup_lines(docs).where((F.col("n_dropped") == 0) | (F.btrim(F.col("kept_text"), F.lit(BLANK)) != ""))
    new = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
    kept = lambda c: F.col("held").getField(c)
    return out.select(*[(F.when(F.col("n_dropped") == 0, kept(c)).otherwise(new[c]) if c in new else kept(c)).alias(c) for c in docs.columns])


SQL = r"""
WITH l AS (
  SELECT rowid_ AS r, doc_id, u.pos, u.line,
         translate(trim(u.line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(d.ls) AS line, generate_subscripts(d.ls, 1) AS pos) u
), f AS (SELECT k, min(coalesce(doc_id, 9223372036854775807)) AS first_doc FROM l WHERE length(k) >= 10 GROUP BY k),
m AS (SELECT l.*, coalesce(f.first_doc < coalesce(l.doc_id, 9223372036854775807), false) AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
