"""Vector code compression: product codes whose codebooks are kept by deltas.

Vectors become integers, packed in blocks and written once, bucketed by block. Every round writes a small table, bucketed
alike, of each block's assignments, so the next round meets its vectors and its former assignments in a merge join that
deals nothing. Of each block only the plus and minus contributions of parts that changed their entry leave the task, summed
over the block; the driver adds them to running integer sums and counts, which are as large as the codebooks. All
arithmetic is on integers, so sums kept by deltas equal sums made anew.

Defined cases: a vector that is null or holds null or non-finite components has no row in the result; null and repeated
vec_ids are rows like others, the null ones last where the smallest count, ties by the vector's components; vectors shorter
than the longest count as padded with zeros, and the width as padded to a multiple of the parts; an empty vector is all zeros;
components too large for exact 64-bit sums (beyond 2 ** 28 after scaling, with parts of 8) count as that bound; with fewer
kept rows than entries, codebooks have so few entries; null labels are one label; an empty table gives an empty result; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import store
from .exchange import pack, unpack
from .line_dedup import ORDERED, _set
from .vectors import BLOCK, exact, integers, limit_of, padded

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Bytes of vectors in a bucket at least, and in one that a large table has.
LEAST_BUCKET, BUCKET = 1 << 20, 256 << 20
#: Labels whose sums may be broadcast.
BROADCAST_LABELS = 100_000
DELTA = "array<struct<part: int, entry: int, n: bigint, sums: array<bigint>>>"


class Tables:
    """Tables bucketed by block in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.paths = spark, buckets, {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        table = f"codes_{name}_{uuid.uuid4().hex}"
        self.paths[table] = store.new_dir(self.spark, table)
        df.write.bucketBy(self.buckets, "block").sortBy("block").option("path", self.paths[table]).option("compression", "zstd").format("parquet").saveAsTable(table)
        return self.spark.table(table)

    def drop(self, *but: str) -> None:
        """Removes all tables but those of the given names."""
        for table in [t for t in self.paths if not t.startswith(tuple(f"codes_{n}_" for n in but))]:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            store.drop_dir(self.spark, self.paths.pop(table))


def packed(rows: DataFrame, scale: int) -> DataFrame:
    """rows (vec_id, label, embedding) -> blocks of whole vectors: vec_id and label arrays, width, n, vectors."""
    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = f"vec_id array<{kind('vec_id')}>, label array<{kind('label')}>, width int, n int, vectors binary"

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                good, ints = integers(part.column("embedding"), scale)
                if not len(ints):
                    continue
                part = part.filter(pa.array(good))
                held = [pa.ListArray.from_arrays(pa.array([0, len(ints)], pa.int32()), part.column(c)) for c in ("vec_id", "label")]
                rest = [pa.array([ints.shape[1]], pa.int32()), pa.array([len(ints)], pa.int32()), pa.array([pack(ints.reshape(-1))], pa.binary())]
                yield pa.RecordBatch.from_arrays([*held, *rest], names=["vec_id", "label", "width", "n", "vectors"])

    return rows.mapInArrow(scan, schema)


def opened(blob: bytes, n: int, width: int) -> np.ndarray:
    return unpack(blob, np.int32).reshape(n, width) if width else np.zeros((n, 0), np.int32)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each integer row, the nearest entry, ties to the lower one, and the squared distance; exact."""
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if exact(x.shape[1], 2 * most):
        a, b = x.astype(float), book.astype(float)
        far = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
    else:
        far = np.stack([((x - e) ** 2).sum(1) for e in book], 1)
    at = far.argmin(1)
    return at.astype(np.uint8), far[np.arange(len(x)), at].astype(np.int64)


def deltas(x: np.ndarray, part: int, new: np.ndarray, old: np.ndarray | None, entries: int) -> list[dict]:
    """What the rows of one part that changed their entry add to and take from the sums of entries."""
    moved = np.flatnonzero(new != old) if old is not None else np.arange(len(new))
    sums, counts = np.zeros((entries, x.shape[1]), np.int64), np.zeros(entries, np.int64)
    for codes, sign in ((new, 1), (old, -1)) if old is not None else ((new, 1),):
        np.add.at(sums, codes[moved], sign * x[moved])
        np.add.at(counts, codes[moved], sign)
    return [{"part": part, "entry": int(e), "n": int(counts[e]), "sums": sums[e].tolist()} for e in np.flatnonzero(counts | sums.any(1))]


class Codebooks:
    """Entries of each part, with the integer sums and counts of what is assigned to them."""

    def __init__(self, seeds: np.ndarray, parts: int):
        self.entries = np.ascontiguousarray(seeds.reshape(len(seeds), parts, seeds.shape[1] // parts).transpose(1, 0, 2))
        self.sums = self.entries.astype(object) * 0
        self.counts = np.zeros(self.entries.shape[:2], object)
        self.changed = np.ones(parts, bool)

    def take(self, found: list) -> None:
        """Adds contributions (part, entry, pos, n, sum) and moves each entry to its mean, rounded down."""
        for part, entry, pos, n, total in found:
            self.sums[part, entry, pos] += int(total)
            if pos == 0:
                self.counts[part, entry] += int(n)
        before = self.entries.copy()
        for part, entry in zip(*np.nonzero(self.counts), strict=True):
            self.entries[part, entry] = [s // self.counts[part, entry] for s in self.sums[part, entry]]
        self.changed = (self.entries != before).any((1, 2))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def assign(blocks: DataFrame, book: Codebooks, width: int, limit: int, *, last: bool = False) -> DataFrame:
    """blocks with their former codes (null at first) -> block, codes, deltas; or, at last, the rows' codes and errors.

    A part whose codebook did not change keeps its assignments without looking.
    """
    entries, changed = book.entries, book.changed.copy()
    parts, k, each = entries.shape
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code array<string>, error array<bigint>" if last else f"block bigint, codes binary, deltas {DELTA}"

    out = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for i, row in enumerate(batch.select(["block", "n", "width", "vectors", "codes"]).to_pylist()):
                x = padded(opened(row["vectors"], row["n"], row["width"]), width, limit).reshape(row["n"], parts, each)
                old = None if row["codes"] is None else unpack(row["codes"], np.uint8).reshape(row["n"], parts)
                codes, error, moved = np.zeros((row["n"], parts), np.uint8), np.zeros(row["n"], np.int64), []
                for p in range(parts):
                    part = np.ascontiguousarray(x[:, p])
                    if last or old is None or changed[p]:
                        codes[:, p], far = nearest(part, entries[p])
                        error += far
                        if not last:
                            moved += deltas(part, p, codes[:, p], None if old is None else old[:, p], k)
                    else:
                        codes[:, p] = old[:, p]
                if last:
                    text = [c.tobytes().hex() for c in codes]
                    held = [batch.column(c).slice(i, 1) for c in ("vec_id", "label")]
                    found = [pa.array([v], out.field(c).type) for c, v in (("code", text), ("error", error.tolist()))]
                    yield pa.RecordBatch.from_arrays([*held, *found], names=out.names)
                else:
                    yield pa.RecordBatch.from_pylist([{"block": row["block"], "codes": pack(codes.reshape(-1)), "deltas": moved}], schema=out)

    return blocks.mapInArrow(work, schema)


def _seeds(base: DataFrame, entries: int, width: int, limit: int) -> np.ndarray:
    """The vectors of the smallest vec_ids, `entries` of them at most."""
    kind = base.schema["vec_id"].dataType.elementType.simpleString()

    def first(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for i, row in enumerate(batch.select(["n", "width", "vectors"]).to_pylist()):
                ids = batch.column("vec_id").slice(i, 1).flatten()
                x = padded(opened(row["vectors"], row["n"], row["width"]), width, limit)
                order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
                # all that tie with the last one taken come too, but each vector as often as it can count
                rank = pc.rank(ids, tiebreaker="min", null_placement="at_end").to_numpy()
                some = order[rank[order] <= entries]
                some = some[np.lexsort((*x[some].T[::-1], rank[some]))][:entries]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(x[some].tolist(), pa.list_(pa.int64()))], names=["vec_id", "x"])

    found = base.select("vec_id", "n", "width", "vectors").mapInArrow(first, f"vec_id {kind}, x array<bigint>")
    rows = found.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), width)


def compress(vectors: DataFrame, *, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """vectors (vec_id, embedding, label) -> (vec_id, label, code, error) of the whole ones, and the final codebooks."""
    spark = vectors.sparkSession
    rows = store.columns(vectors, "vec_id", "label", "embedding")
    values = rows.agg(F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0))).first()[0]
    buckets = max(store.parts(4 * values, BUCKET), min(store.partitions(spark), store.parts(4 * values, LEAST_BUCKET)))
    tables = Tables(spark, buckets)
    base = tables.save(packed(rows, scale).withColumn("block", F.monotonically_increasing_id()).repartition(buckets, "block"), "base")
    width = -(-(base.agg(F.max("width")).first()[0] or 1) // parts) * parts
    limit = limit_of(width // parts, 2)
    book = Codebooks(_seeds(base, entries, width, limit), parts)
    codes = None
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    with _set(spark, ORDERED):
        for i in range(rounds if len(book.entries[0]) else 0):
            codes = tables.save(assign(met(base, codes), book, width, limit), f"round{i}")
            each = codes.select(F.explode("deltas").alias("d")).select("d.part", "d.entry", "d.n", F.posexplode("d.sums").alias("pos", "s"))
            book.take(each.groupBy("part", "entry", "pos").agg(whole("n"), whole("s")).collect())
            tables.drop("base", f"round{i}")
        coded = store.written(assign(met(base, codes), book, width, limit, last=True), "coded")
    tables.drop()
    return coded.select(F.inline(F.arrays_zip("vec_id", "label", "code", "error"))), book


def met(base: DataFrame, codes: DataFrame | None) -> DataFrame:
    """Blocks with their former codes; under ORDERED both tables are read as they lie."""
    if codes is None:
        return base.withColumn("codes", F.lit(None).cast("binary"))
    return base.join(codes.select("block", "codes").hint("merge"), "block")


def by_label(rows: DataFrame) -> DataFrame:
    """rows with label_error: the errors of equal labels, nulls together, summed.

    The sums are broadcast while there are few labels. Beyond that, labels with more rows than a task's fair share are, which
    are fewer than there are partitions, and the others join by a shuffle.
    """
    total = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    total = store.written(total, "labels")
    n, rows_n = total.agg(F.count("*"), F.sum("_n")).first()
    same = F.col("label").eqNullSafe(F.col("_label"))
    if n <= BROADCAST_LABELS:
        return rows.join(F.broadcast(total), same).drop("_label", "_n")
    often = F.col("_n") * store.partitions(rows.sparkSession) > rows_n
    hot = F.broadcast(total.where(often))
    rest = rows.join(hot, same, "left_anti").join(total.where(~often), same)
    return rows.join(hot, same).unionByName(rest).drop("_label", "_n")


def query(vectors: DataFrame) -> DataFrame:
    rows, book = compress(vectors)
    return by_label(rows).select("vec_id", "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    cut = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS xs
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, p, xs[p * (len(xs) // {parts}) + 1:(p + 1) * (len(xs) // {parts})] AS x FROM v, range({parts}) t(p)),
b0 AS (SELECT p, r - 1 AS e, x AS c FROM x WHERE r <= {entries})"""
    for i in range(rounds + 1):
        cut += f""",
a{i} AS MATERIALIZED (SELECT r, x.p, arg_min(struct_pack(e := e, d := d), d * {entries} + e) AS m FROM (
  SELECT r, x.p, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{i} b ON b.p = x.p) x GROUP BY r, x.p)"""
        if i < rounds:
            cut += f""",
s{i} AS (SELECT p, e, pos, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (
  SELECT a.p, a.m.e AS e, unnest(x.x) AS y, generate_subscripts(x.x, 1) AS pos FROM a{i} a JOIN x ON x.r = a.r AND x.p = a.p) GROUP BY ALL),
n{i} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM s{i} GROUP BY p, e),
b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM b{i} b LEFT JOIN n{i} n ON n.p = b.p AND n.e = b.e)"""
    return (
        cut
        + f""",
c AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT v.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN c ON c.r = v.r
"""
    )


SQL = _sql()
