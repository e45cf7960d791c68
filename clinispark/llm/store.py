"""Shared folder, written tables, sizes and ways of dealing rows that the operators here have in common."""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list = []
_lies: dict[int, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on one machine only, one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="clinispark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/clinispark/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            drop_dir(spark, path)
        except Exception:  # the JVM is gone already; the cluster's own sweep of the folder remains
            return


#: Rows of a small table that one task writes.
TASK_ROWS = 100_000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and a lost executor costs nothing.

    Where the caller knows a bound on the rows, the last stage runs in as many tasks as they need, and writes no more files.
    """
    path = new_dir(df.sparkSession, name)
    if rows is not None and (n := parts(rows, TASK_ROWS)) < partitions(df.sparkSession):
        df = df.coalesce(n)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _lies[id(out)] = (weakref.ref(out), path)
    return out


def few(df: DataFrame) -> DataFrame:
    """df in an eighth of the session's partitions: for what a scan of all texts gives, about a hundredth of their bytes.

    The scan keeps its own parallelism; only its small result moves.
    """
    return df.repartition(parts(partitions(df.sparkSession), 8))


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows from the driver, by Arrow: a list given to Spark as it is would start Python workers in every executor."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], schema=kind), StructType.fromDDL(schema))


def drop(*tables: DataFrame) -> None:
    """Removes tables of `written` that nothing will read again."""
    for df in tables:
        ref, path = _lies.pop(id(df), (lambda: None, None))
        if ref() is df:
            drop_dir(df.sparkSession, path)


def parts(total: float, each: float, least: int = 1) -> int:
    """How many pieces of `each` hold `total`."""
    return max(least, math.ceil(total / each))


#: Partitions at most of what is dealt by number; further groups share them.
MOST_PARTITIONS = 50_000


def dealt(df: DataFrame, n: int, key: str) -> DataFrame:
    """df dealt by the numbers 0 to n - 1 in `key`, a group of bounded size in each partition, whatever the session's count."""
    return df.repartitionById(min(n, MOST_PARTITIONS), key)


def grown(base: float, size: float, start: float = 1e12, most: float = 8.0) -> int:
    """`base` up to an input of `start` bytes, then with the square root of the size up to `most` times that.

    Chunks and ranges meet pairwise, so both grow a little with the input: at 100 TB a pair still shares several values.
    """
    return int(base * min(most, max(1.0, (size / start) ** 0.5)))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra ones and their names do not matter."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or a like name that df has no column of, whatever the case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def text_hash(df: DataFrame):
    """A hash of df's text, null as empty."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def text_bytes(df: DataFrame) -> int:
    """Bytes of all texts."""
    return df.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]


#: Stands for a null doc_id where the smallest counts.
LAST = (1 << 63) - 1


def without(docs: DataFrame, gone: DataFrame, repeats: DataFrame | None = None) -> DataFrame:
    """docs without the rows (doc_id, text_hash) of `gone`; of rows in `repeats`, alike in both, one stays.

    Texts are shuffled only where `gone` is too large to broadcast, which Catalyst decides by its size.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    h = fresh(docs, "text_hash")
    keyed = docs.withColumn(h, text_hash(docs))

    def by(right: DataFrame, how: str, left: DataFrame) -> DataFrame:
        d, t = fresh(left, "gone_id"), fresh(left, "gone_hash")
        right = right.select(F.col("doc_id").alias(d), F.col("text_hash").alias(t))
        return left.join(right, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t)), how)

    out = by(gone, "left_anti", keyed)
    if repeats is None or not repeats.limit(1).count():
        return out.select(names)
    one = by(repeats, "left_semi", out).groupBy("doc_id", h).agg(F.first(F.struct(names)).alias("row"))
    return by(repeats, "left_anti", out).select(names).unionByName(one.select("row.*"))
