"""Table scans with explicit order, JSON columns, and written results."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """One scan over all paths, not a union of scans."""
    if not paths:
        raise ValueError("no path to scan")
    return spark.read.parquet(*paths)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def take(df: DataFrame, key: str, wanted: list) -> DataFrame:
    """Rows whose key is wanted, with their place in that list; a bounded list, so it is broadcast."""
    places = df.sparkSession.createDataFrame(list(enumerate(wanted)), f"pos int, {key} {df.schema[key].dataType.simpleString()}")
    return df.join(F.broadcast(places), key)


#: Rows of a lexicon that may go to every task, and their bytes.
SMALL, SMALL_BYTES = 200_000, 64 << 20


def small(df: DataFrame, most: int = SMALL, size: int = SMALL_BYTES) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows of at most `size` bytes in all, else left to be joined by a shuffle."""
    bytes_ = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long")), F.lit(0))
    rows, held = df.limit(most + 1).agg(F.count("*"), bytes_).first()
    return F.broadcast(df) if rows <= most and held <= size else df


def parts(df: DataFrame, most: int = SMALL) -> list[DataFrame]:
    """df in parts of about `most` rows, each marked for broadcast: for joins without an equality, part by part."""
    n = -(-df.count() // most)
    place = F.pmod(F.xxhash64(*df.columns), F.lit(max(n, 1)))
    return [F.broadcast(df.where(place == i) if n > 1 else df) for i in range(max(n, 1))]


def shown(df: DataFrame, keys: list[str], value, most: int = 5) -> DataFrame:
    """(keys, n, shown): how many rows each key has, and its `most` smallest values for a report.

    Spark cuts each key to `most` rows before the shuffle, since only the first numbers of a window are asked for.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("_value"))
    first = df.select(*keys, value.alias("_value")).withColumn("_nth", nth).where(F.col("_nth") <= most)
    same = lambda a, b: functools.reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])
    tops = first.groupBy(*keys).agg(F.array_sort(F.collect_list("_value")).alias("shown"))
    return counts.join(tops, same(counts, tops), "left").select(*[counts[k] for k in keys], "n", F.coalesce("shown", F.array().cast(tops.schema["shown"].dataType)).alias("shown"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report(df: DataFrame, *order: str, width: int = 24, most: int = 1000) -> str:
    """A fixed-width text of a small summary, at most `most` rows."""
    rows = df.orderBy(*order).limit(most).collect() if order else df.limit(most).collect()
    line = lambda cells: "".join(f"{'-' if c is None else c!s:<{width}}" for c in cells).rstrip()
    return "\n".join([line(df.columns), *map(line, rows)])


def write_frozen(df: DataFrame, key: str, path: str, dataset: str, most: int = 10_000) -> list:
    """Writes the keys of a chosen set, in order, with the name of their dataset as one JSON file; returns them."""
    keys = [r[0] for r in df.select(key).limit(most + 1).collect()]
    if len(keys) > most:
        raise ValueError(f"a frozen set holds at most {most} keys")
    df.sparkSession.createDataFrame([(dataset, keys)], f"dataset string, ids array<{df.schema[key].dataType.simpleString()}>").coalesce(1).write.mode("overwrite").json(path)
    return keys


def write_results(summary: DataFrame, samples: DataFrame, path: str, *order: str) -> None:
    """Two JSON tables under path: summary/ and samples/, UTF-8 as it is, the samples in order within their files."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    (samples.sortWithinPartitions(*order) if order else samples).write.mode("overwrite").json(f"{path}/samples")


def preflight(spark: SparkSession, *paths: str, backends: dict | None = None) -> None:
    """Fails at the driver, before a run, if an input is missing or a backend does not answer.

    backends are names with a function that raises or returns False where the backend is not there.
    """
    lacking = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            lacking.append(f"no input at {path}")
    for name, probe in (backends or {}).items():
        try:
            if probe() is False:
                lacking.append(f"{name} does not answer")
        except Exception as e:  # whatever a backend raises, the run can't start
            lacking.append(f"{name}: {type(e).__name__}: {e}")
    if lacking:
        raise RuntimeError("; ".join(lacking))
