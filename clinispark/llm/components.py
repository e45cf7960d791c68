"""Connected components by alternating large-star and small-star, in DataFrame operations.

Each round is written to the shared folder, so lineage stays short. Node minima are aggregates with map-side combine and
edges meet them in joins that Spark can split, so a node with very many edges is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: neighbours above a node go to the least of its neighbourhood; else those below, and the node itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = both.join(least, "a")
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node, root), root the least node of its component; a row for each node of an edge.

    edges should be a written table: Python stages in one task would each hold a worker.
    """
    edges = edges.select("a", "b").where("a <> b")
    rows = edges.count()
    edges = store.written(edges.mapInArrow(_contract, "a long, b long").distinct(), "edges", rows)
    before = None
    for _ in range(rounds):
        old, edges = edges, store.written(_star(_star(edges, True), False), "edges", rows)
        store.drop(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before, rows = now, now[0]
    raise RuntimeError("components did not settle")


def _contract(batches):
    """A spanning forest of each batch's edges, as edges to the roots."""
    import pyarrow as pa

    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent=parent) -> int:
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = parent[p]
                x = parent[x]
            return x

        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        nodes = [x for x in parent if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])
