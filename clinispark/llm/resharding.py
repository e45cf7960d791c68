"""Minimum-cost-flow resharding: from old shard sizes and new capacities, the block transfers that move the fewest bytes.

A block is a run of rows of one file; a row is a block where there are few. The driver sees only blocks, whose number is
bounded by BLOCKS and the number of files and not by the rows. A flow over old and new shards ships the bytes of every block
and gives the bytes of each transfer; blocks, largest first, then take the transfer of their shard with the most left, and
files of shards that lose or gain a block are rewritten, without a shuffle. The law is `bytes`: shard sizes come out near
equal. Only a block larger than a whole shard, which no flow can level, is set down first, in its own shard if it can.

Defined cases: a null text has no bytes, so its size is 16; documents with equal text are not kept together, since one
group of copies may be larger than a shard; rows that repeat are rows like others; a null doc_id is a value like
others; an empty table gives an empty result; columns beside doc_id and text are carried by `reshard` and else ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import store

HEADER, OLD, NEW = 16, 32, 40
#: Bytes of text in a file of an old shard that the query writes, and files of a shard at most.
FILE_BYTES, SHARD_FILES = 8 << 20, 4096
#: Blocks that a table is cut into, besides one for each file, and the most that are broadcast.
BLOCKS, BROADCAST_BLOCKS = 8192, 100_000


def min_cost_flow(supply: list[int], capacity: list[int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Integer flows (i, j) -> amount of least total cost that ship all supply within capacity.

    Successive shortest paths with potentials on the bipartite network; sum(supply) must not exceed sum(capacity).
    """
    m, n = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("supply exceeds capacity")
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    potential = [0] * (m + n)
    while any(left):
        dist, back = [None] * (m + n), [-1] * (m + n)
        heap = [(0, i) for i in range(m) if left[i]]
        for _, i in heap:
            dist[i] = 0
        done = [False] * (m + n)
        while heap:
            d, u = heapq.heappop(heap)
            if done[u]:
                continue
            done[u] = True
            if u < m:
                steps = [(m + j, cost(u, j)) for j in range(n)]
            else:
                steps = [(i, -cost(i, u - m)) for i in range(m) if flow.get((i, u - m))]
            for v, c in steps:
                far = d + c + potential[u] - potential[v]
                if dist[v] is None or far < dist[v]:
                    dist[v], back[v] = far, u
                    heapq.heappush(heap, (far, v))
        most = max(d for d in dist if d is not None)
        potential = [p + (most if d is None else d) for p, d in zip(potential, dist, strict=True)]
        end = min((j for j in range(n) if room[j] and dist[m + j] is not None), key=lambda j: potential[m + j])
        path, v = [], m + end
        while v != -1:
            path.append(v)
            v = back[v]
        path.reverse()
        amount = min(left[path[0]], room[end], *(flow[(path[k + 1], path[k] - m)] for k in range(1, len(path) - 1, 2)))
        for k in range(len(path) - 1):
            a, b = path[k], path[k + 1]
            if a < m:
                flow[(a, b - m)] = flow.get((a, b - m), 0) + amount
            else:
                flow[(b, a - m)] -= amount
        left[path[0]] -= amount
        room[end] -= amount
    return {k: v for k, v in flow.items() if v}


def plan(blocks: list[tuple[int, int]], n_old: int, n_new: int) -> list[int]:
    """The new shard of each block (old shard, bytes)."""
    places, load, rest = [0] * len(blocks), [0] * n_new, sum(b for _, b in blocks)
    order = sorted(range(len(blocks)), key=lambda k: (-blocks[k][1], k))
    while order and blocks[order[0]][1] * n_new > sum(load) + rest:
        old, b = blocks[k := order.pop(0)]
        places[k] = old if old < n_new and not load[old] else min(range(n_new), key=lambda j: (load[j], j))
        load[places[k]] += b
        rest -= b
    supply = [0] * n_old
    for k in order:
        supply[blocks[k][0]] += blocks[k][1]
    left: list[dict[int, int]] = [{} for _ in range(n_old)]
    for (i, j), amount in min_cost_flow(supply, _fill(load, rest)).items():
        left[i][j] = amount
    for k in order:
        old, b = blocks[k]
        places[k] = max(left[old], key=lambda j: (left[old][j], j == old, -j), default=old % n_new)
        if places[k] in left[old]:
            left[old][places[k]] -= b
    return places


def _fill(load: list[int], rest: int) -> list[int]:
    """Room that each shard gets so that loads end level, as whole bytes that sum to rest."""
    order, room, n = sorted(range(len(load)), key=lambda j: (load[j], j)), [0] * len(load), 0
    held = 0
    for n in range(1, len(order) + 1):
        held += load[order[n - 1]]
        if n == len(order) or (rest + held) <= n * load[order[n]]:
            break
    level, over = divmod(rest + held, n)
    for k, j in enumerate(order[:n]):
        room[j] = level + (k < over) - load[j]
    return room


def size_of(text):
    return (F.octet_length(F.coalesce(text, F.lit(""))) + HEADER).cast("long")


class Layout:
    """Where the blocks of a table in shard=<i> folders lie and go."""

    def __init__(self, spark: SparkSession, path: str, schema, n_new: int, blocks: int = BLOCKS):
        self.spark, self.path, self.schema, self.n_new = spark, path, schema, n_new
        rows = self.rows()
        count = rows.count()
        self.height = store.parts(count, blocks)
        held = rows.groupBy("shard", "file", self._block()).agg(F.sum(size_of(F.col("text"))).alias("bytes"), F.count("*").alias("n"))
        held = sorted(tuple(r) for r in held.collect())
        self.n_old = 1 + max([r[0] for r in held], default=0)
        places = plan([(r[0], r[3]) for r in held], self.n_old, n_new)
        self.moves, self.sizes, self.moved = [], [[0, 0] for _ in range(n_new)], 0
        changed = set()
        for (old, file, block, size, n), to in zip(held, places, strict=True):
            self.moves.append((old, file, block, to, self.sizes[to][0]))
            self.sizes[to][0] += n
            self.sizes[to][1] += size
            if old != to:
                self.moved += size
                changed |= {old, to}
        #: shards whose files are written anew; the others stay where they are
        self.affected = sorted(changed)

    def rows(self) -> DataFrame:
        """The old table with the file and the place of each row; names of its own are kept apart in a struct."""
        table = self.spark.read.schema(StructType([*self.schema.fields, StructField("shard", IntegerType())])).parquet(self.path)
        return table.select("shard", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"), F.struct(*[F.col(f"`{c}`") for c in self.schema.names]).alias("held"), F.col("text"))

    def _block(self):
        return F.expr(f"place div {self.height}").cast("long").alias("block")

    def placed(self) -> DataFrame:
        """(held, old_shard, shard, slot) of all rows."""
        moves = store.table(self.spark, self.moves, "shard int, file string, block long, to int, first_slot long")
        moves = F.broadcast(moves) if len(self.moves) <= BROADCAST_BLOCKS else moves
        rows = self.rows().withColumn("block", self._block()).join(moves, ["shard", "file", "block"])  # a task names its files alike in all folders
        slot = F.col("first_slot") + F.col("place") - F.col("block") * self.height
        return rows.select("held", F.col("shard").alias("old_shard"), F.col("to").alias("shard"), slot.alias("slot"))

    def rewrite(self, path: str) -> DataFrame:
        """Writes the affected shards under path -> (shard, path, rows, bytes) of all new shards that hold a row."""
        self.placed().where(F.col("shard").isin(self.affected)).write.option("compression", "zstd").partitionBy("shard").parquet(path)
        lies = [(j, f"{path if j in self.affected else self.path}/shard={j}", n, b) for j, (n, b) in enumerate(self.sizes) if n]
        return store.table(self.spark, lies, "shard int, path string, rows long, bytes long")

    def read(self, path: str) -> DataFrame:
        """(held, old_shard, shard, slot) from the files as they lie after `rewrite`."""
        placed = self.placed()
        new = self.spark.read.schema(placed.schema).parquet(path).select("held", "old_shard", "shard", "slot")
        return new.unionByName(placed.where(~F.col("shard").isin(self.affected)))


def reshard(spark: SparkSession, old_path: str, new_path: str, n_new: int) -> DataFrame:
    """Moves a table kept in shard=<i> folders to n_new near-equal shards -> (shard, path, rows, bytes): where each lies.

    Rows lie as (held, old_shard, slot) in shards that were written anew; the others stay where and as they are.
    """
    schema = spark.read.parquet(old_path).schema
    schema = StructType([f for f in schema if f.name != "shard"])
    return Layout(spark, old_path, schema, n_new).rewrite(new_path)


def query(docs: DataFrame) -> DataFrame:
    """Writes docs as OLD shards, row by row in turn, reshards them to NEW and reads the digests from the new files."""
    spark, docs = docs.sparkSession, store.columns(docs, "doc_id", "text")
    old, new = store.new_dir(spark, "old-shards"), store.new_dir(spark, "new-shards")
    files = min(SHARD_FILES, store.parts(store.text_bytes(docs), OLD * FILE_BYTES))
    dealt = docs.withColumn("row", F.monotonically_increasing_id()).withColumn("shard", F.expr(f"cast(row % {OLD} as int)"))
    dealt = dealt.repartitionById(OLD * files, F.expr(f"cast(shard * {files} + row div {OLD} % {files} as int)")).sortWithinPartitions("shard", "row").drop("row")
    dealt.write.option("compression", "zstd").partitionBy("shard").parquet(old)
    layout = Layout(spark, old, docs.schema, NEW)
    layout.rewrite(new)
    rows = layout.read(new)
    text = F.coalesce(F.col("held.text"), F.lit(""))
    return rows.select(
        F.col("held.doc_id").alias("doc_id"),
        size_of(F.col("held.text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )
