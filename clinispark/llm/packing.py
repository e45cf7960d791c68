"""Packing by minimum bin slack: per bin, a bitset subset-sum over the lengths left finds the fullest combination.

Token ids come from `pieces`, whatever the vocabulary: one that it cannot cut by itself goes through the tokenizer whole.
Only a histogram of lengths, at most `size` entries, comes to the driver. A combination found there is a pattern; it is
used as often as the counts allow, so there are about as many patterns as lengths. Pieces get a rank within their
length, and a pattern's place in a length's ranks gives sequence and offset through a join with the pattern table.

Defined cases: a null text is empty and gives the end id alone; rows that repeat are packed each; a null doc_id stays
null; an empty table gives an empty result; texts of any length are tokenized whole, longer ones are cut into pieces.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store
from .pieces import Ids

SIZE, END = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_held: dict[str, Ids] = {}


def ids_by(path: str) -> Ids:
    """The tokenizer of this Python worker, kept from task to task; its table has a fixed size."""
    if path not in _held:
        _held[path] = Ids(path)
    return _held[path]


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """docs (doc_id, text) -> PIECES, and the ids of each piece as `ids array<int>` where asked for."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        from .words import binary, slices

        found = ids_by(path or tokenizer_path())
        names = re.findall(r"(\w+) \w+", PIECES)
        for batch in slices(batches, 512):
            rows, parts = [], []
            texts = found.of([t or b"" for t in binary(batch.column("text"))])
            for doc, ids in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                every = np.append(ids, END).astype("<u4")
                raw = every.tobytes()
                for k, at in enumerate(range(0, len(every), size)):
                    part = raw[4 * at : 4 * (at + size)]
                    rows.append((doc, k, at, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        parts.append(every[at : at + size].astype(np.int32))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)]
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

    return store.columns(docs, "doc_id", "text").mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def fullest(counts: dict[int, int], room: int, order: list[int]) -> list[tuple[int, int]]:
    """The lengths and how often, at most counts, whose sum is the largest within room.

    reach is a bitset of sums; each step adds copies of one length, doubling, and the steps are walked back from the best.
    """
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for length in order:
        if length > room:
            continue
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            after = reach | ((reach << (length * take)) & full)
            if after != reach:
                steps.append((length, take, reach))
                reach = after
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return sorted(used.items(), reverse=True)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, how often in one sequence)]) that use up the histogram.

    Each pattern holds the largest length left and the fullest combination beside it.
    """
    left, out = {k: v for k, v in histogram.items() if v}, []
    order = sorted(left, reverse=True)
    while order:
        seed = order[0]
        left[seed] -= 1
        used = dict(fullest(left, size - seed, order)) if seed < size else {}
        left[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
        order = [k for k in order if left[k]]
        out.append((times, sorted(used.items(), reverse=True)))
    return out


def pack(found: DataFrame, size: int = SIZE, block_rows: int = 1_000_000) -> DataFrame:
    """Pieces (PIECES and any further columns) -> with sequence_id and offset.

    Ranks within a length are block offsets plus ranks in blocks, so one frequent length is many tasks' work. Each block of
    a length takes just the slots that its ranks reach, in a join that is dealt as the ranks are.
    """
    spark = found.sparkSession
    found = store.written(store.few(found), "pieces")
    rows = found.count()
    blocks = store.parts(rows, block_rows, 16)
    blocked = found.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).cast("int"))
    held = blocked.groupBy("length", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    held = store.written(held.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "held", min(rows, blocks * size))
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    by_length: dict[int, list] = {k: [] for k in histogram}
    next_rank, sequence = dict.fromkeys(histogram, 0), 0
    for times, used in patterns(histogram, size):
        offset = 0
        for length, n in used:
            for _ in range(n):
                by_length[length].append({"first": next_rank[length], "sequence": sequence, "offset": offset})
                next_rank[length] += times
                offset += length
        sequence += times
    # one row a length, at most `size`; slots of a length ascend by rank
    table = store.table(spark, list(by_length.items()), "length long, slots array<struct<first:long,sequence:long,offset:long>>")
    last = lambda rank: F.size(F.filter("slots", lambda s: s["first"] <= rank))
    first = last(F.col("before"))
    near = F.slice("slots", first, last(F.col("before") + F.col("n") - 1) - first + 1)
    reach = held.join(F.broadcast(table), "length").select(F.col("length").alias("_length"), F.col("block").alias("_block"), "before", near.alias("near"))
    rank = F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = blocked.withColumn("rank", rank).join(reach.hint("merge"), [F.col("length") == F.col("_length"), F.col("block") == F.col("_block")])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("rank"))
    ranked = ranked.withColumn("at", F.element_at(F.filter("near", lambda s: s["first"] <= F.col("rank")), -1))
    return ranked.withColumns({"sequence_id": F.col("at.sequence") + F.col("rank") - F.col("at.first"), "offset": F.col("at.offset")}).select(*found.columns, "sequence_id", "offset")


def sequences(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """docs (doc_id, text) -> (sequence_id, ids, doc_ids, starts): the packed sequences themselves, at most `size` ids each."""
    packed = pack(pieces(docs, path, size, with_ids=True), size)
    held = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    out = packed.groupBy("sequence_id").agg(held.alias("held"))
    return out.select("sequence_id", F.flatten("held.ids").alias("ids"), F.col("held.doc_id").alias("doc_ids"), F.col("held.offset").alias("starts"))


def query(docs: DataFrame) -> DataFrame:
    """Digests of the packed pieces; `sequences` gives the sequences themselves."""
    return pack(pieces(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return query(docs)
