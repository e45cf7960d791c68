"""The corpus pipeline: quality rules, line dedup, near copies, decontamination, packing.

Each stage takes and gives documents; the last gives packed pieces.

Defined cases: a document with a null or empty text fails the quality rules and goes; of documents that repeat a doc_id and a
text one stays, in the near-copy stage; a null doc_id comes after all others where the smallest stays; null lang and source are
groups of their own; ties go by doc_id, then by a hash of the text; texts of any length are read whole; columns beside those
of documents stay as they are, whatever their names, until the last stage; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clinispark.llm import decontamination, jaccard_join, line_dedup, packing, quality_rules, store

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("jaccard_join", jaccard_join.stage),
    ("decontamination", decontamination.stage),
    ("packing", packing.stage),
]
#: Token ids can't be told in SQL; tests/llm holds every row of run() against a chain of plain stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, store.written(stage(spark, docs, sf_dir), name)
        store.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
