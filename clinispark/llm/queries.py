"""The thirteen queries and the pipeline, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import chat_format, decontamination, hard_negatives, jaccard_join, line_dedup, lm_scoring, packing, pii, quality_rules, resharding, substring_dedup, vector_codes, warc


def _documents(f):
    return lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def queries() -> dict:
    return {
        "op1_line_dedup": _documents(line_dedup.query),
        "op2_resharding": _documents(resharding.query),
        "op3_substring_dedup": _documents(substring_dedup.query),
        "op4_decontamination": lambda spark, sf_dir: decontamination.query(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
        "op5_warc": lambda spark, sf_dir: warc.query(spark.read.parquet(f"{sf_dir}/pages.parquet")),
        "op6_pii": _documents(pii.find),
        "op7_quality_rules": _documents(quality_rules.query),
        "op8_packing": _documents(packing.query),
        "op9_lm_scoring": lambda spark, sf_dir: lm_scoring.query(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")),
        "op10_jaccard_join": _documents(jaccard_join.query),
        "op11_vector_codes": lambda spark, sf_dir: vector_codes.query(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
        "op12_chat_format": lambda spark, sf_dir: chat_format.query(spark.read.parquet(f"{sf_dir}/conversations.parquet")),
        "op13_hard_negatives": lambda spark, sf_dir: hard_negatives.query(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op5_warc": warc.SQL, "op3_substring_dedup": substring_dedup.SQL, "op4_decontamination": decontamination.SQL, "op7_quality_rules": quality_rules.SQL, "op9_lm_scoring": lm_scoring.SQL, "op10_jaccard_join": jaccard_join.SQL, "op11_vector_codes": vector_codes.SQL, "op12_chat_format": chat_format.SQL, "op13_hard_negatives": hard_negatives.SQL}
