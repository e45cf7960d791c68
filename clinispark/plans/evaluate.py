"""Evaluation from end to end: a frozen set, a backend, measures of each sample, and their summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinispark.functions import scores
from clinispark.functions import text as T
from clinispark.operators import metrics, notes, rubrics
from clinispark.sources import backends, tables


def speech(samples: DataFrame, hypotheses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """samples (id, reference, entities) and hypotheses (id, hypothesis) -> (one row a sample, one row in all).

    entities is a JSON list of [surface, category, spans]; a sample without a hypothesis counts as one with an empty text.
    """
    x = samples.join(hypotheses, "id", "left").withColumn("hypothesis", F.coalesce("hypothesis", F.lit("")))
    words = lambda c: T.words(T.normalize_text(F.col(c)))
    counts = lambda only: metrics.keyword_counts(F.col("reference"), F.col("hypothesis"), metrics.entity_keywords(F.col("entities"), only))
    x = x.withColumns({"k": counts(None), "d": counts("drugs"), "wer": F.round(scores.word_error_rate(words("reference"), words("hypothesis")), 4)})
    each = x.select(
        "id", "reference", "hypothesis", "wer", F.col("k.present").alias("keywords"), F.col("k.missed").alias("keywords_missed"),
        scores.rate(F.col("k.missed"), F.col("k.present"), 4).alias("keyword_wer"), F.col("d.present").alias("drugs"), F.col("d.missed").alias("drugs_missed"),
    )
    corpus = metrics.corpus_wer(x)
    sums = each.agg(F.count("*").alias("samples"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("keywords", "keywords_missed", "drugs", "drugs_missed")])
    rates = {"keyword_wer": scores.rate(F.col("keywords_missed"), F.col("keywords"), 4), "drug_wer": scores.rate(F.col("drugs_missed"), F.col("drugs"), 4)}
    return each, sums.withColumns(rates).crossJoin(corpus)  # one row each


def extraction(samples: DataFrame, extractor: Callable, drugs: DataFrame, categories: DataFrame, frequencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """samples (note_id, transcript, rubrics) -> (one row a criterion, recall by category and in all).

    A criterion is shown by its first 80 characters, with the first five values of the field that answers it.

    A note whose extraction fails is empty, so its representable criteria count as missed.
    """
    found = notes.build(backends.extract(samples.select("note_id", "transcript"), extractor), drugs)
    values = rubrics.note_values(found)
    each = rubrics.match(rubrics.parse(samples), values, categories, frequencies)
    held = values.groupBy("note_id", "field").agg(F.slice(F.array_sort(F.collect_list("value")), 1, 5).alias("values"))
    fields = tables.small(categories.select("category", "field"))
    shown = each.join(fields, "category", "left").join(held, ["note_id", "field"], "left").withColumn("criterion", F.substring("criterion", 1, 80))
    return shown, rubrics.rollup(each)


def save(each: DataFrame, summary: DataFrame, path: str, *order: str) -> str:
    """Writes both as JSON under path; returns the summary as a fixed-width text."""
    tables.write_results(summary, each, path, *order)
    return tables.report(summary)
