"""Keyword and word error rates, per row and over a corpus."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinispark.functions import alignment, scores
from clinispark.functions import text as T


def entity_keywords(raw: Column, only: str | None = None) -> Column:
    """Distinct surfaces of a JSON list of [surface, category, spans], in order; of one category if named."""
    rows = F.coalesce(F.from_json(raw, "array<array<string>>"), F.array().cast("array<array<string>>"))
    if only:
        rows = F.filter(rows, lambda r: F.get(r, F.lit(1)) == only)
    found = F.transform(rows, lambda r: F.trim(F.coalesce(F.get(r, F.lit(0)), F.lit(""))))
    return F.array_distinct(F.filter(found, lambda k: k != ""))


def keyword_counts(reference: Column, hypothesis: Column, keywords: Column) -> Column:
    """struct<present, missed>: a row's own keywords in the reference, and those of them not in the hypothesis, as substrings."""
    sides = F.struct(T.normalize_text(reference).alias("ref"), T.normalize_text(hypothesis).alias("hyp"))
    present = T.let(sides, lambda x: F.struct(x["hyp"].alias("hyp"), F.filter(F.transform(keywords, T.normalize_text), lambda k: x["ref"].contains(k)).alias("found")))
    missed = lambda x: F.filter(x["found"], lambda k: ~x["hyp"].contains(k))
    return T.let(present, lambda x: F.struct(F.size(x["found"]).cast("long").alias("present"), F.size(missed(x)).cast("long").alias("missed")))


#: Bytes of keywords that one automaton holds; more are taken in parts.
KEYWORD_BYTES = 32 << 20
_automata: dict = {}


def _automaton(held):
    """The automaton of a broadcast keyword list, built once in a Python worker."""
    import ahocorasick

    if held.value[0] not in _automata:
        _automata.clear()
        found = ahocorasick.Automaton()
        for word, ids in held.value[1]:
            found.add_word(word, ids)
        found.make_automaton()
        _automata[held.value[0]] = found
    return _automata[held.value[0]]


def _hits(held):
    """A function text -> numbers of the keywords in it, for a broadcast keyword list."""

    @F.pandas_udf("array<int>")
    def hits(text: pd.Series) -> pd.Series:
        found = _automaton(held) if held.value[1] else None
        return pd.Series([sorted({i for _, ids in found.iter(x) for i in ids}) if found and x else [] for x in text])

    return hits


def keyword_hits(texts: DataFrame, keywords: DataFrame, text: str = "norm") -> DataFrame:
    """texts with `hits`: the numbers of the keywords (keyword) in each normalized text, as substrings.

    One Aho-Corasick scan of a text finds all of them, so the work grows with the texts and not with the list. Each entry of
    the list has its own number, repeated ones too; an empty keyword is in every text.
    """
    words = keywords.where("keyword IS NOT NULL").select("keyword", F.octet_length("keyword").cast("long").alias("bytes"))
    n = max(1, -(-words.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] // KEYWORD_BYTES))
    counts = words.groupBy("keyword").agg(F.count("*").alias("times"))
    columns, first = [], 0
    for i in range(n):
        part = counts.where(F.pmod(F.xxhash64("keyword"), F.lit(n)) == i) if n > 1 else counts
        rows, always = [], []
        for r in part.orderBy("keyword").collect():
            ids = list(range(first, first + r["times"]))
            first += len(ids)
            if r["keyword"]:
                rows.append((r["keyword"], ids))
            else:
                always = ids
        held = texts.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, rows))
        columns.append(F.concat(F.array(*map(F.lit, always)).cast("array<int>"), _hits(held)(F.coalesce(F.col(text), F.lit("")))))
    return texts.withColumn("hits", F.concat(*columns) if n > 1 else columns[0])


def micro(counted: DataFrame, digits: int = 4) -> DataFrame:
    """Sums of present and missed, and their ratio."""
    sums = counted.agg(F.coalesce(F.sum("present"), F.lit(0)).alias("present"), F.coalesce(F.sum("missed"), F.lit(0)).alias("missed"))
    return sums.withColumn("keyword_wer", scores.rate(F.col("missed"), F.col("present"), digits))


def corpus_wer(pairs: DataFrame, reference: str = "reference", hypothesis: str = "hypothesis") -> DataFrame:
    """Edits of all pairs by words of all references; empty references are left out."""
    p = pairs.select(T.words(T.normalize_text(F.col(reference))).alias("r"), T.words(T.normalize_text(F.col(hypothesis))).alias("h")).where(F.size("r") > 0)
    sums = p.agg(F.coalesce(F.sum(scores.word_edits(F.col("r"), F.col("h"))), F.lit(0)).alias("edits"), F.coalesce(F.sum(F.size("r")), F.lit(0)).cast("long").alias("words"))
    return sums.withColumn("wer", scores.rate(F.col("edits"), F.col("words"), 4))


def error_kinds(pairs: DataFrame, reference: str = "r", hypothesis: str = "h") -> DataFrame:
    """pairs with hits, substitutions, deletions and insertions of their word arrays, or of texts with blanks between words."""
    inner = alignment.text_errors if pairs.schema[reference].dataType.simpleString() == "string" else alignment.word_errors
    return pairs.withColumn("_k", inner(F.col(reference), F.col(hypothesis))).select(*pairs.columns, "_k.*")


def error_split(kinds: DataFrame, digits: int = 4) -> DataFrame:
    """Sums of the kinds, and the share of each in all reference words."""
    names = ("hits", "substitutions", "deletions", "insertions")
    sums = kinds.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    words = F.col("hits") + F.col("substitutions") + F.col("deletions")
    return sums.select(*names, *[scores.rate(F.col(n), words, digits).alias(f"{n}_rate") for n in names[1:]])
