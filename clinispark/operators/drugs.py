"""Drug names: validation in four tiers, and replacement of drug names in another script in three."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinispark.functions import fuzzy, spans
from clinispark.functions import text as T
from clinispark.operators import substrings
from clinispark.sources import lexicon
from clinispark.sources.tables import parts, small

RATIO, RATIO_LENGTH, LONG = 0.82, 8, 4


def strip_forms(name: Column, forms=lexicon.FORMS) -> Column:
    """name without dosage forms at its ends, however many."""
    any_form = "|".join(sorted(forms, key=len, reverse=True))
    return F.trim(F.regexp_replace(F.regexp_replace(name, rf"(?i)^(?:(?:{any_form})\s+)+", ""), rf"(?i)(?:\s+(?:{any_form}))+$", ""))


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def validate(names: DataFrame, drugs: DataFrame, forms=lexicon.FORMS) -> DataFrame:
    """names (name) -> with tier: 1 exact, 2 exact without forms, 3 substring either way, 4 shared token, null none.

    Each distinct name is looked up once; a tier sees only names that the tiers before left over.
    """
    known = drugs.select(F.col("drug").alias("_drug")).distinct()
    each = small(known)
    todo = names.select("name").where("name IS NOT NULL").distinct().withColumn("norm", T.normalize_name(F.col("name"))).where("norm <> ''")
    todo = todo.withColumn("bare", T.normalize_name(strip_forms(F.col("norm"), forms))).withColumn("work", F.coalesce(T.falsy_to_null(F.col("bare")), "norm"))
    exact = todo.join(each.withColumnRenamed("_drug", "_a"), F.col("norm") == F.col("_a"), "left").join(each.withColumnRenamed("_drug", "_b"), F.col("bare") == F.col("_b"), "left")
    exact = exact.withColumn("tier", F.when(F.col("_a").isNotNull(), 1).when(F.col("_b").isNotNull(), 2)).drop("_a", "_b")
    rest = exact.where("tier IS NULL")
    ours = rest.where(F.length("work") >= LONG).select("work").distinct()
    theirs = known.where(F.length("_drug") >= LONG)
    holding = substrings.containments(theirs.select(F.col("_drug").alias("text")), ours.withColumnRenamed("work", "pattern")).select(F.col("pattern").alias("work"))
    held = substrings.containments(ours.withColumnRenamed("work", "text"), theirs.select(F.col("_drug").alias("pattern"))).select(F.col("text").alias("work"))
    third = rest.join(holding.unionByName(held).distinct(), "work", "left_semi").select("name").withColumn("t3", F.lit(3))
    long_tokens = F.filter(T.name_tokens(F.col("work")), lambda t: F.length(t) >= LONG)
    drug_tokens = small(drugs.select(F.explode(T.name_tokens(F.col("drug"))).alias("_token")).distinct())
    fourth = rest.select("name", F.explode(long_tokens).alias("_token")).join(drug_tokens, "_token", "left_semi").select("name", F.lit(4).alias("t4")).distinct()
    tiers = exact.join(third, "name", "left").join(fourth, "name", "left").select("name", F.coalesce("tier", "t3", "t4").alias("tier"))
    return names.join(tiers, "name", "left").withColumn("validated", F.col("tier").isNotNull())


def roman_index(drugs: DataFrame) -> DataFrame:
    """(key, drug): each drug under its levelled spelling, with and without blanks; the first name wins a key."""
    key = fuzzy.roman_key(F.regexp_replace(F.replace(F.replace(F.lower("drug"), F.lit("ph"), F.lit("f")), F.lit("ai"), F.lit("a")), "a$", ""))
    both = drugs.where("trim(drug) <> ''").select("drug", F.explode(F.array_distinct(F.array(key, F.replace(key, F.lit(" "), F.lit(""))))).alias("key"))
    return both.groupBy("key").agg(F.min("drug").alias("drug"))


def span_labels(found: DataFrame, drugs: DataFrame, scripts: DataFrame, *, use_fuzzy: bool = True) -> DataFrame:
    """found (span) -> (span, label, tier) of the distinct spans that a tier knows: curated, exact, then fuzzy."""
    index = roman_index(drugs)
    todo = found.select("span").distinct()
    first = todo.join(small(scripts), "span", "left")
    rest = first.where("latin IS NULL").select("span").withColumn("roman", fuzzy.romanize("span"))
    key = fuzzy.roman_key(F.col("roman"))
    a, b = small(index.selectExpr("key AS _k1", "drug AS _d1")), small(index.selectExpr("key AS _k2", "drug AS _d2"))
    second = rest.withColumns({"k1": key, "k2": F.replace(key, F.lit(" "), F.lit(""))}).join(a, F.col("k1") == F.col("_k1"), "left").join(b, F.col("k2") == F.col("_k2"), "left").withColumn("drug", F.coalesce("_d1", "_d2"))
    out = first.where("latin IS NOT NULL").select("span", F.col("latin").alias("label"), F.lit("curated").alias("tier"))
    out = out.unionByName(second.where("drug IS NOT NULL").select("span", F.col("drug").alias("label"), F.lit("exact").alias("tier")))
    if not use_fuzzy:
        return out
    flat = F.replace("roman", F.lit(" "), F.lit(""))
    long = drugs.select(F.col("drug").alias("cand"), F.replace(F.lower("drug"), F.lit(" "), F.lit("")).alias("cand_flat")).where(F.length("cand_flat") >= RATIO_LENGTH)
    left = second.where("drug IS NULL").select("span", flat.alias("flat"))
    pairs = _union([left.join(p, fuzzy.ratio_can_reach(F.col("flat"), F.col("cand_flat"), RATIO)) for p in parts(long)])
    scored = pairs.where(fuzzy.letters_can_reach(F.col("flat"), F.col("cand_flat"), RATIO)).withColumn("ratio", fuzzy.matching_ratio("flat", "cand_flat")).where(F.col("ratio") >= RATIO)
    best = scored.groupBy("span").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "cand")).alias("m"))
    return out.unionByName(best.select("span", F.col("m.cand").alias("label"), F.lit("fuzzy").alias("tier")))


def rewrite(turns: DataFrame, drugs: DataFrame, scripts: DataFrame, *, use_fuzzy: bool = True) -> DataFrame:
    """turns (recording_id, turn_idx, text, ...) with Devanagari drug names replaced; longer spans win, then earlier.

    Spans are looked up in composed form; a text without a match stays as it is.
    """
    keys = ["recording_id", "turn_idx"]
    cut = turns.where(T.has_devanagari(F.col("text"))).withColumn("tokens", T.words(fuzzy.nfc("text")))
    each = cut.select(*keys, F.inline(spans.ngrams(F.col("tokens")))).where(T.has_devanagari(F.col("span")))
    labels = span_labels(each, drugs, scripts, use_fuzzy=use_fuzzy).select("span", "label")
    hit = F.struct("start_word", "end_word", "label", F.lit(1.0).alias("score"), F.lit(0).alias("nth"))
    hits = each.join(labels, "span").groupBy(*keys).agg(F.collect_list(hit).alias("hits"))
    joined = turns.join(hits, keys, "left")
    chosen = spans.longest_leftmost(F.coalesce("hits", F.array().cast(spans.MATCH)))
    return joined.withColumn("text", spans.replace_spans(F.col("text"), T.words(F.col("text")), chosen)).drop("hits")
