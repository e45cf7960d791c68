"""Which texts contain which patterns, by an inverted index of trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clinispark.sources.tables import small

#: Characters of a gram; shorter patterns have none and are not found.
GRAM = 3


def grams(x: Column, n: int = GRAM) -> Column:
    """Distinct runs of n characters; none in a shorter or null text."""
    last = F.length(x) - n + 1
    at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(x, i, F.lit(n))))


def containments(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """texts (text) x patterns (pattern) -> (text, pattern): distinct pairs where the text contains the pattern.

    A pattern is looked up by its rarest gram among the texts, and not at all if one of its grams is in no text; what the
    postings of that gram give is then verified. Patterns have GRAM characters at least.
    """
    posts = texts.select("text").distinct().select("text", F.explode(grams(F.col("text"))).alias("gram"))
    each = patterns.select("pattern").distinct().select("pattern", F.size(grams(F.col("pattern"))).alias("n"), F.explode(grams(F.col("pattern"))).alias("gram"))
    wanted = each.select("gram").distinct()
    df = posts.join(small(wanted), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    rare = each.join(df, "gram").groupBy("pattern", "n").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"), F.count("*").alias("found")).where("found = n")
    return posts.join(rare.select("pattern", "gram"), "gram").where(F.col("text").contains(F.col("pattern"))).select("text", "pattern")
