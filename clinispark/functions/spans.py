"""Word spans in arrays: n-grams, greedy selection, splicing and glossing, all within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinispark.functions import text as T

MATCH = "array<struct<start_word:int,end_word:int,label:string,score:double,nth:int>>"


def ngrams(tokens: Column, most: int = 3) -> Column:
    """array<struct<span,start_word,end_word>>: all runs of 1 to `most` words, shorter ones first, left to right.

    The words are bound once a row, since the lambda names them for every run.
    """

    def of(words: Column, n: int) -> Column:
        last = F.size(words) - n
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.array_join(F.slice(words, i + 1, n), " ").alias("span"), i.alias("start_word"), (i + n).alias("end_word")))

    return T.let(tokens, lambda words: F.concat(*[of(words, n) for n in range(1, most + 1)]))


def choose(matches: Column, before) -> Column:
    """Matches taken in the order `before(a, b)` (negative: a first), each unless it overlaps one taken; by start."""
    ordered = F.array_sort(matches, before)
    taken = F.aggregate(
        ordered,
        F.slice(matches, 1, 0),
        lambda out, m: F.when(F.exists(out, lambda o: (o["start_word"] < m["end_word"]) & (m["start_word"] < o["end_word"])), out).otherwise(F.concat(out, F.array(m))),
    )
    return F.array_sort(taken, lambda a, b: a["start_word"] - b["start_word"])


def _sign(x: Column) -> Column:
    return F.signum(x.cast("double")).cast("int")


def best_score(matches: Column) -> Column:
    """Highest score first; ties in generation order, `nth`."""
    return choose(matches, lambda a, b: F.when(a["score"] != b["score"], _sign(b["score"] - a["score"])).otherwise(a["nth"] - b["nth"]))


def longest_leftmost(matches: Column) -> Column:
    """Longer windows first, then from the left."""

    def before(a, b):
        la, lb = a["end_word"] - a["start_word"], b["end_word"] - b["start_word"]
        return F.when(la != lb, lb - la).otherwise(a["start_word"] - b["start_word"])

    return choose(matches, before)


def rebuild(text: Column, tokens: Column, chosen: Column, put) -> Column:
    """text unchanged without a match, else its words joined by blanks, with put(match, span text) for each chosen span.

    Words and matches are bound once a row: the lambdas name them again and again, and each naming would compute them anew.
    """

    def of(x: Column) -> Column:
        words, taken = x["words"], x["taken"]
        end_before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(taken, i - 1)["end_word"])
        span = lambda m: F.array_join(F.slice(words, m["start_word"] + 1, m["end_word"] - m["start_word"]), " ")
        pieces = F.transform(taken, lambda m, i: F.array_join(F.concat(F.slice(words, end_before(i) + 1, m["start_word"] - end_before(i)), F.array(put(m, span(m)))), " "))
        last = F.coalesce(F.try_element_at(taken, F.lit(-1))["end_word"], F.lit(0))
        rest = F.slice(words, last + 1, F.greatest(F.size(words) - last, F.lit(0)))
        return F.when(F.size(taken) == 0, text).otherwise(F.array_join(F.concat(pieces, rest), " "))

    return T.let(F.struct(tokens.alias("words"), chosen.alias("taken")), of)


def replace_spans(text: Column, tokens: Column, chosen: Column) -> Column:
    """text with labels for the chosen spans."""
    return rebuild(text, tokens, chosen, lambda m, _: m["label"])


def gloss(text: Column, tokens: Column, chosen: Column) -> Column:
    """text with each label in parentheses after its span."""
    return rebuild(text, tokens, chosen, lambda m, span: F.concat(span, F.lit(" ("), m["label"], F.lit(")")))
