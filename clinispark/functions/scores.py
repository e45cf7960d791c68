"""Similarities and error rates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clinispark.functions import text as T


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Word Levenshtein distance: each distinct word becomes one character, then the built-in distance.

    Words of one side only can't match, so each side has one character for all of them; shared words take theirs from
    U+10001 on. More than 1,048,575 distinct shared words a pair fail instead of giving a wrong distance.
    """
    letter = lambda at: F.decode(F.unhex(F.lpad(F.hex(at + 65536), 8, "0")), "UTF-32")
    code = lambda ws, known, alone: F.array_join(F.transform(F.transform(ws, lambda w: F.array_position(known, w)), lambda at: F.when(at == 0, alone).otherwise(letter(at))), "")
    sides = F.struct(reference.alias("r"), hypothesis.alias("h"), F.array_intersect(reference, hypothesis).alias("known"))
    return T.let(sides, lambda x: F.levenshtein(code(x["r"], x["known"], "r"), code(x["h"], x["known"], "h"))).cast("long")


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits by reference words; of an empty reference 0 if the hypothesis is empty too, else 1."""
    empty = F.when(F.size(hypothesis) == 0, 0.0).otherwise(1.0)
    return F.when(F.size(reference) == 0, empty).otherwise(word_edits(reference, hypothesis) / F.size(reference))


def rate(part: Column, whole: Column, digits: int, empty: float | None = 0.0) -> Column:
    """part / whole, rounded; `empty` where whole is not positive."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(empty).cast("double"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty. The union is counted from the two sizes, not built."""
    sides = F.struct(F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_distinct(a)).alias("a"), F.size(F.array_distinct(b)).alias("b"))
    return T.let(sides, lambda x: F.when((x["a"] == 0) | (x["b"] == 0), 0.0).otherwise(x["both"] / (x["a"] + x["b"] - x["both"])))


def prefixes(tokens: Column, least: int = 3) -> Column:
    """Distinct beginnings of `least` characters or more of all tokens, whole ones among them."""
    cuts = lambda t: F.when(F.length(t) >= least, F.transform(F.sequence(F.lit(least), F.length(t)), lambda n: F.substr(t, F.lit(1), n))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(tokens, cuts)))


#: Tokens that are held against all candidates before sets of prefixes are made.
FIRST = 8


def covered(gold: Column, candidate: Column, least: int = 3) -> Column:
    """Each gold token equals a candidate token, or one begins the other and both have `least` characters.

    Sets of prefixes decide, so the work grows with the tokens and not with pairs of them: gold tokens that are candidates or
    begin one fall out; for the others, only candidates among their own prefixes are looked at. Before that, the first FIRST
    tokens that are no candidates are held against all candidates: one without a match settles the row.
    """
    sides = F.struct(candidate.alias("c"), F.array_except(gold, candidate).alias("rest"))
    long = lambda t: F.length(t) >= least
    first = lambda x: F.forall(F.slice(x["rest"], 1, FIRST), lambda g: long(g) & F.exists(x["c"], lambda c: (c.startswith(g) | g.startswith(c)) & long(c)))
    left = lambda x: F.struct(x["c"].alias("c"), F.array_except(x["rest"], prefixes(x["c"], least)).alias("rest"))
    held = lambda x: F.struct(x["rest"].alias("rest"), F.array_intersect(prefixes(x["rest"], least), x["c"]).alias("begins"))
    all_begun = lambda y: F.forall(y["rest"], lambda g: F.exists(y["begins"], lambda p: g.startswith(p)))
    whole = lambda x: T.let(T.let(left(x), held), all_begun)
    return (F.size(gold) > 0) & T.let(sides, lambda x: F.when(first(x), whole(x)).otherwise(False))


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles: the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
