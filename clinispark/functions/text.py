"""Text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All code points of white space.
SPACES = "\t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks that word scoring ignores, and marks stripped from a token's ends.
PUNCTUATION = ".,?!;:।॥\"'()[]{}"
EDGE = ".,?!।"
ROLE_WORDS = ("doctor", "patient", "unknown")


def strip(x: Column) -> Column:
    """x without white space at its ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blanked(x: Column, more: str = "") -> Column:
    """x with a blank for each white space, and for each character of `more`."""
    return F.translate(x, SPACES + more, " " * len(SPACES + more))


def collapse(x: Column, more: str = "") -> Column:
    """x with one blank for each run of white space and of `more`, none at its ends."""
    return F.trim(F.regexp_replace(blanked(x, more), " {2,}", " "))


def words(x: Column) -> Column:
    """Words between white space; none for null or blank text."""
    return F.filter(F.split(blanked(F.coalesce(x, F.lit(""))), " "), lambda w: w != "")


def normalize_text(x: Column) -> Column:
    """Lower case, punctuation to blanks, blanks collapsed."""
    return collapse(F.lower(x), PUNCTUATION)


def normalize_name(x: Column) -> Column:
    return collapse(F.lower(x))


def plain(x: Column) -> Column:
    """Lower case with everything but a-z, 0-9 and blanks deleted."""
    return F.regexp_replace(F.lower(strip(x)), "[^a-z0-9 ]", "")


def name_tokens(x: Column) -> Column:
    """Parts between white space, hyphens and slashes."""
    return F.filter(F.split(x, r"[\s\-/]+"), lambda t: t != "")


def has_devanagari(x: Column) -> Column:
    return F.coalesce(x.rlike(r"[\x{0900}-\x{097F}]"), F.lit(False))


def strip_fences(x: Column) -> Column:
    """A reply without the code fence around it."""
    s = strip(x)
    opened = F.regexp_replace(s, r"^[^\n]*(\n|$)", "")
    closed = F.regexp_replace(opened, r"(^|\n)[ \t\r]*```[^\n]*$", "")
    return F.when(s.startswith("```"), strip(closed)).otherwise(s)


def long_latin_tokens(x: Column) -> Column:
    """Distinct Latin tokens of 4 letters or more in lower case, without speaker tags."""
    found = F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)), F.lower)
    return F.array_except(F.filter(found, lambda t: F.length(t) >= 4), F.array(*map(F.lit, ROLE_WORDS)))


def first_quoted(x: Column) -> Column:
    """The first text in single quotes, else all of x."""
    return F.coalesce(F.nullif(F.regexp_extract(x, "'([^']+)'", 1), F.lit("")), x)


def falsy_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row, however often use names it, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
