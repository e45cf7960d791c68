"""What built-in functions can't say: matching-block ratio and romanisation, as Arrow-batched functions."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

#: ITRANS letters of the Devanagari block. Consonants carry an inherent a; signs replace it.
CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहळ", "k kh g gh ~N ch Ch j jh ~n T Th D Dh N t th d dh n p ph b bh m y r l v sh Sh s h L".split(), strict=True))
VOWELS = dict(zip("अआइईउऊऋएऐओऔऑऍ", "a A i I u U RRi e ai o au A.c e.c".split(), strict=True))
SIGNS = dict(zip("ािीुूृेैोौॉॅ", "A i I u U RRi e ai o au A.c e.c".split(), strict=True))
MARKS = {"ं": "M", "ः": "H", "ँ": ".N", "ऽ": ".a"}
NUKTA = {"क": "q", "ख": "K", "ग": "G", "ज": "z", "ड": ".D", "ढ": ".Dh", "फ": "f", "य": "Y"}
DIGITS = {chr(0x966 + i): str(i) for i in range(10)}
VIRAMA, DOT, JOINERS = "्", "़", "‌‍"


def itrans(text: str) -> str:
    """ITRANS of the Devanagari in text; other characters pass."""
    out, s, i = [], "".join(c for c in unicodedata.normalize("NFD", text) if c not in JOINERS), 0
    while i < len(s):
        c = s[i]
        if c in CONSONANTS:
            i += 1
            dotted = i < len(s) and s[i] == DOT
            i += dotted
            out.append(NUKTA.get(c, CONSONANTS[c]) if dotted else CONSONANTS[c])
            if i < len(s) and s[i] == VIRAMA:
                i += 1
            elif i < len(s) and s[i] in SIGNS:
                out.append(SIGNS[s[i]])
                i += 1
            else:
                out.append("a")
            continue
        out.append(VOWELS.get(c) or MARKS.get(c) or DIGITS.get(c) or c)
        i += 1
    return "".join(out)


def _romanize(text: str) -> str:
    return re.sub("a$", "", itrans(text).lower().replace(".c", "").replace("ph", "f").replace("ai", "a"))


@pandas_udf(StringType())
def romanize(text: pd.Series) -> pd.Series:
    """Lower-case romanisation with English loan words in mind; null stays null."""
    return text.map(_romanize, na_action="ignore")


@pandas_udf(DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; not symmetric, the span is `a`."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def roman_key(r: Column) -> Column:
    """Spelling differences levelled: long vowels, doubled consonants, sh, and n after a final vowel."""
    for a, b in (("aa", "a"), ("ii", "i"), ("uu", "u")):
        r = F.replace(r, F.lit(a), F.lit(b))
    r = F.regexp_replace(r, "([bcdfghjklmnpqrstvwxyz])\\1", "$1")
    r = F.regexp_replace(r, "sh", "s")
    return F.trim(F.regexp_replace(r, "([aeiou])n$", "$1"))


def ratio_can_reach(a: Column, b: Column, least: float) -> Column:
    """Whether lengths allow the ratio: it is at most 2 min / (a + b)."""
    return 2.0 * F.least(F.length(a), F.length(b)) >= F.lit(least) * (F.length(a) + F.length(b))


def letters_can_reach(a: Column, b: Column, least: float) -> Column:
    """Whether the letters that both hold allow the ratio: matching blocks can't be longer than those."""
    count = lambda x, c: F.length(x) - F.length(F.replace(x, c, F.lit("")))
    common = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.least(count(a, c), count(b, c)))
    return 2.0 * common >= F.lit(least) * (F.length(a) + F.length(b))


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Composed form; null stays null."""
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")
