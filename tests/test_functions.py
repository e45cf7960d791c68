import difflib
import random

from pyspark.sql import functions as F

from clinispark.functions import fuzzy, scores, spans
from clinispark.functions import text as T
from clinispark.sources import lexicon


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(expr).first()[0]


def test_normalize_text(spark):
    assert one(spark, T.normalize_text(F.col("x")), x=" Hello,  WORLD।\n(ok) ") == "hello world ok"


def test_strip_fences(spark):
    for raw, bare in [("```json\n{}\n```", "{}"), ("{}", "{}"), ("``` \n{\n}", "{\n}"), ("  a ", "a")]:
        assert one(spark, T.strip_fences(F.col("x")), x=raw) == bare


def test_word_error_rate(spark):
    def wer(r, h):
        return one(spark, scores.word_error_rate(T.words(F.col("r")), T.words(F.col("h"))), r=r, h=h)

    assert abs(wer("a b c", "a x c") - 1 / 3) < 1e-12
    assert wer("", "x") == 1.0 and wer("", "") == 0.0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_edits_random(spark):
    rng = random.Random(3)
    pairs = [([rng.choice("abcde") for _ in range(rng.randint(0, 9))], [rng.choice("abcdef") for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    df = spark.createDataFrame(pairs, "r array<string>, h array<string>")
    for row in df.select("r", "h", scores.word_edits(F.col("r"), F.col("h")).alias("d")).collect():
        assert row.d == edits(row.r, row.h)


def test_ngrams_short(spark):
    got = one(spark, spans.ngrams(T.words(F.col("x")), 3), x="one two")
    assert [(g.span, g.start_word, g.end_word) for g in got] == [("one", 0, 1), ("two", 1, 2), ("one two", 0, 2)]


def greedy(ms):
    out = []
    for m in sorted(ms, key=lambda m: -m[3]):
        if not any(o[0] < m[1] and m[0] < o[1] for o in out):
            out.append(m)
    return sorted(out)


def test_best_score_random(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(80):
        ms = [(s := rng.randint(0, 8), s + rng.randint(1, 3), f"l{i}", rng.choice([0.5, 0.6, 0.9]), i) for i in range(rng.randint(0, 7))]
        rows.append((ms,))
    df = spark.createDataFrame(rows, f"m {spans.MATCH}")
    for row in df.select("m", spans.best_score(F.col("m")).alias("c")).collect():
        assert [tuple(c) for c in row.c] == [tuple(m) for m in greedy([tuple(m) for m in row.m])]


def test_gloss_keeps_other_words(spark):
    m = [(1, 3, "X", 0.9, 0)]
    df = spark.createDataFrame([("a b  c d", m), ("a  b", [])], f"t string, m {spans.MATCH}")
    got = [r[0] for r in df.select(spans.gloss(F.col("t"), T.words(F.col("t")), F.col("m"))).collect()]
    assert got == ["a b c (X) d", "a  b"]


def test_matching_ratio_is_not_symmetric(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string")
    got = [r[0] for r in df.select(fuzzy.matching_ratio("a", "b")).collect()]
    assert got == [difflib.SequenceMatcher(None, "tide", "diet").ratio(), difflib.SequenceMatcher(None, "diet", "tide").ratio()] and got[0] != got[1]


def test_itrans():
    assert fuzzy.itrans("नमस्ते") == "namaste" and fuzzy.itrans("ज़िंक") == "ziMka" and fuzzy.itrans("abc") == "abc"


def test_covered_and_jaccard(spark):
    def cov(g, c):
        return one(spark, scores.covered(T.words(F.col("g")), T.words(F.col("c"))), g=g, c=c)

    assert cov("usg abd", "usg of abdomen") and not cov("usg abd", "usg") and not cov("", "x")
    assert one(spark, scores.jaccard(F.split("a", " "), F.split("b", " ")), a="x y", b="y z") == 1 / 3


def test_frequency_order():
    assert len(lexicon.FREQUENCIES) == 55 and len({k for k, _ in lexicon.FREQUENCIES}) == 55
