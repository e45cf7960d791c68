"""Prefix sets against all pairs of tokens; JSON fields in every state."""

import random

from pyspark.sql import functions as F

from clinispark.functions import scores, variants


def test_prefix_sets_equal_all_pairs(spark):
    rng = random.Random(3)
    side = lambda: [rng.choice("ab") * rng.randint(1, 2) + "".join(rng.choice("ab") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 5))]
    rows = [(i, side(), side()) for i in range(400)] + [(400, ["ab", "ab"], ["ab"]), (401, [], ["x"]), (402, ["abc"], []), (403, ["ab"], ["abc"]), (404, ["naïve"], ["naï"])]
    df = spark.createDataFrame(rows, "id int, g array<string>, c array<string>").repartition(3)
    close = lambda g, c: g == c or len(g) >= 3 and len(c) >= 3 and (g.startswith(c) or c.startswith(g))
    want = {i: bool(g) and all(any(close(x, y) for y in c) for x in g) for i, g, c in rows}
    assert {r.id: r.v for r in df.select("id", scores.covered(F.col("g"), F.col("c")).alias("v")).collect()} == want and len(set(want.values())) == 2


def test_fields_in_every_state(spark):
    rows = [(0, '{"k": 5}'), (1, '{"k": null}'), (2, "{}"), (3, "not json"), (4, None), (5, '{"k": "five"}'), (6, '{"k": {"a": 1}}'), (7, "[1]")]
    df = spark.createDataFrame(rows, "id int, raw string")
    got = {r.id: (r.state, r.k) for r in df.select("id", variants.state(F.col("raw"), "$.k").alias("state"), variants.value(F.col("raw"), "$.k", "bigint").alias("k")).collect()}
    assert got == {0: ("value", 5), 1: ("null", None), 2: ("absent", None), 3: ("malformed", None), 4: ("malformed", None), 5: ("value", None), 6: ("value", None), 7: ("absent", None)}
    shapes = variants.shapes(df.where("id IN (0, 1, 2)"), "raw").first()
    assert shapes.n == 3 and shapes["shape"] == "OBJECT<k: BIGINT>"


def test_prefix_sets_only_where_first_tokens_match(spark, monkeypatch):
    # a row that its first tokens settle makes no prefixes: here making them would raise
    monkeypatch.setattr(scores, "prefixes", lambda tokens, least=3: F.transform(tokens, lambda t: F.raise_error(F.lit("prefixes")).cast("string")))
    rows = [(0, ["nothing", "abcd"], ["abcde", "x"]), (1, ["ab", "abcd"], ["abcde"]), (2, [], ["a"]), (3, ["q"], [])]
    df = spark.createDataFrame(rows, "id int, g array<string>, c array<string>").repartition(2)
    assert {r.id: r.v for r in df.select("id", scores.covered(F.col("g"), F.col("c")).alias("v")).collect()} == dict.fromkeys(range(4), False)
