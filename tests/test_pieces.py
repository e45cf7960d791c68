"""Ordered concatenation at two levels, and lexicons too wide to broadcast."""

import random

from pyspark.sql import functions as F

from clinispark.operators import roles
from clinispark.sources.tables import small


def test_texts_of_long_recordings_in_order(spark):
    rng = random.Random(4)
    rows = [(1, i, "DOCTOR" if i % 2 else "PATIENT", f"t{i}" if i % 7 else None) for i in range(30_000)] + [(2, 5, "DOCTOR", "b"), (2, -3000, "PATIENT", " a"), (3, 0, "DOCTOR", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "recording_id int, turn_idx int, speaker_role string, text string").repartition(4)
    want = {}
    for r, _, role, text in sorted(rows, key=lambda x: x[:2]):
        want.setdefault(r, []).extend([(role, text)] if text is not None else [])
    got = {r.recording_id: r.transcript for r in roles.transcripts(df).collect()}
    assert got == {r: "\n".join(f"[{role}]: {t}" for role, t in v) for r, v in want.items()}
    assert {r.recording_id: r.hypothesis for r in roles.hypotheses(df).collect()} == {r: " ".join(t for _, t in v).strip() for r, v in want.items()}


def test_a_million_turns_are_no_single_list(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("recording_id"), F.col("id").alias("turn_idx"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    out = roles.hypotheses(df).select(F.length("hypothesis").alias("n"), F.substring("hypothesis", 1, 8).alias("a"), F.expr("right(hypothesis, 7)").alias("b")).first()
    assert (out.n, out.a, out.b) == (sum(len(str(i)) for i in range(1_000_000)) + 2_000_000 - 1, "w0 w1 w2", "w999999")


def test_small_counts_bytes(spark):
    df = spark.range(20).select("id", F.repeat(F.lit("x"), 1000).alias("x"))
    hinted = lambda d: "hint" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(small(df)) and not hinted(small(df, size=10_000)) and not hinted(small(df, most=10))
