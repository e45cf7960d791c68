"""Registered queries against brute force over whole texts and tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from clinispark.functions import scores
from clinispark.functions import text as T
from clinispark.operators import concepts, metric_index
from clinispark.plans import catalog
from clinispark.plans import queries as _registered  # noqa: F401  fills the catalog
from test_functions import edits


@pytest.fixture
def sf(spark, tmp_path):
    """Writes named tables, (rows, schema) each, and gives their folder."""

    def put(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return put


def norm(x):
    return " ".join(x.lower().translate(str.maketrans(T.PUNCTUATION, " " * len(T.PUNCTUATION))).split())


def test_wer_of_whole_turns(spark, sf):
    same = " ".join(f"w{i % 50}" for i in range(90))
    turns = [(1, 0, "a", same + " Tail, one."), (1, 1, "b", same + " other end here"), (1, 2, "a", "short"), (2, 0, "a", "no next"), (3, 0, "a", ""), (3, 1, "b", "x")]
    at = sf(conversations=(turns, "conv_id long, turn long, role string, text string"))
    words = {(c, t): norm(x).split() for c, t, _, x in turns}
    pairs = {k: (r, words[k[0], k[1] + 1]) for k, r in words.items() if (k[0], k[1] + 1) in words}
    want = {k: round(edits(r, h) / len(r), 6) if r else float(bool(h)) for k, (r, h) in pairs.items()}
    assert {(r.conv_id, r.turn): r.wer for r in catalog.QUERIES["wer_pairs"](spark, at).collect()} == want
    total, n = sum(edits(r, h) for r, h in pairs.values() if r), sum(len(r) for r, _ in pairs.values())
    assert tuple(catalog.QUERIES["corpus_wer"](spark, at).first()) == (total, n, round(total / n, 4))


def test_word_edits_of_many_words(spark):
    r, h = [f"w{i}" for i in range(36000)], ["x", "w35998", "w35999", "y"]
    more = ["w35999", "z"] + [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(r, h), (h, r), (r, more)], "r array<string>, h array<string>")
    assert [x.d for x in df.select(scores.word_edits(F.col("r"), F.col("h")).alias("d")).collect()] == [edits(r, h), edits(h, r), edits(r, more)]


def vectors():
    rng = random.Random(7)
    rows = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(230)]
    rows += [rows[3], rows[3], rows[150], [-x for x in rows[3]]]
    unit = [[x / math.sqrt(sum(y * y for y in v)) for x in v] for v in rows]
    return [(i, v, i % 40) for i, v in enumerate(unit)]


def test_vectors_against_all_others(spark, sf, monkeypatch):
    monkeypatch.setattr(metric_index, "BLOCK", 50)
    monkeypatch.setattr(metric_index, "CELL", 30)
    monkeypatch.setattr(concepts, "SLICE", 16)
    rows = vectors()
    at = sf(embeddings=(rows, "vec_id long, embedding array<double>, label int"))
    dot = {(i, j): sum(x * y for x, y in zip(a, b, strict=True)) for i, a, _ in rows for j, b, _ in rows}
    label = {i: c for i, _, c in rows}
    best = {i: max((dot[i, j], -j) for j in label if j != i) for i in label}
    want = {(i, -j, label[-j], round(s, 6)) for i, (s, j) in best.items()}
    got = {n: {tuple(r) for r in catalog.QUERIES[n](spark, at).select("span_id", "ref_idx", "concept_idx", "similarity").collect()} for n in ("nn_concept", "threshold_match")}
    assert got["nn_concept"] == want and got["threshold_match"] == {w for w in want if w[3] >= 0.3}
    least = {}
    for i, j, c, s in got["threshold_match"]:
        neg = max((dot[i, k] for k in label if label[k] == c and k not in (i, j)), default=None)
        if neg is None or neg < s - 0.05:
            least[i] = neg if neg is None else round(neg, 6)
    assert {r.span_id: r.max_negative for r in catalog.QUERIES["hardneg_gate"](spark, at).collect()} == least and 0 < len(least) < len(want)


def test_keywords_and_cover_of_whole_documents(spark, sf):
    far = "filler words " * 30
    texts = [far + "Needle one, here.", far + "needle ONE here and second thing", "second thing", far + "zeta", "filler words zeta words", "zet fill word", ""]
    items = [(0, "needle one here"), (1, "Second thing."), (2, "zeta"), (3, "absent")]
    at = sf(documents=(list(enumerate(texts)), "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    keys, want = [norm(k) for _, k in items], {}
    for i, x in enumerate(texts):
        there = [k for k in keys if k in norm(x)]
        hyp = norm(texts[i + 1]) if i + 1 < len(texts) else ""
        want[i] = (len(there), sum(k not in hyp for k in there))
    assert {r.doc_id: (r.present, r.missed) for r in catalog.QUERIES["keyword_hits"](spark, at).collect()} == want
    assert {r.doc_id: r.keyword_wer for r in catalog.QUERIES["keyword_wer"](spark, at).collect()} == {i: round(m / p, 4) if p else 0.0 for i, (p, m) in want.items()}
    p, m = (sum(x) for x in zip(*want.values(), strict=True))
    assert tuple(catalog.QUERIES["micro_rates"](spark, at).first()) == (p, m, round(m / p, 4))
    words = [["".join(c for c in w if c.isascii() and c.isalnum()) for w in x.lower().split()] for x in texts]
    near = lambda g, c: g == c or (min(len(g), len(c)) >= 3 and (g.startswith(c) or c.startswith(g)))
    cover = {i: bool(a) and all(any(near(g, c) for c in b) for g in a) for i, (a, b) in enumerate(zip(words, words[1:]))}
    assert {r.doc_id: r.covered for r in catalog.QUERIES["prefix_cover"](spark, at).collect()} == cover and any(cover.values())


def test_cover_needs_every_word(spark, sf):
    at = sf(documents=([(0, "a b c d e f zeta"), (1, "a b c d e f"), (2, "f e d c b a zetas zeta")], "doc_id long, text string"))
    assert {r.doc_id: r.covered for r in catalog.QUERIES["prefix_cover"](spark, at).collect()} == {0: False, 1: True}
