"""Kinds of word errors against a full table of best alignments."""

import random

from clinispark.functions import alignment
from clinispark.operators import metrics
from clinispark.plans import catalog
from clinispark.plans import queries as _registered  # noqa: F401  fills the catalog
from test_queries import norm


def full(r, h):
    """Fewest edits, then most hits, by the whole table: (hits, subs, dels, ins)."""
    best = {}
    for i in range(len(r) + 1):
        for j in range(len(h) + 1):
            options = [] if i or j else [(0, 0, 0, 0, 0)]
            if i and j:
                e, n, s, d, x = best[i - 1, j - 1]
                options.append((e, n - 1, s, d, x) if r[i - 1] == h[j - 1] else (e + 1, n, s + 1, d, x))
            if i:
                e, n, s, d, x = best[i - 1, j]
                options.append((e + 1, n, s, d + 1, x))
            if j:
                e, n, s, d, x = best[i, j - 1]
                options.append((e + 1, n, s, d, x + 1))
            best[i, j] = min(options)
    e, n, s, d, x = best[len(r), len(h)]
    return -n, s, d, x


def test_kinds_equal_full_table():
    rng = random.Random(5)
    for _ in range(400):
        r, h = ([rng.choice("abcde") for _ in range(rng.randint(0, 12))] for _ in "rh")
        assert alignment.kinds(r, h) == full(r, h)
    pairs = [tuple([rng.choice("abcde") for _ in range(rng.choice([0, 1, 3, 30]))] for _ in "rh") for _ in range(300)]
    assert alignment.kinds_of(pairs) == [full(*p) for p in pairs]
    base = [rng.choice(["a", "b", "c", "d"]) + str(rng.randint(0, 50)) for _ in range(80)]
    for _ in range(10):
        h = [w for w in base if rng.random() > 0.1]
        h.insert(rng.randrange(len(h)), "new")
        assert alignment.kinds(base, h) == full(base, h)


def test_long_texts_take_linear_memory():
    r = [f"w{i % 900}" for i in range(20_000)]
    h = r[:5000] + ["x", "y"] + r[5003:]
    assert alignment.kinds(r, h) == (19_997, 2, 1, 0)


def test_error_kinds_of_documents(spark, tmp_path):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["One", "two,", "three", "four"]) for _ in range(rng.randint(0, 30)))) for i in range(30)] + [(30, None), (40, "alone")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    words = {i: norm(t or "").split() for i, t in docs}
    want = {i: full(words[i], words[i + 1]) for i in words if i + 1 in words}
    got = catalog.QUERIES["word_errors"](spark, str(tmp_path))
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
    sums = [sum(v[k] for v in want.values()) for k in range(4)]
    total = sum(sums[:3])
    assert tuple(catalog.QUERIES["word_error_split"](spark, str(tmp_path)).first()) == (*sums, *(round(x / total, 4) for x in sums[1:]))
    assert metrics.error_split(got.limit(0)).first().hits == 0


def test_many_pairs_share_their_steps(monkeypatch):
    # steps over numpy arrays are paid once for all pairs of like sizes; numbers are as small as the sizes allow
    rng = random.Random(6)
    pairs = [tuple([rng.choice("abcdef") for _ in range(20)] for _ in "rh") for _ in range(2000)]
    calls, inner = [], alignment._costs
    monkeypatch.setattr(alignment, "_costs", lambda p: calls.append(len(p)) or inner(p))
    assert alignment.kinds_of(pairs) == [full(*p) for p in pairs]
    assert sum(calls) == 2000 and len(calls) <= 4
    for n, m in ((125, 130), (127, 127), (128, 128), (129, 140), (1, 400), (180, 90)):  # around where 16 bits end
        r, h = ([rng.choice("ab") for _ in range(k)] for k in (n, m))
        assert alignment.kinds(r, h) == full(r, h)
        assert alignment.kinds(["x", *r[:-1], "y"], ["u", *r[:-1], "v"]) == full(["x", *r[:-1], "y"], ["u", *r[:-1], "v"])
    r = [f"w{i}" for i in range(33_000)]
    assert alignment.kinds(["x", *r, "y"], ["u", *r[:40], "v"]) == (40, 2, 32_960, 0)


def test_few_equal_words_are_chained(monkeypatch):
    # a table of all words is kept for pairs that share many; the others take the square of what they share
    rng = random.Random(8)
    words = [[f"{side}{i}" for i in range(200)] for side in "rh"]
    pairs = [tuple([rng.choice(["a", "b", *w * 0, *rng.sample(w, 12)]) for _ in range(rng.randint(0, 60))] for w in words) for _ in range(300)]
    pairs += [tuple(list(w) for w in words), ([], ["a"]), (["a", "x", "b"], ["y", "b", "z", "a"]), (["a"] * 9 + words[0], words[1] + ["a"] * 3)]
    cells, inner = [], alignment._costs
    monkeypatch.setattr(alignment, "_costs", lambda p: cells.append(sum(len(x) * len(y) for x, y in p)) or inner(p))
    assert alignment.kinds_of(pairs) == [full(*p) for p in pairs]
    assert sum(cells) < 0.3 * sum(len(r) * len(h) for r, h in pairs)
    for chain in (0, 1e9):  # all by chains, none by chains
        monkeypatch.setattr(alignment, "CHAIN", chain)
        assert alignment.kinds_of(pairs) == [full(*p) for p in pairs]


def test_texts_and_word_arrays_agree(spark):
    rows = [("a b  c", "b c d"), ("", "a"), (None, ""), (" ", None), ("\u092e\u0948 a", "a \u092e\u0948")]
    df = spark.createDataFrame(rows, "r string, h string").coalesce(1)
    want = [full(*[(x or "").split() for x in p]) for p in rows]
    names = ("hits", "substitutions", "deletions", "insertions")
    assert [tuple(r[n] for n in names) for r in metrics.error_kinds(df).collect()] == want
    arrays = df.selectExpr("filter(split(r, ' '), w -> w <> '') AS r", "filter(split(h, ' '), w -> w <> '') AS h")
    assert [tuple(r[n] for n in names) for r in metrics.error_kinds(arrays).collect()] == want
