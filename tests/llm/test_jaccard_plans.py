"""What the Jaccard join compares: pairs under index keys, in corpora of templates and in large families."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from clinispark.llm import jaccard_join as J


def templated(n, words, seed=7):
    """Documents of 14 out of 400 stock sentences; a few have a near copy."""
    rng = random.Random(seed)
    stock = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 3000)) for _ in range(rng.randint(*words))) for _ in range(400)]
    out = [" ".join(rng.sample(stock, 14)) for _ in range(n)]
    for i in range(0, n, 50):
        out[i + 1] = out[i] + " more"
    return [t.encode() for t in out]


def compared(texts, rare=J.RARE):
    """(pairs compared under index keys, blocks as lists of sets, sets) by the operator's own steps."""
    sets = {(*J.set_keys(s), len(s)): s for s in J.sets_of(texts)}
    keys, checks = (np.array([k[i] for k in sets], np.int64).astype(kind) for i, kind in ((0, np.uint64), (1, np.uint32)))
    sizes = np.array([len(s) for s in sets.values()])
    tokens, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    table = lambda rows, kind: J._rows(rows, kind)
    shared = J.shared_tokens(table(J._blobs(tokens[order], owner[order], keys, checks, sizes, 1), J.BLOB), 1)
    found = J.candidates(table(shared, J.BLOB), J.PERCENT, rare)
    edges, made = J.meetings(table(J.posted(table(found, J.CANDIDATE), 1), J.BLOB), J.PERCENT)
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for e in edges:
        label[root(e["a"])] = root(e["b"])
    blocks = collections.Counter(root(x) for x in list(label))
    return made, blocks, {k[0]: v for k, v in sets.items()}, [(e["a"], e["b"]) for e in edges]


@pytest.mark.parametrize("words", [(6, 12), (15, 25)])
def test_templates_make_no_large_block(words):
    made, largest = {}, {}
    for n in (2000, 4000, 8000):
        texts = templated(n, words)
        made[n], blocks, sets, edges = compared(texts)
        largest[n] = max(blocks.values())
        assert sum(c * c for c in blocks.values()) <= 8 * n  # what is verified grows with the documents
        joined = {frozenset(e) for e in edges}
        near = [(J.set_keys(a)[0], J.set_keys(b)[0]) for a, b in zip(*[iter(J.sets_of([t for i in range(0, n, 50) for t in texts[i : i + 2]]))] * 2, strict=True)]
        assert all(frozenset(p) in joined for p in near)
    assert max(largest.values()) <= 4
    assert all(m <= 4 * n for n, m in made.items())


@pytest.mark.parametrize("rare", [0, 2, 16])
def test_no_link_is_lost_under_keys(rare):
    rng = random.Random(rare)
    texts = []
    for _ in range(12):
        base = [rng.choice("abcdef") + str(rng.randint(0, 200)) for _ in range(rng.randint(8, 700))]
        for _ in range(rng.choice([1, 3, 90])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 40))):
                w[rng.randrange(len(w))] = "x" + str(rng.randint(0, 5))
            texts.append(" ".join(w[: len(w) - rng.randint(0, len(w) // 9)]).encode())
    _, _, sets, edges = compared(texts, rare)
    label = {k: k for k in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        label[root(a)] = root(b)
    plain = {k: set(v.tolist()) for k, v in sets.items()}
    for a in plain:
        for b in plain:
            if a < b and 100 * len(plain[a] & plain[b]) >= 80 * len(plain[a] | plain[b]):
                assert root(a) == root(b)


def test_a_family_is_reached_at_once():
    rng = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(600):
        w = list(base)
        w[rng.randrange(300)] = f"own{i}"
        texts.append(" ".join(w).encode())
    made, blocks, sets, _ = compared(texts)
    assert max(blocks.values()) == len(sets)
    assert made < 40 * 64 * len(sets)  # not the square of the family under each of its keys


def test_parities_never_part_similar_sets():
    rng = np.random.default_rng(4)
    for n in (4, 60, 63, 130, 520, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(1, 1 << 62, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.08], rng.integers(1, 1 << 62, rng.integers(0, n // 8 + 1), dtype=np.uint64)]))
            sizes = np.array([len(a), len(b)])
            maps = J.Maps(sizes, np.zeros(2, np.int64), np.concatenate([J.parities(a, len(a)), J.parities(b, len(b))]), 80)
            both = len(np.intersect1d(a, b))
            if 100 * both >= 80 * (len(a) + len(b) - both):
                assert maps.near(np.array([0]), np.array([1])).all() and maps.near(np.array([1]), np.array([0])).all()


def test_sets_that_clash_in_one_hash_stay_two(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(30 + i % 2)), 1) for i in range(8)] + [(8, "w0x0 " * 3, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    want = {tuple(r) for r in J.query(df).collect()}
    assert sum(r[3] for r in want) == 8

    one, two = np.unique(np.arange(10, dtype=np.uint64)), np.unique(np.arange(5, 15, dtype=np.uint64))
    keys, checks, sizes = np.array([7, 7], np.uint64), np.array([1, 2], np.uint64), np.array([10, 10])
    tokens, owner = np.concatenate([one, two]), np.repeat([0, 1], 10)
    order = np.argsort(tokens, kind="stable")
    shared = J.shared_tokens(J._rows(J._blobs(tokens[order], owner[order], keys, checks, sizes, 1), J.BLOB), 1)
    x = J.Opened(pa.Table.from_pylist(shared, schema=J._rows(shared, J.BLOB).schema), ascending=False)
    assert sorted(x.tokens.tolist()) == sorted([*range(5, 10)] * 2) and set(x.df.tolist()) == {2}
