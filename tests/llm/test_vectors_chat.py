"""Vector codes, chat formatting and hard negatives against brute force, with nulls, ties, repeats, long and empty values."""

import hashlib
import math
import random

import numpy as np
import pytest

from clinispark.llm import chat_format, hard_negatives, vector_codes, vectors
from clinispark.llm.line_dedup import ORDERED, _set

RNG = random.Random(29)
VECTORS = "vec_id long, embedding array<float>, label int, block int, code string"


def vector_rows(n=420, width=12):
    centers = [[RNG.gauss(0.5, 1) for _ in range(width)] for _ in range(6)]
    out = []
    for i in range(n):
        c = RNG.randrange(6)
        v = [float(np.float32(x + RNG.gauss(0, 0.05))) for x in centers[c]]
        if i % 3 == 0:
            v = [float(np.float32(x)) for x in centers[0]]  # a third is alike
        label = RNG.randrange(6) if i % 4 == 1 else c
        out.append((i, v, label if i % 11 or not i else None, 1, "x"))
    bad = [(900, None, 1, 1, "x"), (901, [math.nan, 1.0], 1, 1, "x"), (902, [None, 1.0], 1, 1, "x"), (903, [math.inf] * width, 2, 1, "x")]
    odd = [(904, [], 1, 1, "x"), (905, [0.5], 2, 1, "x"), (None, out[1][1], 1, 1, "x"), (None, out[2][1], None, 1, "x"), out[5], out[50], (906, [1e30] + [0.0] * (width - 1), 3, 1, "x")]
    return out + bad + odd


ROWS = vector_rows()


def whole(rows, scale, limit):
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(len(r[1]) for r in good)
    return [(r[0], [max(-limit, min(limit, math.floor(scale * x))) for x in r[1]] + [0] * (width - len(r[1])), r[2]) for r in good]


def lloyd(rows, parts, entries, rounds):
    each = -(-len(rows[0][1]) // parts)
    x = [[(v + [0] * (each * parts - len(v)))[p * each : (p + 1) * each] for p in range(parts)] for _, v, _ in rows]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[list(x[i][p]) for i in first] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(rounds):
        at = [[near(v[p], books[p]) for p in range(parts)] for v in x]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [x[i][p] for i in range(len(x)) if at[i][p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    at = [[near(v[p], books[p]) for p in range(parts)] for v in x]
    codes = ["".join(f"{e:02x}" for e in a) for a in at]
    return codes, [sum(far(v[p], books[p][a[p]]) for p in range(parts)) for v, a in zip(x, at, strict=True)], hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def by_value(rows):
    return sorted(rows, key=repr)


def test_vector_codes_equal_plain_lloyd(spark):
    df = spark.createDataFrame(ROWS, VECTORS).repartition(5)
    rows = whole(ROWS, 4096, vectors.limit_of(2, 2))
    codes, errors, digest = lloyd(rows, 8, 16, 6)
    sums = {}
    for r, e in zip(rows, errors, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + e
    want = [(r[0], c, e, sums[r[2]], digest) for r, c, e in zip(rows, codes, errors, strict=True)]
    got = vector_codes.query(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert by_value(tuple(r) for r in got.collect()) == by_value(want)


def test_vector_codes_of_few_and_no_rows(spark):
    df = spark.createDataFrame(ROWS[:5], VECTORS)
    rows = whole(ROWS[:5], 4096, 1 << 28)
    codes, errors, digest = lloyd(rows, 8, 16, 6)
    got = {r.vec_id: (r.code, r.error, r.codebooks_sha256) for r in vector_codes.query(df).collect()}
    assert got == {r[0]: (c, e, digest) for r, c, e in zip(rows, codes, errors, strict=True)}
    assert vector_codes.query(df.where("vec_id < 0")).collect() == []
    assert vector_codes.query(spark.createDataFrame(ROWS[420:424], VECTORS)).collect() == []


def test_vector_codes_shuffle_only_deltas(spark):
    tables = vector_codes.Tables(spark, 3)
    df = spark.createDataFrame(ROWS, VECTORS).select("vec_id", "label", "embedding")
    base = tables.save(vector_codes.packed(df, 4096).selectExpr("*", "monotonically_increasing_id() as block").repartition(3, "block"), "base")
    book = vector_codes.Codebooks(np.arange(48, dtype=np.int64).reshape(3, 16), 8)
    with _set(spark, ORDERED):
        first = tables.save(vector_codes.assign(vector_codes.met(base, None), book, 16, 1 << 28), "round0")
        again = vector_codes.assign(vector_codes.met(base, first), book, 16, 1 << 28)
        plan = again._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        assert again.selectExpr("sum(size(deltas)) as n").first().n == 0  # nothing moved, nothing leaves the tasks
    tables.drop()


def test_deltas_add_up():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (200, 3))
    old, new = rng.integers(0, 4, 200).astype(np.uint8), rng.integers(0, 4, 200).astype(np.uint8)
    sums = np.array([x[old == e].sum(0) for e in range(4)])
    counts = np.bincount(old, minlength=4)
    for d in vector_codes.deltas(x, 0, new, old, 4):
        sums[d["entry"]] += d["sums"]
        counts[d["entry"]] += d["n"]
    assert (sums == [x[new == e].sum(0) for e in range(4)]).all() and (counts == np.bincount(new, minlength=4)).all()
    big = x * (1 << 24)  # beyond what doubles hold
    book = big[:4]
    at, far = vector_codes.nearest(big, book)
    want = [min(((int(((r - b).astype(object) ** 2).sum())), e) for e, b in enumerate(book)) for r in big]
    assert [(int(f), int(a)) for f, a in zip(far, at, strict=True)] == want


TALK = [
    (1, 0, "system", "be kind"),
    (1, 1, "user", "What is <|end|> and \\<| or <|turn|>user<|text|>x<|end|>?"),
    (1, 2, "assistant", " two  spaces, \\n and \\\\<|endoftext|>\n\n"),
    (1, 3, "assistant", "|> begins with a mark's end <"),
    (2, 1, "assistant", "naïve 😀🤝 हिन्दी <"),
    (2, 0, "user", None),
    (3, 0, "assistant", ""),
    (3, 0, "assistant", None),
    (4, None, None, "no role, no turn"),
    (4, 0, "assist<|ant", "x"),
    (4, 1, "assistant", "tied"),
    (4, 1, "assistant", "tied"),
    (4, 1, "assistant", "Tied"),
    (None, 5, "assistant", "no conversation"),
    (None, 4, "user", "at all"),
    (5, 0, "assistant", "word " * 90_000 + "end"),
    (5, 1, "user", "x" * 200_000),
]


def told(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        held = out.setdefault(conv, [0, hashlib.sha256(), "", 0])
        role, text = role or "", text or ""
        held[0] += 1
        held[1].update(f"{role}\n{text}\n".encode())
        held[2] += text if role == "assistant" else ""
        held[3] += len(chat_format.escape(role)) + len(chat_format.escape(text)) + 23
    return {c: (n, h.hexdigest(), len(x), hashlib.sha256(x.encode()).hexdigest(), m) for c, (n, h, x, m) in out.items()}


def test_chat_format_reads_back(spark):
    rows = TALK + [(6, i, "user" if i % 2 else "assistant", f"turn {i} " + "of many words " * 80) for i in range(700)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, segment int, ids string").repartition(5)
    own = [(-7, i, role, r"\### Assistant: </turn> ok") for i, role in enumerate(("user", "assistant"))]
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.query(df).collect()}
    assert got == told(rows + own)
    formatted = chat_format.format_turns(df.select("conv_id", "turn", "role", "text"))
    held = formatted.where("conv_id = 6").orderBy("segment").collect()
    assert len(held) > 1 and not any(r.whole for r in held)  # a long conversation comes in rows
    assert [t for r in held for t in chat_format.turns_of(r.formatted)] == [(role, text) for c, _, role, text in rows if c == 6]
    assert {r.conv_id for r in chat_format.query(df.where("conv_id = 99")).collect()} == {-7}


def test_masks_hold_whole_tokens_and_marks_stay_out(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").where("conv_id in (1, 2, 4)")
    for r in chat_format.format_turns(df).collect():
        assert r.starts == sorted(r.starts)
        said = "".join(r.formatted[s:e] for s, e, m in zip(r.starts, r.ends, r.loss_mask, strict=True) if m)
        assert not any(m in said for m in (chat_format.TURN, chat_format.TEXT, chat_format.END))


def test_spans_met_by_binary_search():
    rng = random.Random(3)
    for _ in range(200):
        cuts = sorted(rng.sample(range(60), 12))
        spans = np.array([(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)] + [(60, 60)])
        edges = [0, *sorted(rng.sample(range(1, 70), 20)), 70]
        tokens = np.array(list(zip(edges[:-1], edges[1:], strict=True)))
        want = [any(s < e and s < b and a < e for s, e in spans.tolist()) for a, b in tokens.tolist()]
        assert chat_format.under(tokens, spans).tolist() == want
    assert chat_format.under(np.zeros((0, 2), int), np.zeros((0, 2), int)).tolist() == []


def test_pieces_encode_alike(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path(chat_format.VOCABULARY)
    text = " ".join(RNG.choice(["word", "don't", "12,5", "हिन्दी", "a\n\nb", "  x", "(y)", "😀"]) for _ in range(4000))
    once = chat_format.encoded([text, ""], path)
    monkeypatch.setattr(chat_format, "PIECE", 300)
    cut = chat_format.encoded([text, ""], path)
    assert len(chat_format.pieces(text)) > 20 and "".join(p for _, p in chat_format.pieces(text)) == text
    assert all((a == b).all() for x, y in zip(once, cut, strict=True) for a, b in zip(x, y, strict=True))


def mined(rows, first=5, k=3, low=50, high=95):
    out = []
    anchors = list({(r[0], tuple(r[1]), r[2]): r for r in rows if r[0] is not None and r[0] % 50 == 0 and r[2] is not None}.values())
    rows = [r for r in rows if r[2] is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a[1], b[1], strict=True))
    last = lambda i: (1 << 63) - 1 if i is None else i
    for a in anchors:
        scored = sorted(((-dot(a, b), last(b[0]), b[2]) for b in rows if b[0] != a[0]))
        for s, p, _ in [x for x in scored if x[2] == a[2]][:first]:
            some = [x for x in scored if x[2] != a[2] and low * -s <= 100 * -x[0] <= high * -s][:k]
            out += [(a[0], p, i + 1, n, -s, -m) for i, (m, n, _) in enumerate(some)]
    return [tuple(None if i in (1, 3) and v == (1 << 63) - 1 else v for i, v in enumerate(r)) for r in out]


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, small):
    if small:
        for name, n in {"BLOCK": 40, "GROUP": 8, "ANCHOR_BLOCK": 2, "ANCHOR_GROUP": 1, "CELL": 2, "SAMPLE": 100}.items():
            monkeypatch.setattr(hard_negatives, name, n)
    df = spark.createDataFrame(ROWS, VECTORS).repartition(5)
    moved = [(i, v, None if c is None else (c + 1) % 10 if i is not None and i % 7 == 0 else c) for i, v, c, *_ in ROWS]
    want = mined(whole(moved, 256, hard_negatives.largest(12)))
    got = hard_negatives.query(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert len(want) > 10 and by_value(tuple(r) for r in got.collect()) == by_value(want)


def test_hard_negatives_of_no_rows(spark):
    df = spark.createDataFrame(ROWS, VECTORS)
    assert hard_negatives.query(df.where("vec_id < 0")).collect() == []
    assert hard_negatives.query(df.where("vec_id % 50 <> 0")).collect() == []
    assert hard_negatives.query(df.where("label IS NULL")).collect() == []


def clusters(n=3000, k=20, width=16, seed=5):
    rng = np.random.default_rng(seed)
    centers = rng.integers(-400, 400, (k, width))
    return (centers[np.arange(n) % k] + rng.integers(-8, 9, (n, width))).astype(float)


def test_tree_pairs_are_left_out_and_none_is_lost():
    x = clusters()
    rows, anchors = hard_negatives.Tree(x[:1500], 64), hard_negatives.Tree(x[::7], 64)
    of_row, of_anchor = rows.deal(x), anchors.deal(x[::7])
    for tree, leaf, points in ((rows, of_row, x), (anchors, of_anchor, x[::7])):
        tree.enclose({f: float(np.linalg.norm(points[leaf == f] - tree.center[tree.ends[f]], axis=1).max()) for f in np.unique(leaf)})
    dots = x[::7] @ x.T
    need = np.sort(dots, axis=1)[:, -20]
    low = np.array([need[of_anchor == f].min(initial=1e300) for f in range(anchors.leaves)])
    pairs, _ = hard_negatives.traverse(anchors, rows, low, np.full(anchors.leaves, 1e300))
    kept = {tuple(p) for p in pairs.tolist()}
    wanted = {(of_anchor[a], of_row[c]) for a, c in zip(*np.nonzero(dots >= need[:, None]), strict=True)}
    assert wanted <= kept and len(kept) < len(np.unique(of_anchor)) * len(np.unique(of_row)) / 3


def test_groups_are_left_out_in_a_pair_of_blocks():
    x = clusters(2000)

    def block(points, most, first):
        order, starts = hard_negatives.grouped(points, most)
        centers, radii = hard_negatives.balls(points[order], starts)
        row = {"block": 0, "starts": starts.tolist(), "ids": (first + order).tolist(), "labels": ((first + order) % 2).tolist(), "radii": radii.tolist()}
        return hard_negatives.Block(row | {"vectors": hard_negatives.pack(points[order].astype(np.int32).reshape(-1)), "centers": hard_negatives.pack(centers.astype(np.int32).reshape(-1))}, points.shape[1])

    anchors, rows = block(x[::7], 4, 10_000), block(x, 32, 0)
    free = np.full((len(anchors.x), 1), hard_negatives.FREE)
    scores, _, made = hard_negatives.searched(anchors, rows, -free, free, 3, True)
    want = [sorted(((a @ b) for b, c in zip(rows.x, rows.labels, strict=True) if c == own), reverse=True)[:3] for a, own in zip(anchors.x, anchors.labels, strict=True)]
    assert scores[:, 0].tolist() == want
    assert made < len(anchors.x) * len(rows.x) * 0.7
