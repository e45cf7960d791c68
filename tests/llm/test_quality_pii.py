"""Fences that act on planted junk; personal data in a table, and in long texts without borders."""

import collections
import hashlib
import random
import time

import pytest
from test_llm import base_spans, prose

from clinispark.llm import pii, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string"


def clean(rng):
    """Prose with a symbol or a repeated line here and there."""
    words = [rng.choice("abcdefgh") * rng.randint(2, 7) + str(rng.randint(0, 10**5)) for _ in range(rng.randint(80, 160))]
    if rng.random() < 0.2:
        words[rng.randrange(len(words))] += "%"
    lines = [" ".join(words[k : k + 6]) for k in range(0, len(words), 6)]
    return "\n".join(lines + lines[:1] if rng.random() < 0.05 else lines)


def junk(kind, rng):
    words = clean(rng).split()
    if kind == "symbol_rate":
        return " ".join(w[:-3] + "#$%" if len(w) > 3 else w for w in words)
    if kind == "dup_line_rate":  # lines of few words, so that no window of 8 words comes twice
        lines = [" ".join(words[k : k + 2]) for k in range(0, 60, 2)]
        spare = iter(clean(rng).split())
        return "\n".join(x for line in lines for x in (line, f"{next(spare)} {next(spare)}", line))
    if kind == "repeat_rate":
        return " ".join(words + words[: len(words) // 6])  # a quarter of all words
    return " ".join(w * 3 for w in words)


@pytest.mark.parametrize("kind", list(quality_rules.METRICS))
@pytest.mark.parametrize("share", [3, 10, 30])
def test_planted_junk_goes_by_its_own_metric(spark, kind, share):
    rng = random.Random(share)
    rows = [(i, junk(kind, rng) if i % 100 < share else clean(rng), "en", f"s{i % 2}") for i in range(1000)]
    got = quality_rules.query(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    bad = {r.doc_id: r for r in got if r.doc_id % 100 < share}
    assert not any(r.base_failed for r in got)
    assert all(kind in r.over_fence.split(",") for r in bad.values())
    assert sum(r.kept for r in got if r.doc_id not in bad) >= 0.99 * (len(got) - len(bad))


def test_fences_part_junk_of_every_kind_at_once(spark):
    rng = random.Random(2)
    kinds = list(quality_rules.METRICS)
    rows = [(i, junk(kinds[i // 20 % 4], rng) if i % 20 == 0 else clean(rng), "en", "s") for i in range(1200)]
    x = quality_rules.measured(spark.createDataFrame(rows, SCHEMA).select("text", "lang", "source")).cache()
    limits = quality_rules.fences(quality_rules.sketches(x)).collect()
    top = x.selectExpr(*[f"max({a} / greatest({b}, 1)) AS {m}" for m, (a, b) in quality_rules.METRICS.items()]).first()
    assert len(limits) == 1 and all(0 < r[f"max_{m}"] < top[m] for r in limits for m in kinds)
    x.unpersist()


def test_pii_of_a_table(spark):
    rng = random.Random(12)
    texts = [None, "", "é😀 a@b.co.uk, +44 (20) 7946-0958 😀 4111 1111 1111 1111 and 10.0.0.255", "1.2.3.4.5.6.7.8 a@b a@b.c @ 300.1.1.1"]
    texts += ["".join(rng.choice("a1.@+-( )%9é\n") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    rows = [(i if i % 9 else None, t, 1, "x") for i, t in enumerate(texts)] * 2
    found = collections.Counter()
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string, n_ip int, spans string").repartition(3)).collect():
        base = [s for s in r.spans.split(",") if s and s.split(":")[0] in pii.KINDS[:4]]
        assert r.n_spans == len([s for s in r.spans.split(",") if s])
        found[r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, ",".join(base)] += 1
    want = collections.Counter()
    for i, t, *_ in rows:
        spans = base_spans(t or "")
        kinds = collections.Counter(s.split(":")[0] for s in spans.split(",") if s)
        want[i, *(kinds[k] for k in pii.KINDS[:4]), hashlib.sha256(spans.encode()).hexdigest(), spans] += 1
    assert found == want


@pytest.mark.parametrize("cue", [*pii.SCHEMES, *pii.CUES, *pii.ASSIGNED, *pii.KEYS, "@", "+1", "1.", "11", "a@a", "1-", "+1(", "a@b.", 'token="', "iban de", "1 "])
def test_pii_takes_time_in_proportion(cue):
    found = pii.automaton()
    for text in (("x" + cue) * ((1 << 20) // (len(cue) + 1)), cue * ((1 << 20) // len(cue))):
        began = time.process_time()
        pii.spans(text, found)
        assert time.process_time() - began < 8, cue


def test_prose_has_no_personal_data():
    assert not any(pii.spans(prose(200), pii.automaton()).values())
