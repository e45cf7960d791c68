"""Containment by trigrams against all pairs, and the plan of the drug tiers."""

import random

from clinispark.operators import drugs, substrings
from clinispark.plans import catalog
from clinispark.plans import queries as _registered  # noqa: F401  fills the catalog


def test_containments_equal_all_pairs(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    texts = [word(rng.randint(0, 14)) for _ in range(250)] + ["aaaaaaaa", "", None, "abab"] * 2
    patterns = [word(rng.randint(3, 6)) for _ in range(120)] + ["aaa", "ab", "", None, "zzz", "zaa"]
    a, b = spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")
    got = [tuple(r) for r in substrings.containments(a, b).collect()]
    want = {(t, p) for t in texts for p in patterns if t is not None and p is not None and len(p) >= 3 and p in t}
    assert len(got) == len(set(got)) and set(got) == want
    assert substrings.containments(a, b.limit(0)).count() == 0 and substrings.containments(a.limit(0), b).count() == 0


def test_tiers_meet_by_equality(spark):
    names = spark.createDataFrame([("paracetamol",), ("paracet",), ("xx paracetamol yy",), ("aspirin forte",), ("none",)], "name string")
    found = drugs.validate(names, spark.createDataFrame([("paracetamol",), ("aspirin",)], "drug string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {r.name: r.tier for r in found.collect()} == {"paracetamol": 1, "paracet": 3, "xx paracetamol yy": 3, "aspirin forte": 2, "none": None}
    plan = catalog.QUERIES["part_name_tier"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
