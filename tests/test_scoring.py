from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeframe.functions import scoring
from gradeframe.functions.fuzzy import lcs_length, token_set_ratio, with_token_set_ratio
from pyspark.sql import functions as F


def slow_lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for ch in a:
        new = [0]
        for j, other in enumerate(b, 1):
            new.append(row[j - 1] + 1 if ch == other else max(row[j], new[-1]))
        row = new
    return row[-1]


def slow_ratio(a: str, b: str) -> float:
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    both, x, y = " ".join(sorted(ta & tb)), " ".join(sorted(ta - tb)), " ".join(sorted(tb - ta))
    if both and (not x or not y):
        return 100.0

    def ratio(p, q):
        return 100.0 * 2 * slow_lcs(p, q) / (len(p) + len(q))

    full_a, full_b = f"{both} {x}".strip(), f"{both} {y}".strip()
    # Shared tokens come first in both strings and count as matched.
    gap = len(both) + (1 if both else 0)
    best = 100.0 * 2 * (gap + slow_lcs(x, y)) / (len(full_a) + len(full_b))
    return max(best, ratio(both, full_a), ratio(both, full_b)) if both else best


@settings(max_examples=300, deadline=None)
@given(st.text("abé ", max_size=40), st.text("abé ", max_size=40))
def test_lcs_matches_the_table(a, b):
    assert lcs_length(a, b) == slow_lcs(a, b) == lcs_length(b, a)


def test_lcs_of_long_texts():
    rng = random.Random(1)
    a = "".join(rng.choice("abcd ") for _ in range(900))
    b = "".join(rng.choice("abcd ") for _ in range(1100))
    assert lcs_length(a, b) == slow_lcs(a, b)


def sentences(n, seed=3):
    rng = random.Random(seed)
    vocabulary = "bank rate rises falls within ten days after notice été 30 5 of the".split()
    return [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 7))), " ".join(rng.choices(vocabulary, k=rng.randint(0, 7)))) for _ in range(n)]


@pytest.mark.parametrize("a, b, expected", [("a b", "b a", 100.0), ("a b", "a b c", 100.0), ("", "a", 0.0), ("abc", "abd", 66.666667)])
def test_ratio_vectors(spark, a, b, expected):
    got = token_set_ratio(spark.createDataFrame([(a, b)], "a string, b string"), "a", "b").first()["ratio"]
    assert got == pytest.approx(expected, abs=1e-6)


def test_ratio_matches_brute_force_and_is_symmetric(spark):
    data = sentences(400)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(data)], "i int, a string, b string")
    got = {r["i"]: r["ratio"] for r in token_set_ratio(df, "a", "b").collect()}
    back = {r["i"]: r["ratio"] for r in token_set_ratio(df, "b", "a").collect()}
    for i, (a, b) in enumerate(data):
        assert got[i] == pytest.approx(slow_ratio(a, b), abs=1e-9), (a, b)
        assert got[i] == back[i]


@pytest.mark.parametrize("cutoff", [0.5, 0.72, 0.9])
def test_cutoff_keeps_the_side(spark, cutoff):
    data = sentences(400, seed=9)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(data)], "i int, a string, b string")
    got = {r["i"]: r["x"] for r in with_token_set_ratio(df, "a", "b", "x", cutoff=cutoff).collect()}
    for i, (a, b) in enumerate(data):
        assert (got[i] / 100.0 >= cutoff) == (slow_ratio(a, b) / 100.0 >= cutoff), (a, b)


CASES = [
    # reference, prediction, task, strict, strict_nocbd, demo, lenient, containment, fuzzy
    ("Yes", "yes, because", "contradiction_detection", 1, 1, 1, 1, 1, 1),
    ("No", "Yes", "contradiction_detection", 0, 0, 0, 0, 0, 0),
    ("maybe", "maybe", "contradiction_detection", 1, 1, 0, 1, 1, 1),
    ("30 days", "about 30 in all", "numerical_reasoning", 1, 1, 1, 1, 0, 1),
    ("abc", "FAIL: timeout", "temporal_reasoning", 0, 0, 0, 0, 0, 0),
    ("it cannot be determined", "it cannot be determined", "temporal_reasoning", 0, 1, 0, 1, 1, 1),
    ("alpha beta", "gamma delta", "regulatory_interpretation", 0, 0, 0, 0, 0, 0),
    ("alpha", "", "regulatory_interpretation", 0, 0, 0, 0, 0, 0),
]


@pytest.mark.parametrize("position, policy", list(enumerate(["strict", "strict_nocbd", "demo", "lenient", "containment", "fuzzy"])))
def test_policies(spark, position, policy):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, reference string, prediction string, task string")
    got = {r["i"]: r["correct"] for r in scoring.score(df, policy).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[3 + position] for c in CASES]


def test_variants_come_first(spark):
    df = spark.createDataFrame([("x1", ["totally different"], "Totally different!", "temporal_reasoning")], "reference string, v array<string>, prediction string, task string")
    assert scoring.score(df, "demo", variants="v").first()["correct"] == 1


def test_unknown_policy(spark):
    with pytest.raises(ValueError, match="unknown policy"):
        scoring.score(spark.createDataFrame([("a", "b", "c")], "reference string, prediction string, task string"), "other")


def test_stages(spark):
    data = [("a b", "A b!", "t", "exact"), ("Yes", "Yes sir", "contradiction_detection", "yn"), ("Yes", "No sir", "contradiction_detection", "yn_miss"),
            ("5 days", "it is 5", "t", "numerical"), ("alpha beta gamma", "gamma beta", "t", "fuzzy"), ("abc", "xyz", "t", "incorrect")]
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(data)], "i int, reference string, prediction string, task string, want string")
    for r in scoring.score_with_stage(df).collect():
        assert r["stage"] == r["want"]
        assert r["correct"] == int(r["want"] not in ("yn_miss", "incorrect"))


def test_upgrade_only_never_downgrades(spark):
    data = [("5", "7", "numerical_reasoning", 1, 1), ("0.50 crore", "0.5 crore", "numerical_reasoning", 0, 1), ("0.50", "0.5", "temporal_reasoning", 0, 0)]
    df = spark.createDataFrame(data, "reference string, prediction string, task string, agree int, want int")
    assert all(r["agree"] == r["want"] for r in scoring.rescore_upgrade_only(df).collect())


def test_filter_on_the_verdict_keeps_one_kernel(spark):
    df = spark.createDataFrame([("a b", "b c", "t")], "reference string, prediction string, task string").repartition(2)
    plan = scoring.score(df).where("correct = 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_verdicts_do_not_depend_on_row_order(spark):
    data = [(i, a, b, "temporal_reasoning") for i, (a, b) in enumerate(sentences(60, 5))]
    schema = "i int, reference string, prediction string, task string"
    one = {r["i"]: r["correct"] for r in scoring.score(spark.createDataFrame(data, schema)).collect()}
    two = {r["i"]: r["correct"] for r in scoring.score(spark.createDataFrame(data[::-1], schema).orderBy(F.rand(1))).collect()}
    assert one == two
