from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeframe.functions import stats
from gradeframe.operators import accuracy as acc
from gradeframe.operators import agreement as agr
from gradeframe.operators import correlation as cor
from gradeframe.operators import items as it
from gradeframe.operators import pairs as pr
from gradeframe.operators import ranks as rk
from gradeframe.operators import regression as reg


@pytest.mark.parametrize("k, n, lo, hi, hw", [(49, 53, 0.821413, 0.970261, 0.074424), (364, 406, 0.8631, 0.9226, None), (162, 174, 0.8833, 0.9601, None), (0, 0, 0, 0, 0)])
def test_wilson(spark, k, n, lo, hi, hw):
    row = acc.with_wilson(spark.createDataFrame([(k, n)], "n_correct long, n long")).first()
    digits = 1e-6 if hw is not None else 6e-5
    assert row["ci_lower"] == pytest.approx(lo, abs=digits) and row["ci_upper"] == pytest.approx(hi, abs=digits)
    if hw is not None:
        assert row["half_width"] == pytest.approx(hw, abs=1e-6)
    assert 0 <= row["ci_lower"] <= row["ci_upper"] <= 1


def test_tails():
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-8)
    assert stats.t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert stats.gamma_tail(1.5, 27.764 / 2) == pytest.approx(math.erfc(math.sqrt(13.882)) + math.sqrt(2 * 27.764 / math.pi) * math.exp(-13.882), rel=1e-9)
    assert stats.gamma_tail(1.0, 3.0) == pytest.approx(math.exp(-3.0), rel=1e-12)
    assert stats.beta_tail(2, 3, 0.4) == pytest.approx(0.5248)
    assert stats.beta_tail(0.5, 0.5, 0.5) == pytest.approx(0.5)


def test_cohen_golden(spark):
    cells = [("no", "no")] * 10 + [("no", "yes")] * 3 + [("yes", "yes")] * 4
    row = agr.cohen_kappa(spark.createDataFrame(cells, "gold string, label string")).first()
    assert row["agreement"] == pytest.approx(0.8235, abs=1e-4) and row["kappa"] == pytest.approx(0.611, abs=5e-4)
    binary = spark.createDataFrame([(int(a == "yes"), int(b == "yes")) for a, b in cells], "gold int, label int")
    assert agr.cohen_kappa_binary(binary).first()["kappa"] == pytest.approx(row["kappa"])


def test_cohen_constant_labels(spark):
    row = agr.cohen_kappa(spark.createDataFrame([("yes", "yes")] * 4, "gold string, label string")).first()
    assert row["kappa"] is None and row["constant_labels"] and row["agreement"] == 1.0


def test_fleiss(spark):
    data = [(i, "t", r, int(i == 0)) for i in range(2) for r in range(3)]
    common = agr.common_raters(spark.createDataFrame(data, "item_id int, task string, rater int, label int"), 3)
    assert {r["fleiss_kappa"] for r in agr.fleiss_kappa(common).collect()} == {1.0}


def test_fleiss_drops_items_without_all_raters(spark):
    data = [(0, "t", r, 1) for r in range(3)] + [(1, "t", 0, 1), (1, "t", 1, 0)]
    assert agr.common_raters(spark.createDataFrame(data, "item_id int, task string, rater int, label int"), 3).count() == 1


GOLDEN_MATRIX = [
    # rank patterns of eleven systems on four tasks are not stored here; full agreement and ties are checked instead
    ("a", [0.9, 0.8, 0.7, 0.6]), ("b", [0.8, 0.7, 0.6, 0.5]), ("c", [0.99, 0.5, 0.3, 0.1]),
]


def accuracy_rows(spark, matrix):
    return spark.createDataFrame([(m, f"t{i}", float(v)) for m, values in matrix for i, v in enumerate(values)], "model string, task string, accuracy double")


def test_kendall_full_agreement(spark):
    row = cor.kendalls_w(accuracy_rows(spark, GOLDEN_MATRIX)).first()
    assert row["W"] == pytest.approx(1.0) and row["chi2"] == pytest.approx(9.0) and row["strength"] == "Strong"
    assert row["p_value"] == pytest.approx(stats.gamma_tail(1.5, 4.5))


def test_kendall_ties_are_averaged(spark):
    row = cor.kendalls_w(accuracy_rows(spark, [("a", [0.5, 0.5, 0.1]), ("b", [0.3, 0.2, 0.1])])).first()
    ranks = np.array([[2.5, 2.5, 1.0], [3.0, 2.0, 1.0]]).sum(axis=0)
    s = ((ranks - ranks.mean()) ** 2).sum()
    assert row["W"] == pytest.approx(12 * s / (4 * 24))


def test_majority_baseline(spark):
    row = acc.majority_baseline(spark.createDataFrame([("No.",)] * 53 + [("yes it",)] * 9, "answer string")).first()
    assert row["majority_class"] == "No" and row["majority_baseline"] == pytest.approx(0.8548, abs=1e-4)
    tie = acc.majority_baseline(spark.createDataFrame([("no",), ("yes",)], "answer string")).first()
    assert tie["majority_class"] == "No"


def test_dissociation(spark):
    rows = spark.createDataFrame([("a", 0.9, 0.6), ("b", None, 0.5), ("c", 0.0, 0.0)], "model string, CON double, TMP double")
    got = acc.dissociation_index(rows).collect()
    assert [(r["model"], round(r["DI"], 6)) for r in got] == [("a", 0.2)]


def test_fnr_corrected(spark):
    rows = spark.createDataFrame([(0.8, 0.1), (0.95, 0.2), (0.5, 1.0)], "a double, f double")
    assert [round(r[0], 6) for r in rows.select(stats.fnr_corrected("a", "f")).collect()] == [0.888889, 1.0, 0.5]


def long(spark, outcomes):
    data = [(i, m, "t", int(c)) for m, vector in outcomes.items() for i, c in enumerate(vector) if c is not None]
    return spark.createDataFrame(data, "item_id long, model string, task string, correct int")


def test_bootstrap_matches_resampling(spark):
    rng = np.random.default_rng(0)
    a, b = (rng.random(200) < 0.7).astype(int), (rng.random(200) < 0.6).astype(int)
    row = pr.paired_bootstrap(long(spark, {"a": a, "b": b})).first()
    delta = a - b
    centred = delta - delta.mean()
    means = centred[rng.integers(0, 200, size=(20000, 200))].mean(axis=1)
    direct = (np.abs(means) >= abs(delta.mean()) - 1e-12).mean()
    assert row["delta"] == pytest.approx(delta.mean())
    assert row["p_value"] == pytest.approx(direct, abs=0.02)


def test_bootstrap_is_reproducible_and_handles_no_items(spark):
    frame = long(spark, {"a": [1, 0, 1, 1], "b": [0, 0, 1, 0]})
    assert pr.paired_bootstrap(frame).first()["p_value"] == pr.paired_bootstrap(frame.repartition(5)).first()["p_value"]
    assert pr.bootstrap_p(0, 0, 0, 10, np.random.default_rng(1)) == 1.0
    assert pr.paired_bootstrap(long(spark, {"a": [1, None], "b": [None, 1]})).count() == 0


def test_indexed_bootstrap_agrees_with_counts(spark):
    rng = np.random.default_rng(5)
    a, b = (rng.random(150) < 0.75).astype(int), (rng.random(150) < 0.65).astype(int)
    frame = long(spark, {"a": a, "b": b})
    indexed = pr.paired_bootstrap_indexed(frame, "a", "b", replicates=400).agg(F.avg("extreme")).first()[0]
    assert indexed == pytest.approx(pr.paired_bootstrap(frame).first()["p_value"], abs=0.12)


def test_pairs_ignore_copies_of_hot_items(spark):
    base = long(spark, {"a": [1, 0, 1], "b": [0, 0, 1], "c": [1, 1, 1]})
    hot = base.unionByName(base.where("item_id = 0").withColumn("_x", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("_x"))
    assert sorted(map(tuple, pr.all_pairs(base).collect())) == sorted(map(tuple, pr.all_pairs(hot).collect()))


def test_pairs_take_the_better_of_conflicting_copies(spark):
    rows = spark.createDataFrame([(1, "a", "t", 0), (1, "a", "t", 1), (1, "b", "t", 1)], "item_id int, model string, task string, correct int")
    assert pr.all_pairs(rows).first()["both"] == 1


def test_jaccard(spark):
    got = {(r["model_a"], r["model_b"]): r["jaccard"] for r in pr.error_jaccard(long(spark, {"a": [1, 0, 0, 1], "b": [0, 0, None, 1], "c": [1, 1, 1, 1]})).collect()}
    assert got[("a", "a")] == 1.0 and got[("a", "b")] == got[("b", "a")] == pytest.approx(2 / 3)
    assert got[("a", "c")] == 0.0


def test_item_categories(spark):
    frame = long(spark, {f"m{i}": [1, int(i == 0), int(i < 6), int(i < 9)] for i in range(10)})
    got = {r["item_id"]: r["category"] for r in it.item_category(it.item_stats(frame)).collect()}
    assert got == {0: "Easy (ceiling)", 1: "Hard (floor)", 2: "Highly Discriminative", 3: "Easy (ceiling)"}


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_ranks_match_a_window(spark, buckets):
    rng = np.random.default_rng(2)
    values = np.concatenate([np.zeros(300), rng.integers(0, 40, 300), rng.normal(size=50) * 1000])
    df = spark.createDataFrame([(i, "hot" if i % 3 else "cold", float(v)) for i, v in enumerate(values)], "i long, g string, v double")
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy("v")
    expected = df.withColumn("x", F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy("g", "v")) - 1) / 2)
    want = {r["i"]: r["x"] for r in expected.collect()}
    ranks = rk.value_ranks(df, ["g"], "v", buckets=buckets)
    got = {r["i"]: r["avg_rank"] for r in df.join(ranks, ["g", "v"]).collect()}
    assert got == want
    order = {r["i"]: r["rn"] for r in rk.numbered(df, ["g"], "v", ["i"], buckets=buckets).collect()}
    exact = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("v", "i")))
    assert order == {r["i"]: r["rn"] for r in exact.collect()}


def test_spearman_matches_ranks(spark):
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 9, 120), rng.integers(0, 2, 120)
    row = cor.spearman(spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x int, y int"), "x", "y").first()

    def ranks(v):
        order = np.sort(v)
        return np.array([(np.searchsorted(order, k, "left") + np.searchsorted(order, k, "right") + 1) / 2 for k in v])

    rho = np.corrcoef(ranks(x), ranks(y))[0, 1]
    assert row["rho"] == pytest.approx(rho)
    assert row["p_value"] == pytest.approx(stats.t_two_sided(rho * math.sqrt(118 / (1 - rho * rho)), 118))


def newton(design, target, penalty=0.0, weights=None):
    beta = np.zeros(design.shape[1])
    ridge = np.full(design.shape[1], penalty)
    ridge[-1] = 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (target - p) - ridge * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        beta = beta + np.linalg.solve(hessian, gradient)
    return beta, np.sqrt(np.diag(np.linalg.inv(hessian)))


@pytest.mark.parametrize("n", [1500, 30_000])
def test_logit_regression(spark, n):
    rng = np.random.default_rng(8)
    levels, tasks = ["easy", "medium", "hard"], ["regulatory_interpretation", "numerical_reasoning", "contradiction_detection", "temporal_reasoning"]
    li, ti = rng.integers(0, 3, n), rng.integers(0, 4, n)
    c = (rng.random(n) < 1 / (1 + np.exp(-(1.0 - 0.5 * (li == 2) - 0.8 * (ti == 1))))).astype(int)
    df = spark.createDataFrame([(f" {levels[a].upper()}", tasks[b], int(y)) for a, b, y in zip(li, ti, c)], "difficulty string, task string, correct int")
    got = {r["term"]: r for r in reg.logit_regression(df).collect()}
    design = np.column_stack([li == 1, li == 2, ti == 1, ti == 2, ti == 3, np.ones(n)]).astype(float)
    beta, se = newton(design, c)
    names = ["difficulty[medium]", "difficulty[hard]", *[f"task[{t}]" for t in tasks[1:]], "Intercept"]
    for name, b, s in zip(names, beta, se):
        assert got[name]["coef"] == pytest.approx(b, abs=1e-5)
        assert got[name]["ci_hi"] - got[name]["coef"] == pytest.approx(1.96 * s, rel=1e-3)
        assert got[name]["p_value"] == pytest.approx(math.erfc(abs(b / s) / math.sqrt(2)), abs=1e-4)


def test_linear_fallback_and_levels(spark):
    rng = np.random.default_rng(9)
    n = 4000
    levels, tasks = ["easy", "medium", "expert"], ["regulatory_interpretation", "numerical_reasoning"]
    li, ti = rng.integers(0, 3, n), rng.integers(0, 2, n)
    c = (rng.random(n) < 0.8 - 0.1 * (li == 2)).astype(float)
    df = spark.createDataFrame([(levels[a], tasks[b], int(y)) for a, b, y in zip(li, ti, c)], "difficulty string, task string, correct int")
    got = {r["term"]: r for r in reg.logit_regression(df, ols=True).collect()}
    design = np.column_stack([li == 1, li == 2, ti == 1, np.ones(n)]).astype(float)
    beta, *_ = np.linalg.lstsq(design, c, rcond=None)
    error = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * ((c - design @ beta) ** 2).sum() / (n - 4))
    assert set(got) == {"difficulty[medium]", "difficulty[expert]", "task[numerical_reasoning]", "Intercept"}
    for name, b, e in zip(["difficulty[medium]", "difficulty[expert]", "task[numerical_reasoning]", "Intercept"], beta, error):
        assert got[name]["coef"] == pytest.approx(b, abs=1e-9)
        assert got[name]["ci_hi"] - got[name]["coef"] == pytest.approx(1.96 * e, rel=1e-3)


def test_hard_item_model(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = np.column_stack([rng.normal(size=n), rng.normal(size=n) * 5 + 2])
    hard = rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] * 2)))
    df = spark.createDataFrame([(i, float(a), float(b), 0.2 if h else 0.9) for i, (a, b, h) in enumerate(zip(x[:, 0], x[:, 1], hard))], "item_id long, f1 double, f2 double, ensemble_accuracy double")
    got = reg.hard_item_model(df, ["f1", "f2"]).collect()
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    beta, _ = newton(np.column_stack([scaled, np.ones(n)]), hard.astype(float), penalty=1.0)
    assert got[0]["feature"] == "f1" and got[0]["coefficient"] == pytest.approx(beta[0], abs=1e-3)
    assert 0.75 < got[0]["auc_mean"] < 1.0


def test_kappa_interval_covers_the_estimate(spark):
    cells = [("g", "no", "no")] * 100 + [("g", "no", "yes")] * 30 + [("g", "yes", "yes")] * 40
    pairs = spark.createDataFrame(cells, "task string, gold string, label string")
    row, kappa = agr.bootstrap_ci_kappa(pairs, ["task"]).first(), agr.cohen_kappa(pairs).first()["kappa"]
    assert row["n"] == 170 and row["ci_lo"] < kappa < row["ci_hi"] < 1


def test_bootstraps_take_text_ids_and_gaps(spark):
    """Ids are only names: text ids and gaps change neither sizes nor the sample behind a replicate."""
    rows = [(f"REG_{i * 10}", m, "t", int((i * 7 + k) % 3 > 0)) for i in range(50) for k, m in enumerate("ab")]
    text = spark.createDataFrame(rows, "item_id string, model string, task string, correct int")
    gaps = text.withColumn("item_id", F.regexp_replace("item_id", "REG_", "").cast("long"))
    dense = gaps.withColumn("item_id", F.expr("item_id div 10"))
    runs = {k: sorted(map(tuple, pr.paired_bootstrap_indexed(v, "a", "b", replicates=20).collect())) for k, v in {"gaps": gaps, "dense": dense, "text": text}.items()}
    assert runs["gaps"] == runs["dense"] and len(runs["text"]) == 20
    assert pr.two_sample_bootstrap(text, {"a": "x", "b": "y"}, "x", "y").first()["n"] == 50
