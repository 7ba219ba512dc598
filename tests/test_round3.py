"""Kernels, ranks, pairs, retrieval and streams against brute force and on skewed or odd input."""

from __future__ import annotations

import random
from collections import Counter
from math import exp, lgamma, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeframe.functions import fuzzy, prompts
from gradeframe.functions.predictor import apply_predictor
from gradeframe.functions.table_functions import register_chunk_words
from gradeframe.operators import correlation, pairs, ranks, retrieval, sampling
from gradeframe.operators import regression as reg
from gradeframe.plans import reports
from gradeframe.streaming import flows


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 127, 128, 129, 200])
def test_batched_subsequences_at_word_boundaries(size):
    rng = random.Random(size)
    text = lambda n: "".join(rng.choice("abcdé😀 ") for _ in range(max(0, n)))
    a, b = [text(size) for _ in range(80)], [text(size + rng.randint(-3, 9)) for _ in range(80)]
    assert fuzzy.lcs_lengths(a, b).tolist() == [lcs(x, y) for x, y in zip(a, b)] == [fuzzy.lcs_length(x, y) for x, y in zip(a, b)]


def test_subsequences_of_mixed_batches():
    rng = random.Random(1)
    a = ["x" * n for n in range(100)] + ["".join(rng.choice("ab") for _ in range(5000))] + [""]
    b = ["".join(rng.choice("xy") for _ in range(rng.randint(0, 300))) for _ in range(100)] + ["ab" * 2500] + ["abc"]
    assert fuzzy.lcs_lengths(a, b).tolist() == [fuzzy.lcs_length(x, y) for x, y in zip(a, b)]
    assert fuzzy.lcs_lengths([], []).tolist() == []


def test_two_cutoffs_keep_verdicts(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("aa bb cc dd ee ff".split(), k=rng.randint(0, 8))), " ".join(rng.choices("aa bb cc dd eee ffg".split(), k=rng.randint(0, 8)))) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    exact = {r.i: r.ratio for r in fuzzy.token_set_ratio(df, "a", "b").collect()}
    cut = fuzzy.with_token_set_ratio(df, "a", "b", "ratio", cutoff=(0.6, 0.85))
    for r in cut.collect():
        assert all((r.ratio / 100 >= t) == (exact[r.i] / 100 >= t) for t in (0.6, 0.72, 0.85))


def test_exact_p_is_the_multinomial_tail():
    def brute(n, g, l):
        z, o, p = n - g - l, g - l, 0.0
        for x in range(n + 1):
            for y in range(n - x + 1):
                r = n - x - y
                if abs(x - y - o) >= abs(o) and not (g == 0 and x or l == 0 and y or z == 0 and r):
                    p += exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(y + 1) - lgamma(r + 1) + sum(k * log(c / n) for k, c in ((x, g), (y, l), (r, z)) if k))
        return min(p, 1.0)

    for case in [(10, 3, 1), (10, 10, 0), (50, 7, 7), (120, 40, 22), (300, 10, 0), (1, 1, 0), (90, 50, 40), (40, 0, 1)]:
        assert pairs.exact_bootstrap_p(*case) == pytest.approx(brute(*case), abs=1e-9)
        drawn = pairs.bootstrap_p(*case, 20_000, np.random.default_rng(0))
        assert abs(drawn - brute(*case)) < 0.02
    assert pairs.exact_bootstrap_p(0, 0, 0) == 1.0 and 0.13 < pairs.exact_bootstrap_p(10**9, 2 * 10**8, 2 * 10**8 + 30_000) < 0.14


def test_rank_buckets_are_even_under_outliers(spark):
    df = spark.range(10_000).select("id", F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") * 1.0).alias("v"), F.when(F.col("id") % 3 == 0, None).otherwise("g").alias("g"))
    sizes = [r["count"] for r in ranks._bucketed(df, "v", 100).groupBy("_bucket").count().collect()]
    assert max(sizes) <= 2 * 10_000 / 100 and len(sizes) >= 90
    rows = ranks.rank_average(df, ["g"], "v").collect()
    for g in (None, "g"):
        mine = sorted((r["v"], r["avg_rank"]) for r in rows if r["g"] == g)
        assert [x for _, x in mine] == [float(i + 1) for i in range(len(mine))]
    small = spark.createDataFrame([(None,), (1.5,), (1.5,), (float("nan"),), (-2.0,)], "v double")
    assert sorted((str(r["v"]), r["n"]) for r in ranks.numbered(small.withColumn("k", F.lit(0)), ["k"], "v", ["v"], "n").collect()) == [("-2.0", 1), ("1.5", 2), ("1.5", 3), ("None", 5), ("nan", 4)]


def test_spearman_keeps_null_groups(spark):
    rows = [(None, i, i * i) for i in range(20)] + [("a", i, -i) for i in range(20)]
    got = {r["g"]: (r["n"], round(r["rho"], 9)) for r in correlation.spearman(spark.createDataFrame(rows, "g string, x int, y int"), "x", "y", ["g"], p_value=False).collect()}
    assert got == {None: (20, 1.0), "a": (20, -1.0)}


def test_no_low_cardinality_shuffle_of_rows(spark):
    """Splits, runs and pooled pairs stay spread where nothing may be broadcast."""
    df = spark.range(2000).select(F.col("id").alias("item_id"), F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("model"), F.lit("t").alias("task"), (F.col("id") % 2).cast("int").alias("correct"))
    from gradeframe.operators.accuracy import discover_runs

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (sampling.stratified_split(df, ["model"]), discover_runs(df, 10), pairs.two_sample_bootstrap(df, {"m0": "x", "m1": "y"}, "x", "y"))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # Plain rows still hold item_id; where they are exchanged, the key has a bucket or a salt.
    for plan in plans:
        assert "salt" in plan or "_bucket" in plan


def brute_pairs(rows, by=False):
    best = {}
    for g, item, m, c in rows:
        if m is not None and c is not None:
            k = (g if by else None, item, m)
            best[k] = max(best.get(k, 0), c)
    out = Counter()
    of = {}
    for (g, item, m), c in best.items():
        of.setdefault((g, item), {})[m] = c
    for (g, _), told in of.items():
        for a in told:
            for b in told:
                if a < b:
                    for name, hit in (("n", True), ("both", told[a] and told[b]), ("only_a", told[a] and not told[b]), ("only_b", told[b] and not told[a])):
                        out[(g, a, b, name)] += bool(hit)
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("by", [False, True])
def test_bitmaps_count_pairs(spark, by):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), rng.randint(0, 150), rng.choice(["a", "b", "c", "d", "e", None]), rng.choice([0, 1, None])) for _ in range(1500)]
    df = spark.createDataFrame(rows, "task string, item_id long, model string, correct int")
    keys = ["task"] if by else []
    counts = pairs.pair_counts(pairs.outcome_bitmaps(df, keys), keys, systems=2, words=1)
    got = {(r["task"] if by else None, r["model_a"], r["model_b"], n): r[n] for r in counts.collect() for n in ("n", "both", "only_a", "only_b") if r[n]}
    assert got == brute_pairs(rows, by)


def test_five_thousand_systems(spark):
    """Blocks of systems meet; no row or task holds all of them."""
    df = spark.range(5000).select(F.concat(F.lit("s"), F.format_string("%04d", "id")).alias("model"), "id").crossJoin(spark.range(3).select(F.col("id").alias("item_id")))
    df = df.select("item_id", "model", ((F.col("id") + F.col("item_id")) % 2).cast("int").alias("correct"))
    counts = pairs.pair_counts(pairs.outcome_bitmaps(df)).agg(F.count("*").alias("pairs"), F.sum("both").alias("both"), F.sum("n").alias("n"), F.sum("only_a").alias("a")).first()
    even = 2500 * 2499 // 2
    assert (counts["pairs"], counts["n"]) == (5000 * 4999 // 2, 3 * 5000 * 4999 // 2)
    # Two systems of equal parity are right together on one item or two.
    assert counts["both"] == even * 1 + even * 2


VECS = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(400 + i, [1.0] * 8) for i in range(3)] + [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [1.0, 2.0]), (None, [1.0] * 8), (503, [0.0] * 8)]
    return spark.createDataFrame(rows, VECS)


def test_few_and_many_queries_agree(spark, vecs):
    queries = vecs.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    one = {tuple(r) for r in retrieval.top_k_similar(queries, vecs, exclude_self=True, few_queries=0, block_queries=10, block_vectors=40).collect()}
    few = retrieval.top_k_similar(queries.where(F.size("embedding") == 8), vecs, exclude_self=True)
    two = {tuple(r) for r in few.collect()}
    assert {r for r in one if r[0] != 502} == two and len(two) == 3 * 61
    # Nothing is exchanged between the vectors' scan and the search.
    plan = few._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Exchange" not in plan[plan.index("MapInArrow"):]
    ties = [r["vec_id"] for r in sorted(retrieval.top_k_similar(spark.createDataFrame([(1, [1.0] * 8)], "query_id long, embedding array<float>"), vecs).collect(), key=lambda r: r["rank"])]
    assert ties == [400, 401, 402]
    assert retrieval.top_k_similar(queries.where("query_id < 0"), vecs).collect() == []
    assert retrieval.top_k_similar(queries, vecs.where("vec_id < 0")).collect() == []


def test_approximate_search_finds_real_neighbours(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(100, 16))
    rows = [(i, (centres[i % 100] + rng.normal(size=16) * 0.05).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, VECS)
    queries = df.withColumnRenamed("vec_id", "query_id")
    exact = retrieval.top_k_similar(queries, df, exclude_self=True)
    found = retrieval.top_k_approximate(queries, df, exclude_self=True, tables=8, projections=4, bucket=0.5)
    assert retrieval.recall(found, exact).first()["recall"] >= 0.9
    both = {(r["query_id"], r["vec_id"]): r["score"] for r in exact.collect()}
    assert all(abs(both[r["query_id"], r["vec_id"]] - r["score"]) < 1e-6 for r in found.collect() if (r["query_id"], r["vec_id"]) in both)


def test_folds_hold_both_classes(spark):
    df = spark.range(60).select(F.col("id").alias("item_id"), (F.col("id") < 7).cast("double").alias("label"))
    got = reg.stratified_folds(df, 5, "item_id").groupBy("fold").agg(F.sum("label").alias("h"), F.count("*").alias("n")).collect()
    assert sorted(r["h"] for r in got) == [1, 1, 1, 2, 2] and all(11 <= r["n"] <= 13 for r in got)
    items = df.select("item_id", (0.9 - F.col("label") * 0.8).alias("ensemble_accuracy"), (F.col("label") * 2 + F.col("item_id") % 5).alias("f1"), (F.col("item_id") % 3).alias("f2"))
    fitted = reg.hard_item_model(items, ["f1", "f2"])
    assert fitted.first()["folds"] == 5 and 0.5 < fitted.first()["auc_mean"] <= 1
    assert all(abs(r["score"]) < 1e-4 for r in reg.hard_item_scores(items, fitted).collect())
    none = reg.hard_item_model(items.withColumn("ensemble_accuracy", F.when(F.col("item_id") == 0, 0.1).otherwise(0.9)), ["f1", "f2"]).first()
    assert none["auc_mean"] is None and none["folds"] == 1


def test_board_state_does_not_grow_with_history(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "hf_id string, overall double, at string").selectExpr("hf_id", "overall", "cast(at as timestamp) AS submitted_at")
    store = str(tmp_path / "store")
    batches = [rows(("o/x", 0.5, "2024-01-01"), ("o/y", 0.7, "2024-01-02")), rows(("o/x", 0.9, "2024-01-03")), rows(("o/x", 0.1, "2024-01-04"), ("o/z", 0.2, "2024-01-04")), rows(("o/y", 0.7, "2024-01-01"))]
    for i, batch in enumerate(batches):
        board = sorted((r["hf_id"], r["overall"]) for r in flows.merge_submissions(spark, batch, i, store).collect())
    again = flows.merge_submissions(spark, batches[3], 3, store)
    want = [("o/x", 0.9), ("o/y", 0.7), ("o/z", 0.2)]
    assert sorted((r["hf_id"], r["overall"]) for r in again.collect()) == want == board
    assert [r["submitted_at"].day for r in again.where("hf_id = 'o/y'").collect()] == [1]
    assert flows._versions(spark, store) == [2, 3]


def test_batches_find_the_prompt_at_fault(spark):
    calls = []

    def several(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError("no " + "x" * 100)
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(i, "bad" if i == 5 else f"p{i}") for i in range(10)], "i int, prompt string").coalesce(1)
    got = [r["prediction"] for r in apply_predictor(df, predict_batch=several, batch=8).orderBy("i").collect()]
    assert got == [f"P{i}" if i != 5 else "FAIL: no " + "x" * 77 for i in range(10)]
    short = apply_predictor(df, predict_batch=lambda texts: texts[:1], batch=4).orderBy("i").collect()
    assert [r["prediction"] for r in short] == [r["prompt"] for r in short]
    with pytest.raises(ValueError):
        apply_predictor(df)


def test_table_function_has_no_python(spark):
    register_chunk_words(spark, "cut_words")
    spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None)], "id int, text string").createOrReplaceTempView("cut_source")
    found = spark.sql("SELECT id, c.* FROM cut_source, LATERAL cut_words(text, 3, 1) c")
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0, "a b c"), (1, 1, 2, "c d e"), (1, 2, 4, "e")]
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_retrieved_text_decides_the_comparison(spark):
    items = spark.createDataFrame([(1, "t", "Who?", "anna"), (2, "t", "Who?", "bert"), (3, "t", "Who?", "carl")], "query_id long, task string, question string, reference string")
    texts = spark.createDataFrame([(10, "it is anna"), (11, "it is bert")], "vec_id long, text string")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, embedding array<float>")
    base = spark.createDataFrame([("retrieval", "t", 1.0)], "model string, task string, accuracy double")

    def run(vectors):
        df = spark.createDataFrame(vectors, VECS)
        out = reports.retrieval_compare(items, queries, df, texts, base, predict=lambda p: p.split("Question")[0], k=1)
        return {r["task"]: round(r["other_acc"], 6) for r in out["comparison"].collect()}

    assert run([(10, [1.0, 0.0]), (11, [0.0, 1.0])]) == {"t": 0.666667, "OVERALL": 0.666667}
    assert run([(10, [0.0, 1.0]), (11, [1.0, 0.0])]) == {"t": 0.0, "OVERALL": 0.0}


def test_conditions_show_their_examples(spark):
    rows = spark.createDataFrame([(1, "numerical_reasoning", "ctx", "q"), (2, "x", "ctx", "q")], "id int, task_type string, context string, question string")
    shots = spark.createDataFrame([("numerical_reasoning", i, f"E{i}") for i in (1, 2)], "task_type string, rank int, example string")
    got = {(r["id"], r["condition"]): (r["system"], r["prompt"]) for r in prompts.build_conditions(rows, "Base.", examples=shots).collect()}
    assert len(got) == 8 and got[1, "zero_shot_cot"][0].startswith("Base.\n\n") and got[1, "zero_shot"][0] == "Base."
    assert got[1, "one_shot"][1].startswith("E1\n\n--- Your question ---\n") and got[1, "three_shot"][1].startswith("E1\n\nE2\n\n")
    assert got[2, "three_shot"][1] == got[2, "zero_shot"][1]


def test_board_ranks_systems(spark):
    rows = [("a", "numerical_reasoning", 2, 1), ("a", "OVERALL", 2, 1), ("b", "OVERALL", 2, 2), ("c", "OVERALL", 2, 1)]
    df = spark.createDataFrame(rows, "model string, task string, n long, n_correct long").selectExpr("*", "n_correct / n AS accuracy", "0.0 AS ci_lower", "1.0 AS ci_upper")
    got = [(r["rank"], r["model"], r["numerical_reasoning"]) for r in reports.ranked_board(df).orderBy("rank").collect()]
    assert got == [(1, "b", None), (2, "a", 0.5), (3, "c", None)]
