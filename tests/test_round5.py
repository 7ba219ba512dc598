"""Steps that were repeated or spread too widely: each is made once, with the same results."""

from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions import features as feat
from gradeframe.functions import fuzzy
from gradeframe.functions.predictor import apply_predictor
from gradeframe.operators import retrieval
from registry import bindings as b
from registry import report_queries as rq
from registry import statistics_queries as sq

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_features_of_items_are_written_once(spark):
    """What models and ranks read has no text and no pattern left in it."""
    plan = plan_of(sq.featured(spark, SF))
    assert "regexp" not in plan and "text#" not in plan


def test_each_text_feature_is_counted_once(spark):
    plan = plan_of(feat.text_features(b.items(spark, SF), "text", None).select("item_id", *feat.FEATURES))
    assert len(re.findall(r"regexp_count|regexp_extract_all", plan)) == 9


def test_openings_rule_out_no_match(spark):
    texts = ["12/3/99 Jan 2020 x1999 1999, 12,000.50 crore Cr. RS.5 ₹7 lakhs", "Hereby amendeD; REPLACED superseding, xamend where If IF. iff provided that",
             "SEBI RBI Circular Notification xRBI notwithstanding subject to", "", "aNov 2001 Nov 2001 Decem 1999 ſupersed", "été 5 ½ ٣ 1,2,3."]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    patterns = [fv.DATE_PATTERN, *fv.FEATURE_PATTERNS.values()]
    found = rows.select(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"a{i}") for i, p in enumerate(patterns)],
                        *[F.regexp_extract_all("text", F.lit(feat._quick(p)), F.lit(0)).alias(f"b{i}") for i, p in enumerate(patterns)]).collect()
    assert all(r[f"a{i}"] == r[f"b{i}"] for r in found for i in range(len(patterns)))
    assert all(any(r[f"a{i}"] for r in found) for i in range(len(patterns)))


def test_documents_meet_and_not_their_windows(spark):
    """answer_pairs: the texts of a document go to its partner once, and windows are no rows of a join."""
    plan = plan_of(b.answer_pairs(spark, SF))
    join = plan.index("Join LeftOuter")
    assert "posexplode" not in plan and "Generate" not in plan[join:]


def test_verdicts_of_an_audit_are_written_once(spark):
    rows = rq.audited(spark, SF)
    assert "regexp" not in plan_of(rows) and rows.count() > 0


def test_long_texts_of_many_characters_are_halved(spark, monkeypatch):
    """Masks of a block stay bounded; the lengths are those of the pair by pair kernel."""
    draw = random.Random(5)
    a = ["".join(chr(draw.randrange(97, 900)) for _ in range(draw.randrange(1, 90))) for _ in range(200)]
    c = ["".join(draw.choice(x) if draw.random() < 0.7 else "\U0001f600" for _ in range(120)) for x in a]
    monkeypatch.setattr(fuzzy, "MASKS", 5000)
    assert fuzzy.lcs_lengths(a, c).tolist() == [fuzzy.lcs_length(x, y) for x, y in zip(a, c)]


def test_predictor_is_sent_prompts_alone(spark):
    """other columns, as contexts, do not pass through Python; they and their order stay."""
    df = spark.createDataFrame([(i, "x" * 50, f"p{i}", "old", i % 2) for i in range(20)], "i int, context string, prompt string, prediction string, `a.b` int")
    found = apply_predictor(df, predict_batch=lambda texts: [t + "!" for t in texts], batch=8)
    assert found.columns == ["i", "context", "prompt", "a.b", "prediction"]
    assert [tuple(r) for r in found.orderBy("i").collect()] == [(i, "x" * 50, f"p{i}", i % 2, f"p{i}!") for i in range(20)]
    plan = plan_of(found)
    assert "MapInArrow" not in plan and re.search(r"ArrowEvalPython \[run\(prompt#\d+\)", plan)


def test_block_of_vectors_is_not_copied_whole():
    """unit vectors are made a tile at a time; results are those of brute force."""
    rng = np.random.default_rng(5)
    vectors, queries = rng.normal(size=(40_000, 64)).astype(np.float32), rng.normal(size=(10, 64)).astype(np.float32)
    best = retrieval._Best(queries, None, 3)
    tracemalloc.start()
    best.meet(np.arange(len(vectors)), vectors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < vectors.nbytes
    exact = retrieval._unit(queries.astype(float)) @ retrieval._unit(vectors.astype(float)).T
    assert (best.ids == np.argsort(-exact, axis=1, kind="stable")[:, :3]).all()


def test_blocks_hold_any_ids_and_lengths(spark):
    """text ids, vectors of several lengths and blocks without a partner, in many blocks and in one."""
    rng = np.random.default_rng(6)
    rows = [(f"k{i:02d}", rng.normal(size=3 + i % 2).tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    asked = df.withColumnRenamed("vec_id", "query_id")
    few = retrieval.top_k_similar(asked.where("size(embedding) = 3"), df, exclude_self=True)
    many = retrieval.top_k_similar(asked, df, exclude_self=True, block_queries=7, block_vectors=9, few_queries=0)
    assert sorted(few.collect()) == sorted(many.join(asked.where("size(embedding) = 3").select("query_id"), "query_id").select(few.columns).collect())
    assert many.count() == 120
