from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import registry
from gradeframe.functions import predictor
from gradeframe.functions import text as t
from gradeframe.functions.predictor import apply_predictor
from gradeframe.operators import accuracy as acc
from gradeframe.operators import pairs as pr
from gradeframe.operators import retrieval

registry.load_all()


def test_indexed_bootstrap_keeps_draws_out_of_rows(spark):
    """Spans of items add up to what one span gives, and no plan explodes an item into replicates."""
    rows = [(i, m, int((i * 7 + k) % 3 > 0)) for i in range(300) for k, m in enumerate("ab")]
    frame = spark.createDataFrame(rows, "item_id long, model string, correct int")
    whole = pr.paired_bootstrap_indexed(frame, "a", "b", replicates=120)
    spans = pr.paired_bootstrap_indexed(frame, "a", "b", replicates=120, part=16, span=64)
    d = [int(i * 7 % 3 > 0) - int((i * 7 + 1) % 3 > 0) for i in range(300)]
    prime, want = 2147483647, {}
    for r in range(120):
        drawn = []
        for j in range(300):
            x = (j * 48271 + (r + 1) * 16807) % prime
            y = (x * x + r) % prime
            drawn.append(d[(y * y + j) % prime % 300])
        want[r] = round(sum(drawn) / 300, 9)
    for found in (whole, spans):
        assert {x["replicate"]: round(x["mean_delta"], 9) for x in found.collect()} == want
    assert "BroadcastHashJoin" not in whole._jdf.queryExecution().executedPlan().toString()
    assert pr.paired_bootstrap_indexed(frame.limit(0), "a", "b", replicates=5).count() == 0


def test_yes_no_ends_at_other_letters(spark):
    """Only ASCII letters, digits and the underscore lengthen a word, as in the SQL."""
    given = ["caféno", "yesé", "nó", "_no", "no1", "a yes"]
    found = spark.createDataFrame(list(enumerate(given)), "i int, s string").select("i", t.yn_first("s").alias("x")).collect()
    assert [r["x"] for r in sorted(found)] == ["no", "yes", "no", "", "", "yes"]


def test_text_files_give_every_document(spark, tmp_path):
    """A row for each document: empty and null texts, marks within texts, equal texts of a folder."""
    texts = ["", None, "a\n\0\nb", "same", "same", "\0\2\n1:x", "end\0", "r\r\nn", "1:2"]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    found = registry.QUERIES["IO4_text_files"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == [(i, hashlib.md5(((x or "") + "\n").encode()).hexdigest()) for i, x in enumerate(texts)]


def vectors_of(spark, n):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_approximate_search_deals_large_buckets(spark, monkeypatch):
    """Buckets of any size give the same best, and pairs never become rows of a join."""
    vecs = vectors_of(spark, 300)
    queries = vecs.withColumnRenamed("vec_id", "query_id")
    whole = retrieval.top_k_approximate(queries, vecs, exclude_self=True, tables=4, projections=1, bucket=4.0)
    want = set(map(tuple, whole.collect()))
    assert len(want) == 900 and whole.groupBy("query_id", "vec_id").count().where("count > 1").count() == 0
    monkeypatch.setattr(retrieval, "BUCKET_ROWS", 40)
    assert set(map(tuple, retrieval.top_k_approximate(queries, vecs, exclude_self=True, tables=4, projections=1, bucket=4.0).collect())) == want
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroups")[0]
    exact = retrieval.top_k_similar(queries, vecs, exclude_self=True)
    assert retrieval.recall(whole, exact).first()["recall"] >= 0.9


def test_blocks_grow_before_they_become_many(spark, monkeypatch):
    """A row is copied once for every block of the other side, so the number of blocks is bounded."""
    vecs = vectors_of(spark, 200)
    queries = vecs.withColumnRenamed("vec_id", "query_id")
    q, v, schema = retrieval._sides(queries, vecs, "query_id", "vec_id", "embedding")
    monkeypatch.setattr(retrieval, "GRID", 3)
    found = retrieval._many(q, v, 3, schema, True, 10, 10)
    assert found.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 9
    assert {tuple(r) for r in retrieval._ranked(found, 3).collect()} == {tuple(r) for r in retrieval.top_k_similar(queries, vecs, exclude_self=True).collect()}


def test_robustness_cuts_answers_before_it_gathers_them(spark):
    """The opening is that of the stripped text, and whole answers reach neither a sort nor a shuffle."""
    given = ["", "  ", "a", " a b \n", "x" * 49 + "  ", "x" * 49 + " y", " " * 60 + "z" * 60 + " ", "é" * 50 + " \n", "\U0001f600" * 51, "a\nb" * 30]
    found = spark.createDataFrame([(x,) for x in given], "s string").select("s", acc._opening(F.col("s")).alias("x"), F.left(t.strip("s"), F.lit(50)).alias("want"))
    assert all(r["x"] == r["want"] for r in found.collect())
    frame = spark.createDataFrame([("m", 1, "t", "original", "long answer", 1)], "model string, item_id int, task string, condition string, prediction string, correct int")
    plan = acc.robustness(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" not in plan or "prediction" not in plan[: plan.index("Generate")]


def test_predictor_holds_few_answers(spark):
    """Answers leave in small batches, in order, and whole batches still reach the function."""
    sizes = spark.createDataFrame([(i, f"p{i}") for i in range(1000)], "i int, prompt string").coalesce(1)
    found = apply_predictor(sizes, predict_batch=lambda texts: [f"{len(texts)} {x}" for x in texts], batch=100)
    assert {r["prediction"] for r in found.collect()} == {f"100 p{i}" for i in range(1000)}
    held = found.mapInArrow(lambda batches: batches, found.schema)
    assert max(predictor.ROWS // 100 * 100, 100) == 200 and held.count() == 1000


def test_stream_arrivals_are_not_one_file(spark, tmp_path, monkeypatch):
    """Rows of one arrival lie in as many files as they have partitions."""
    from registry import corpus_queries as cq

    docs = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "en", "s", 200) for i in range(64)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(cq, "run_folder", lambda spark: str(tmp_path / "run"))
    assert registry.QUERIES["S1_score_stream"](spark, str(tmp_path)).count() > 0
    assert len(list((tmp_path / "run" / "in").glob("*.parquet"))) > 4
