from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.operators import documents as docs
from gradeframe.operators import retrieval as ret
from gradeframe.operators import sampling as smp
from gradeframe.operators import tables as tab


def test_validate_and_merge(spark):
    full = ("temporal_reasoning", "S", "q", "a", "easy")
    schema = "id string, task_type string, source string, question string, answer string, difficulty string, document string, context string, document_a string, context_a string"
    existing = spark.createDataFrame([("A_1", *full, "d", "c", None, None)], schema)
    good = spark.createDataFrame([("A_2", *full, "d", "c", None, None), ("A_3", *full, None, None, "d", "c")], schema)
    assert tab.validate_batch(existing, good).count() == 0
    assert tab.merge_batch(existing, good).count() == 3
    bad = good.unionByName(spark.createDataFrame([("A_1", *full, "d", "c", None, None), ("A_2", *full, "d", None, None, None)], schema))
    found = sorted((r["id"], r["violation"]) for r in tab.validate_batch(existing, bad).collect())
    assert found == [("A_1", "already_present"), ("A_2", "duplicate_in_batch"), ("A_2", "missing_field")]
    assert tab.merge_batch(existing, bad).count() == 1


def test_split_of_a_dominant_stratum(spark):
    df = spark.range(30_000).select(F.col("id").alias("item_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("g"))
    sizes = {r["g"]: r["count"] for r in df.groupBy("g").count().collect()}
    dev = {r["g"]: r["count"] for r in smp.stratified_split(df, ["g"]).where("split = 'dev'").groupBy("g").count().collect()}
    assert dev == {g: int(n * 0.2 + 0.5) for g, n in sizes.items()}


def test_samples_are_exact_and_reproducible(spark):
    df = spark.range(1000).select(F.col("id").alias("item_id"), (F.col("id") % 4).alias("task"))
    one = sorted(r["item_id"] for r in smp.stratified_sample(df, ["task"], 5).collect())
    two = sorted(r["item_id"] for r in smp.stratified_sample(df.repartition(13), ["task"], 5).collect())
    assert one == two and len(one) == 20
    assert one != sorted(r["item_id"] for r in smp.stratified_sample(df, ["task"], 5, seed=7).collect())
    topped = smp.stratified_sample_topup(df, ["task"], 5, 33).collect()
    assert len({r["item_id"] for r in topped}) == 33 and set(one) <= {r["item_id"] for r in topped}


def test_hard_subset_may_exceed_its_size(spark):
    df = spark.createDataFrame([(i, "numerical_reasoning", "hard" if i < 80 else "medium") for i in range(100)], "item_id int, task string, difficulty string")
    subset, pool = smp.hard_subset(df)
    assert subset.count() == 80 and pool.count() == 20


def test_chunks(spark):
    text = " ".join(f"w{i}" for i in range(700))
    got = docs.chunk_words(spark.createDataFrame([(1, text), (2, "  ")], "doc_id int, text string")).orderBy("word_start").collect()
    assert [r["word_start"] for r in got] == [0, 300, 600] and got[2]["chunk"].split() == [f"w{i}" for i in range(600, 700)]


def test_length_buckets_merge_equal_edges(spark):
    df = spark.createDataFrame([(v,) for v in [1, 1, 1, 1, 1, 1, 5, 9]], "v int")
    assert sorted({(r["v"], r["length_bucket"]) for r in docs.length_buckets(df, "v").collect()}) == [(1, 1), (5, 2), (9, 2)]


def test_top_k_over_blocks_matches_one_block(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)]
    vectors = spark.createDataFrame([(i, v if any(v) else [1.0, 0, 0, 0]) for i, v in data], "vec_id long, embedding array<double>")
    queries = vectors.withColumnRenamed("vec_id", "query_id")
    pick = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())
    small = pick(ret.top_k_similar(queries, vectors, 3, exclude_self=True, block_queries=17, block_vectors=11))
    assert small == pick(ret.top_k_similar(queries, vectors, 3, exclude_self=True))
    assert len(small) == 360 and all(q != v for q, _, v, _ in small)


def test_rows_with_null_keys_stay(spark):
    from gradeframe.operators.boards import leaderboard
    from gradeframe.operators.ranks import rank_average
    from gradeframe.operators.sampling import stratified_split
    from gradeframe.operators.tables import attach_predictions

    table = spark.createDataFrame([(i, None if i % 4 == 0 else "ab"[i % 2], None if i % 5 == 0 else i % 7) for i in range(100)], "item_id long, stratum string, v int")
    split = stratified_split(table, ["stratum"]).groupBy("stratum", "split").count().collect()
    assert {(r["stratum"], r["split"]): r["count"] for r in split} == {(None, "dev"): 5, (None, "test"): 20, ("a", "dev"): 5, ("a", "test"): 20, ("b", "dev"): 10, ("b", "test"): 40}
    pdf = table.toPandas()
    wanted = pdf.groupby("stratum", dropna=False).v.rank()
    got = rank_average(table, ["stratum"], "v").toPandas().set_index("item_id").avg_rank.sort_index()
    assert len(got) == 100 and got.fillna(-1).tolist() == wanted.fillna(-1).tolist()
    board = leaderboard(spark.createDataFrame([("a", 0.5, 1), ("b", None, 2), ("c", 0.7, 3)], "hf_id string, overall double, t long").selectExpr("hf_id", "overall", "timestamp_seconds(t) as submitted_at"))
    assert [(r["hf_id"], r["rank"]) for r in board.orderBy("rank").collect()] == [("c", 1), ("a", 2), ("b", 3)]
    twice = attach_predictions(spark.createDataFrame([("q",), ("r",)], "item_id string"), spark.createDataFrame([("q", "x"), ("q", "y")], "item_id string, prediction string"))
    assert sorted(map(tuple, twice.collect())) == [("q", "x"), ("r", "")]


def test_ingest_takes_documents_in_order(spark):
    """A document clashes only with those taken before; missing addresses and titles never do."""
    rows = [(1, "u1", "t1"), (2, "u2", "t1"), (3, "u2", "t3"), (4, None, "t4"), (5, None, "t5"), (6, "u6", None), (7, "u0", "t7"), (8, "u8", "t3"), (9, "u8", "t9")]
    found = spark.createDataFrame(rows, "n int, url string, title string")
    known = spark.createDataFrame([("u0", "t0")], "url string, title string")
    got = tab.ingest_new_docs(known, found, "n")
    assert sorted(r["n"] for r in got.collect()) == [1, 3, 4, 5, 6, 9] and got.columns == found.columns
    assert tab.ingest_new_docs(known, found.where("n = 7"), "n").collect() == []
