"""Sampling and splitting with an arithmetic order key, which SQL can repeat."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.operators import sampling as sm
from registry import bindings as b
from registry import oracle as o
from registry import query

KEY_SQL = "(item_id*7919+42)%10007"


def key():
    return (F.col("item_id") * 7919 + 42) % 10007


def slim(spark, d):
    return b.items(spark, d).select("item_id", "task", "difficulty")


@query("X1_stratified_sample", o.with_(o.ITEMS, body=f"SELECT item_id, difficulty FROM (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY {KEY_SQL}, item_id) AS r FROM items) WHERE r<=10"))
def _(spark, d):
    return sm.stratified_sample(slim(spark, d), ["difficulty"], 10, key=key()).select("item_id", "difficulty")


@query("X2_stratified_sample_topup", o.with_(o.ITEMS, f"s AS (SELECT item_id, task FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY {KEY_SQL}, item_id) AS r FROM items) WHERE r<=22)",
       f"rest AS (SELECT item_id, task, row_number() OVER (ORDER BY {KEY_SQL}, item_id) AS r FROM items WHERE item_id NOT IN (SELECT item_id FROM s))",
       body="SELECT item_id, task FROM s UNION ALL SELECT item_id, task FROM rest WHERE r <= 100-(SELECT count(*) FROM s)"))
def _(spark, d):
    return sm.stratified_sample_topup(slim(spark, d), ["task"], 22, 100, key=key()).select("item_id", "task")


SIZES = {"en": 30, "fr": 15, "de": 15, "es": 31}


@query("X3_nested_stratified", o.with_(o.ITEMS, f"lv AS (SELECT task, count(DISTINCT difficulty) AS k, CASE task WHEN 'en' THEN 30 WHEN 'es' THEN 31 ELSE 15 END AS n FROM items GROUP BY task)",
       f"r AS (SELECT i.item_id, i.task, i.difficulty, lv.k, lv.n, row_number() OVER (PARTITION BY i.task, i.difficulty ORDER BY {KEY_SQL}, i.item_id) AS rn FROM items i JOIN lv USING (task))",
       body="SELECT item_id, task, difficulty FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY difficulty, item_id) AS r2 FROM r WHERE rn<=greatest(1, n//k)) WHERE r2<=n"))
def _(spark, d):
    return sm.nested_stratified(slim(spark, d), SIZES, key=key()).select("item_id", "task", "difficulty")


@query("X4_rubric_sample", o.with_(o.ITEMS, body=f"""
SELECT item_id, difficulty FROM (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY {KEY_SQL}, item_id) AS r FROM items) WHERE (SELECT count(*) FROM items)<=60 OR r<=20"""))
def _(spark, d):
    return sm.rubric_sample(slim(spark, d), key=key()).select("item_id", "difficulty")


@query("X5_stratified_split", o.with_(o.ITEMS, body=f"""
SELECT item_id, task, CASE WHEN row_number() OVER (PARTITION BY task ORDER BY {KEY_SQL}, item_id) <= round(0.2*count(*) OVER (PARTITION BY task)) THEN 'dev' ELSE 'test' END AS split FROM items"""))
def _(spark, d):
    rows = slim(spark, d).withColumn("k", key())
    return sm.stratified_split(rows, ["task"], 0.2, key="k").select("item_id", "task", "split")


HARD = """q AS (SELECT greatest(0, 400-(SELECT count(*) FROM items WHERE difficulty='hard')) AS needed),
sub AS (SELECT item_id FROM items WHERE difficulty='hard' UNION ALL SELECT item_id FROM (SELECT item_id, task, row_number() OVER (PARTITION BY task ORDER BY item_id) AS r,
 CASE task WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS pos FROM items WHERE difficulty='medium'), q WHERE r <= needed//4 + CASE WHEN pos < needed%4 THEN 1 ELSE 0 END)"""


@query("X6_hard_subset", o.with_(o.ITEMS, HARD, body="SELECT item_id, task, difficulty FROM items WHERE item_id IN (SELECT item_id FROM sub)"))
def _(spark, d):
    return sm.hard_subset(slim(spark, d), 400, b.LANGS)[0].select("item_id", "task", "difficulty")


@query("X6_hard_subset_pool", o.with_(o.ITEMS, HARD, body="SELECT item_id, task, difficulty FROM items WHERE item_id NOT IN (SELECT item_id FROM sub)"))
def _(spark, d):
    return sm.hard_subset(slim(spark, d), 400, b.LANGS)[1].select("item_id", "task", "difficulty")


@query("X7_few_shot_examples", o.with_(o.ITEMS, "e AS (SELECT task, count(*) FILTER (difficulty='easy') AS ne FROM items GROUP BY task)", body="""
SELECT task, item_id, rank FROM (SELECT i.task, i.item_id, row_number() OVER (PARTITION BY i.task ORDER BY i.item_id) AS rank
 FROM items i JOIN e USING (task) WHERE e.ne<20 OR i.difficulty='easy') WHERE rank<=20"""))
def _(spark, d):
    return sm.few_shot_examples(slim(spark, d), 20).select("task", "item_id", F.col("rank").cast("long").alias("rank"))


@query("X8_eval_and_shots", o.with_(o.ITEMS, body=f"""
SELECT item_id, task, rn, CASE WHEN rn<=25 THEN 'eval' ELSE 'shot' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY {KEY_SQL}, item_id) AS rn FROM items) WHERE rn<=28"""))
def _(spark, d):
    return sm.eval_and_shots(slim(spark, d), ["task"], key=key()).select("item_id", "task", F.col("rn").cast("long").alias("rn"), "role")
