"""Systems compared item by item over ``eval_long``."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.operators import pairs as pr
from registry import bindings as b
from registry import oracle as o
from registry import query
from registry.accuracy_queries import GROUPS, rounded, valid


@query("J1_aligned_pairs", o.with_(o.VALID, body="SELECT a.item_id, a.task, a.correct AS correct_a, b.correct AS correct_b FROM valid a JOIN valid b ON a.item_id=b.item_id AND a.model='m0' AND b.model='m3'"))
def _(spark, d):
    return pr.aligned_pairs(valid(spark, d), "m0", "m3", keep=["task"])


AP = """ap AS (SELECT a.task, a.model AS model_a, b.model AS model_b, a.correct AS ca, b.correct AS cb FROM valid a JOIN valid b ON a.item_id=b.item_id AND a.model<b.model)"""
COUNTS = """count(*) AS n, count(*) FILTER (ca=1 AND cb=1) AS "both", count(*) FILTER (ca=1 AND cb=0) AS only_a, count(*) FILTER (ca=0 AND cb=1) AS only_b,
 round(avg(ca),6) AS acc_a, round(avg(cb),6) AS acc_b, round(avg(ca-cb),6) AS delta"""


@query("J2_all_pairs", o.with_(o.VALID, AP, body=f"SELECT model_a, model_b, {COUNTS} FROM ap GROUP BY ALL"))
def _(spark, d):
    return rounded(pr.all_pairs(valid(spark, d)), "acc_a", "acc_b", "delta")


@query("J2_all_pairs_by_task", o.with_(o.VALID, AP, body=f"SELECT task, model_a, model_b, {COUNTS} FROM ap GROUP BY ALL"))
def _(spark, d):
    return rounded(pr.all_pairs(valid(spark, d), ["task"]), "acc_a", "acc_b", "delta")


@query("J6_correctness_matrix", o.with_(o.VALID, body="SELECT item_id, " + ", ".join(f"max(CASE WHEN model='{m}' THEN correct END) AS {m}" for m in b.MODELS) + " FROM valid GROUP BY item_id"))
def _(spark, d):
    return pr.correctness_matrix(valid(spark, d), b.MODELS)


JAC = """grid AS (SELECT i.item_id, 'm'||m AS model, coalesce(v.correct,0) AS c FROM (SELECT DISTINCT item_id FROM valid) i CROSS JOIN (SELECT unnest(range(0,6)) AS m) r
 LEFT JOIN valid v ON v.item_id=i.item_id AND v.model='m'||m)"""


@query("A18_error_jaccard", o.with_(o.VALID, JAC, body="""
SELECT a.model AS model_a, b.model AS model_b, count(*) FILTER (a.c=0 AND b.c=0) AS n_both_wrong, count(*) FILTER (a.c=0 OR b.c=0) AS n_either_wrong,
 round(CASE WHEN a.model=b.model THEN 1 WHEN count(*) FILTER (a.c=0 OR b.c=0)=0 THEN 0 ELSE count(*) FILTER (a.c=0 AND b.c=0)/count(*) FILTER (a.c=0 OR b.c=0) END,6)::DOUBLE AS jaccard
FROM grid a JOIN grid b USING (item_id) GROUP BY a.model, b.model"""))
def _(spark, d):
    return rounded(pr.error_jaccard(valid(spark, d)), "jaccard")


def tail(keys: str) -> str:
    return f"ct AS (SELECT {keys}, {COUNTS} FROM ap GROUP BY {keys}), " + o.bootstrap_tail("ct", keys)


P = "round(p_value,6) AS p_value, p_value<0.05 AS significant"


@query("D2_paired_bootstrap", o.with_(o.VALID, AP, tail("model_a, model_b"), body=f"SELECT ct.*, {P} FROM ct JOIN tail USING (model_a, model_b)"))
def _(spark, d):
    return rounded(pr.paired_bootstrap(valid(spark, d)), "acc_a", "acc_b", "delta", "p_value")


@query("D2_paired_bootstrap_by_task", o.with_(o.VALID, AP, tail("task, model_a, model_b"), body=f"SELECT ct.*, {P} FROM ct JOIN tail USING (task, model_a, model_b)"))
def _(spark, d):
    return rounded(pr.paired_bootstrap(valid(spark, d), ["task"]), "acc_a", "acc_b", "delta", "p_value")


# The share among 10,000 drawn replicates lies within five standard errors of the exact tail.
@query("U3_bootstrap_replicates", o.with_(o.VALID, AP, tail("model_a, model_b"), body="SELECT model_a, model_b, n, round(p_value,6) AS p_value, true AS agrees FROM ct JOIN tail USING (model_a, model_b)"))
def _(spark, d):
    exact = pr.paired_bootstrap(valid(spark, d)).select("model_a", "model_b", "n", "only_a", "only_b", "p_value")
    drawn = pr.with_bootstrap_p(exact.drop("p_value"), ["model_a", "model_b"], pr.REPLICATES).select("model_a", "model_b", F.col("p_value").alias("drawn"))
    p = F.col("p_value")
    agrees = F.abs(F.col("drawn") - p) <= 5 * F.sqrt(p * (1 - p) / pr.REPLICATES) + 1.0 / pr.REPLICATES
    return rounded(exact.join(drawn, ["model_a", "model_b"]).select("model_a", "model_b", "n", "p_value", agrees.alias("agrees")), "p_value")


INDEXED = """sh AS (SELECT a.item_id AS i, a.correct-b.correct AS d FROM eval_long a JOIN eval_long b ON a.item_id=b.item_id AND a.model='m0' AND b.model='m1'),
sz AS (SELECT max(i)+1 AS n FROM sh), ob AS (SELECT avg(d) AS obs FROM sh),
d1 AS (SELECT r, i AS j, (i*48271 + (r+1)*16807) % 2147483647 AS x FROM sh CROSS JOIN (SELECT unnest(range(0,10000)) AS r) t),
d2 AS (SELECT r, j, (x*x + r) % 2147483647 AS y FROM d1), dr AS (SELECT r, ((y*y + j) % 2147483647) % (SELECT n FROM sz) AS i FROM d2),
mn AS (SELECT r AS replicate, avg(d) AS m FROM dr JOIN sh USING (i) GROUP BY r)"""


@query("D3_paired_bootstrap_indexed", o.with_(o.EVAL, INDEXED, body="""
SELECT replicate, round(m,6) AS mean_delta, round(obs,6) AS observed, CASE WHEN abs(round(m-obs,9))>=round(abs(obs),9) THEN 1 ELSE 0 END AS extreme FROM mn, ob"""))
def _(spark, d):
    return rounded(pr.paired_bootstrap_indexed(b.eval_long(spark, d), "m0", "m1"), "mean_delta", "observed")


TWO = """sd AS (SELECT *, CASE WHEN model IN ('m0','m1') THEN 'reasoning' WHEN model IN ('m2','m3','m4') THEN 'standard' END AS side FROM valid),
ps AS (SELECT task, side, correct, row_number() OVER (PARTITION BY side, task ORDER BY model, item_id) AS p FROM sd WHERE side IS NOT NULL),
zp AS (SELECT a.task, a.correct AS ca, b.correct AS cb FROM ps a JOIN ps b ON a.task=b.task AND a.p=b.p AND a.side='reasoning' AND b.side='standard')"""


@query("D4_two_sample_counts", o.with_(o.VALID, TWO, body="""
SELECT task, count(*) AS n, round(avg(ca),6) AS acc_a, round(avg(cb),6) AS acc_b, count(*) FILTER (ca=1 AND cb=0) AS only_a, count(*) FILTER (ca=0 AND cb=1) AS only_b FROM zp GROUP BY task"""))
def _(spark, d):
    out = pr.two_sample_bootstrap(valid(spark, d), GROUPS, "reasoning", "standard")
    return rounded(out.drop("p_value", "significant"), "acc_a", "acc_b")


TWO_TAIL = "ct AS (SELECT task, count(*) AS n, avg(ca) AS acc_a, avg(cb) AS acc_b, count(*) FILTER (ca=1 AND cb=0) AS only_a, count(*) FILTER (ca=0 AND cb=1) AS only_b FROM zp GROUP BY task), " + o.bootstrap_tail("ct", "task")
TWO_BODY = f"SELECT ct.task, n, round(acc_a,6) AS acc_a, round(acc_b,6) AS acc_b, only_a, only_b, {P} FROM ct JOIN tail USING (task)"


@query("D4_two_sample_bootstrap", o.with_(o.VALID, TWO, TWO_TAIL, body=TWO_BODY))
def _(spark, d):
    return rounded(pr.two_sample_bootstrap(valid(spark, d), GROUPS, "reasoning", "standard"), "acc_a", "acc_b", "p_value")
