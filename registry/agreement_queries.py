"""Agreement of raters over ``eval_ratings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.operators import agreement as ag
from registry import bindings as b
from registry import oracle as o
from registry import query
from registry.accuracy_queries import rounded

PAIR = "pr AS (SELECT a.item_id, a.task, a.label AS gold, b.label AS label FROM ratings a JOIN ratings b ON a.item_id=b.item_id AND a.rater=0 AND b.rater=1)"
ALL = "pa AS (SELECT * FROM pr UNION ALL SELECT item_id, 'OVERALL', gold, label FROM pr)"


def pairs(spark, d):
    return ag.rater_pairs(b.eval_ratings(spark, d), 0, 1, keep=["task"])


def common(spark, d):
    return ag.common_raters(b.eval_ratings(spark, d), 3)


@query("J7_common_raters", o.with_(o.RATINGS, body="SELECT item_id, task, sum(label)::BIGINT AS n_yes FROM ratings GROUP BY ALL HAVING count(DISTINCT rater)=3"))
def _(spark, d):
    return common(spark, d).select("item_id", "task", F.size(F.filter("votes", lambda v: v == 1)).cast("long").alias("n_yes"))


@query("A33_confusion", o.with_(o.RATINGS, PAIR, body="SELECT task, gold::VARCHAR AS gold, label::VARCHAR AS label, count(*) AS n FROM pr GROUP BY ALL"))
def _(spark, d):
    return ag.confusion(pairs(spark, d), ["task"])


@query("A20_cohen_kappa", o.with_(o.RATINGS, PAIR, ALL, """k AS (SELECT task, count(*) AS n, count(*) FILTER (gold=label) AS n_agree, avg(gold) AS g, avg(label) AS l FROM pa GROUP BY task)""", body="""
SELECT task, n, n_agree, round(n_agree/n,6) AS agreement, round((n_agree/n-(g*l+(1-g)*(1-l)))/(1-(g*l+(1-g)*(1-l))),6) AS kappa, (g IN (0,1) OR l IN (0,1)) AS constant_labels FROM k"""))
def _(spark, d):
    return rounded(ag.cohen_kappa(pairs(spark, d), ["task"]), "agreement", "kappa")


@query("A21_cohen_kappa_binary", o.with_(o.RATINGS, PAIR, "k AS (SELECT task, count(*) AS n, avg((gold=label)::INT) AS p_o, avg(gold) AS g, avg(label) AS l FROM pr GROUP BY task)", body="""
SELECT task, n, round(p_o,6) AS p_o, round(g*l+(1-g)*(1-l),6) AS p_e, round(CASE WHEN g*l+(1-g)*(1-l)<1 THEN (p_o-(g*l+(1-g)*(1-l)))/(1-(g*l+(1-g)*(1-l))) ELSE 1 END,6) AS kappa FROM k"""))
def _(spark, d):
    return rounded(ag.cohen_kappa_binary(pairs(spark, d), ["task"]), "p_o", "p_e", "kappa")


@query("A22_agreement_rate", o.with_(o.RATINGS, PAIR, ALL, body="SELECT task, count(*) AS n, count(*) FILTER (gold=label) AS n_agree, round(100.0*count(*) FILTER (gold=label)/count(*),6) AS agreement_pct FROM pa GROUP BY task"))
def _(spark, d):
    rows = pairs(spark, d).withColumn("agree", (F.col("gold") == F.col("label")).cast("int"))
    return rounded(ag.agreement_rate(rows), "agreement_pct")


FLEISS = """v AS (SELECT item_id, task, sum(label) AS y, 3-sum(label) AS x FROM ratings GROUP BY ALL HAVING count(*)=3),
va AS (SELECT * FROM v UNION ALL SELECT item_id, 'OVERALL', y, x FROM v),
f AS (SELECT task, count(*) AS n_items, avg((y*y+x*x-3)/6.0) AS pb, (sum(y)/(3.0*count(*)))**2+(sum(x)/(3.0*count(*)))**2 AS pe, 100.0*count(*) FILTER (y IN (0,3))/count(*) AS u FROM va GROUP BY task)"""


@query("A23_A24_fleiss_kappa_unanimity", o.with_(o.RATINGS, FLEISS, body="SELECT task, n_items, round(u,6) AS agreement_pct, CASE WHEN pe<1 THEN round((pb-pe)/(1-pe),4) ELSE 1 END AS fleiss_kappa FROM f"))
def _(spark, d):
    return rounded(ag.fleiss_kappa(common(spark, d)), "agreement_pct")


@query("A24_disagreement_items", o.with_(o.RATINGS, body="SELECT item_id, task FROM ratings GROUP BY ALL HAVING count(*)=3 AND count(DISTINCT label)>1"))
def _(spark, d):
    return ag.disagreement_items(common(spark, d)).select("item_id", "task")


@query("D5_bootstrap_ci_kappa")
def _(spark, d):
    return ag.bootstrap_ci_kappa(pairs(spark, d), ["task"])


@query("D5_bootstrap_counts", o.with_(o.RATINGS, PAIR, body="SELECT task, count(*) AS n, true AS ordered FROM pr GROUP BY task"))
def _(spark, d):
    out = ag.bootstrap_ci_kappa(pairs(spark, d), ["task"])
    return out.select("task", "n", (F.col("ci_lo") <= F.col("ci_hi")).alias("ordered"))
