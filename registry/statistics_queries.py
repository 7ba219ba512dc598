"""Ranks, concordance, correlations, trends and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.functions import features as feat
from gradeframe.functions import text as t
from gradeframe.operators import accuracy as acc
from gradeframe.operators import correlation as cor
from gradeframe.operators import items as it
from gradeframe.operators import ranks as rk
from gradeframe.operators import regression as rg
from gradeframe.plans.reports import keep
from registry import bindings as b
from registry import oracle as o
from registry import query
from registry.accuracy_queries import CELLS, rounded, valid
from registry.corpus_queries import run_folder

RANK = "(rank() OVER (PARTITION BY {p} ORDER BY {v}) + (count(*) OVER (PARTITION BY {p}, {v}) - 1)/2.0)"


def table(spark, d):
    return acc.cells(valid(spark, d), ["model", "task"]).withColumn("accuracy", acc.ratio("n_correct", "n"))


@query("W2_rank_average", f"SELECT event_id, CASE WHEN value IS NOT NULL THEN ({RANK.format(p='event_type', v='value')})::DOUBLE END AS avg_rank FROM events")
def _(spark, d):
    return rk.rank_average(b.table(spark, d, "events"), ["event_type"], "value").select("event_id", "avg_rank")


KW = f"rk AS (SELECT model, task, {RANK.format(p='model', v='accuracy')} AS r FROM cells), sm AS (SELECT task, sum(r) AS s, count(*) AS m FROM rk GROUP BY task)"
KW2 = 'k AS (SELECT max(m) AS n_raters, count(*) AS n_items, var_pop(s)*count(*) AS ss FROM sm), w AS (SELECT *, 12*ss/(n_raters*n_raters*(n_items**3-n_items)) AS w FROM k)'


@query("A19_kendalls_w", o.with_(o.VALID, CELLS, KW, KW2, body="""
SELECT n_raters, n_items, round(ss,6) AS "S", round(w,6) AS "W", round(n_raters*(n_items-1)*w,6) AS chi2, CASE WHEN w>0.7 THEN 'Strong' WHEN w>0.4 THEN 'Moderate' ELSE 'Weak' END AS strength FROM w"""))
def _(spark, d):
    return rounded(cor.kendalls_w(table(spark, d), p_value=False), "S", "W", "chi2")


@query("A19_kendalls_w_p", o.with_(o.VALID, CELLS, KW, KW2, "c2 AS (SELECT *, n_raters*(n_items-1)*w AS x FROM w)", body=f"""
SELECT n_raters, n_items, round(w,6) AS "W", round(CASE WHEN x>0 THEN {o.chi2_tail('x', '(n_items-1)')} ELSE 1 END,6) AS p_value FROM c2"""))
def _(spark, d):
    return rounded(cor.kendalls_w(table(spark, d)).select("n_raters", "n_items", "W", "p_value"), "W", "p_value")


LEN = f"ln AS (SELECT v.*, {o.word_count('v.text')} AS n_words FROM valid v)"


def sized(spark, d):
    return valid(spark, d, n_words=t.word_count("text"))


@query("D6_pearson", o.with_(o.VALID, LEN, body="SELECT model, count(*) AS n, round(corr(n_words, correct),6) AS r FROM ln GROUP BY model"))
def _(spark, d):
    return rounded(cor.pearson(sized(spark, d), "n_words", "correct", ["model"], p_value=False), "r")


@query("D6_pearson_p", o.with_(o.VALID, LEN, "cr AS (SELECT model, count(*) AS n, corr(n_words, correct) AS r FROM ln GROUP BY model)", body=f"SELECT model, n, round(r,6) AS r, round({o.t_tail('r', 'n')},6) AS p_value FROM cr"))
def _(spark, d):
    return rounded(cor.pearson(sized(spark, d), "n_words", "correct", ["model"]), "r", "p_value")


SPEAR = f"rr AS (SELECT model, {RANK.format(p='model', v='n_words')} AS a, {RANK.format(p='model', v='correct')} AS b FROM ln)"


@query("D7_spearman", o.with_(o.VALID, LEN, SPEAR, body="SELECT model, count(*) AS n, round(corr(a,b),6) AS rho FROM rr GROUP BY model"))
def _(spark, d):
    return rounded(cor.spearman(sized(spark, d), "n_words", "correct", ["model"], p_value=False), "rho")


@query("D7_spearman_p", o.with_(o.VALID, LEN, SPEAR, "cr AS (SELECT model, count(*) AS n, corr(a,b) AS r FROM rr GROUP BY model)", body=f"SELECT model, n, round(r,6) AS rho, round({o.t_tail('r', 'n')},6) AS p_value FROM cr"))
def _(spark, d):
    return rounded(cor.spearman(sized(spark, d), "n_words", "correct", ["model"]), "rho", "p_value")


FEAT = f"""ft AS (SELECT item_id, task, {o.word_count('text')} AS ctx_len, {o.count_matches('text', '[.;]')} AS sentence_count, {o.count_matches('text', r'(?i)\bif\b|\bwhere\b|\bprovided that\b|\bsubject to\b|\bnotwithstanding\b')} AS num_conditions FROM items),
ens AS (SELECT item_id, 1-avg(correct) AS y FROM valid GROUP BY item_id),
fl AS (SELECT task, 'ctx_len' AS feature, ctx_len AS v, y FROM ft JOIN ens USING (item_id) UNION ALL SELECT task, 'sentence_count', sentence_count, y FROM ft JOIN ens USING (item_id) UNION ALL SELECT task, 'num_conditions', num_conditions, y FROM ft JOIN ens USING (item_id)),
fr AS (SELECT task, feature, {RANK.format(p='task, feature', v='v')} AS a, {RANK.format(p='task, feature', v='round(y,9)')} AS b FROM fl)"""


def featured(spark, d):
    """Features of all items, written once: models and ranks read them many times."""
    rows = feat.text_features(b.items(spark, d), "text", None).select("item_id", "task", *feat.FEATURES)
    ens = it.ensemble_accuracy(valid(spark, d))
    rows = rows.join(ens, "item_id").withColumn("error", F.round(1 - F.col("ensemble_accuracy"), 9))
    return keep(rows, run_folder(spark), "features")


@query("D7_spearman_features", o.with_(o.VALID, FEAT, body="SELECT task, feature, count(*) AS n, round(corr(a,b),6) AS rho FROM fr GROUP BY task, feature HAVING count(*)>=10"))
def _(spark, d):
    out = cor.spearman_features(featured(spark, d), ["ctx_len", "sentence_count", "num_conditions"], "error")
    return rounded(out.drop("p_value"), "rho")


@query("D8_spearman_matrix", o.with_(o.VALID, CELLS, f"rk AS (SELECT model, task, {RANK.format(p='task', v='accuracy')} AS r FROM cells)", body="""
SELECT a.task AS task_a, b.task AS task_b, round(corr(a.r,b.r),6) AS rho FROM rk a JOIN rk b USING (model) GROUP BY a.task, b.task"""))
def _(spark, d):
    return rounded(cor.spearman_matrix(table(spark, d)), "rho")


@query("D9_linear_trend", o.with_(o.VALID, LEN, body="SELECT model, count(*) AS n, round(regr_slope(correct, n_words),9) AS slope, round(regr_intercept(correct, n_words),6) AS intercept FROM ln GROUP BY model"))
def _(spark, d):
    return rounded(rounded(cor.linear_trend(sized(spark, d), "n_words", "correct", ["model"]), "intercept"), "slope", digits=9)


@query("D10_regression_cells", o.with_(o.VALID, body="SELECT difficulty, task, correct::DOUBLE AS label, count(*)::DOUBLE AS weight FROM valid GROUP BY ALL"))
def _(spark, d):
    return rg.regression_cells(valid(spark, d))


@query("D10_logit_regression")
def _(spark, d):
    return rg.logit_regression(valid(spark, d), b.LEVELS, b.LANGS, reference_task="en")


@query("D10_logit_score_equations", o.with_(o.VALID, body="""
SELECT 'difficulty[' || difficulty || ']' AS term, 0.0::DOUBLE AS score FROM valid WHERE difficulty IN ('medium', 'hard') GROUP BY difficulty
UNION ALL SELECT 'task[' || task || ']', 0.0 FROM valid WHERE task <> 'en' GROUP BY task UNION ALL SELECT 'Intercept', 0.0"""))
def _(spark, d):
    rows = valid(spark, d)
    scores = rg.logit_scores(rows, rg.logit_regression(rows, b.LEVELS, b.LANGS, reference_task="en"))
    return scores.select("term", F.abs(F.round("score", 3)).alias("score"))


@query("D11_hard_item_model")
def _(spark, d):
    rows = featured(spark, d)
    return rg.hard_item_model(rows, feat.FEATURES)


@query("D11_hard_item_scores", "SELECT unnest([" + ", ".join(f"'{f}'" for f in [*feat.FEATURES, "Intercept"]) + "]) AS term, 0.0::DOUBLE AS score")
def _(spark, d):
    rows = featured(spark, d)
    scores = rg.hard_item_scores(rows, rg.hard_item_model(rows, feat.FEATURES))
    return scores.select("term", F.abs(F.round("score", 4)).alias("score"))


HARD = "hd AS (SELECT (avg(correct)<0.5)::INT AS hard FROM valid GROUP BY item_id), sz AS (SELECT count(*) AS n, sum(hard)::BIGINT AS h FROM hd)"


# Which folds there are and that both classes are in each.
@query("D11_stratified_folds", o.with_(o.VALID, HARD, body="SELECT f.fold::INTEGER AS fold, (h+4-fold)//5 AS n_hard, (n-h+4-fold)//5 AS n_easy FROM sz, (SELECT unnest(range(0,5)) AS fold) f"))
def _(spark, d):
    items = it.ensemble_accuracy(valid(spark, d)).select("item_id", (F.col("ensemble_accuracy") < 0.5).cast("double").alias("label"))
    folds = rg.stratified_folds(items, 5, "item_id")
    every = folds.sparkSession.range(5).select(F.col("id").cast("int").alias("fold"))
    counts = folds.groupBy("fold").agg(F.count_if(F.col("label") == 1).alias("n_hard"), F.count_if(F.col("label") == 0).alias("n_easy"))
    return every.join(counts, "fold", "left").fillna(0)
