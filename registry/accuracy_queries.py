"""Accuracy tables over ``eval_long``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.functions import features as feat
from gradeframe.functions.corpus import year_from_name
from gradeframe.operators import accuracy as acc
from gradeframe.operators import errors as err
from gradeframe.operators import items as it
from registry import bindings as b
from registry import oracle as o
from registry import query

TASK_DIFF = {("en", "easy"): "Domain Knowledge Failure", ("en", "medium"): "Domain Knowledge Failure", ("en", "hard"): "Context Grounding Failure",
             ("fr", "easy"): "Numerical Reasoning Failure", ("fr", "medium"): "Numerical Reasoning Failure", ("fr", "hard"): "Numerical Reasoning Failure",
             ("de", "easy"): "Context Grounding Failure", ("de", "medium"): "Temporal Reasoning Failure", ("de", "hard"): "Temporal Reasoning Failure"}
TASK_ERR = {"en": "Domain Knowledge Failure", "fr": "Numerical Reasoning Failure", "de": "Temporal Reasoning Failure", "es": "Context Grounding Failure"}
GROUPS = {"m0": "reasoning", "m1": "reasoning", "m2": "standard", "m3": "standard", "m4": "standard"}

SQL_TASK_DIFF = "CASE " + " ".join(f"WHEN task='{t}' AND difficulty='{d}' THEN '{e}'" for (t, d), e in TASK_DIFF.items()) + " ELSE 'Domain Knowledge Failure' END"
SQL_TASK_ERR = "CASE task " + " ".join(f"WHEN '{t}' THEN '{e}'" for t, e in TASK_ERR.items()) + " END"
SQL_GROUPS = "CASE model " + " ".join(f"WHEN '{m}' THEN '{g}'" for m, g in GROUPS.items()) + " END"
SQL_TYPES = "(SELECT unnest(['Domain Knowledge Failure','Numerical Reasoning Failure','Temporal Reasoning Failure','Context Grounding Failure']) AS error_type)"

CELLS = "cells AS (SELECT model, task, count(*) AS n, sum(correct)::BIGINT AS n_correct, avg(correct) AS accuracy FROM valid GROUP BY ALL)"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


def valid(spark, d, keep=None, **computed) -> DataFrame:
    return acc.drop_failed(b.eval_long(spark, d, keep, **computed))


@query("A1_accuracy_by_model_task", o.with_(o.VALID, body="""
SELECT model, CASE WHEN grouping(task)=1 THEN 'OVERALL' ELSE task END AS task, count(*) AS n, sum(correct)::BIGINT AS n_correct, round(avg(correct),6) AS accuracy
FROM valid GROUP BY GROUPING SETS ((model,task),(model))"""))
def _(spark, d):
    return rounded(acc.accuracy(valid(spark, d)), "accuracy")


@query("A2_task_accuracy_matrix", o.with_(o.VALID, body="SELECT model, " + ", ".join(
    f"round(avg(CASE WHEN task='{t}' THEN correct END),6) AS {t}" for t in b.LANGS) + ', round(avg(correct),6) AS "Overall" FROM valid GROUP BY model'))
def _(spark, d):
    return rounded(acc.task_accuracy_matrix(valid(spark, d), b.LANGS), *b.LANGS, "Overall")


@query("A3_accuracy_by_difficulty", o.with_(o.VALID, body="SELECT model, " + ", ".join(
    f"round(avg(CASE WHEN difficulty='{t}' THEN correct END),6) AS {t}_acc, count(CASE WHEN difficulty='{t}' THEN 1 END) AS {t}_n" for t in b.LEVELS) + " FROM valid GROUP BY model"))
def _(spark, d):
    return rounded(acc.accuracy_by_level(valid(spark, d), "difficulty", b.LEVELS), *[f"{x}_acc" for x in b.LEVELS])


@query("A4_macro_average", o.with_(o.VALID, CELLS, body="SELECT task, round(avg(accuracy),6) AS mean_acc, count(*) AS n_models FROM cells GROUP BY task"))
def _(spark, d):
    return rounded(acc.macro_average(valid(spark, d)), "mean_acc")


@query("A5_pooled_group_accuracy", o.with_(o.VALID, body=f"""
SELECT {SQL_GROUPS} AS "group", task, count(*) AS n, sum(correct)::BIGINT AS n_correct, round(avg(correct),6) AS accuracy
FROM valid WHERE {SQL_GROUPS} IS NOT NULL GROUP BY ALL"""))
def _(spark, d):
    return rounded(acc.pooled_group_accuracy(valid(spark, d), GROUPS), "accuracy")


@query("A6_spread", o.with_(o.VALID, CELLS, body="""
SELECT task, round(min(accuracy),6) AS min_acc, round(max(accuracy),6) AS max_acc, round(avg(accuracy),6) AS mean_acc,
 round(max(accuracy)-min(accuracy),6) AS spread, round(stddev_pop(accuracy),6) AS std_acc, round(var_pop(accuracy),6) AS var_acc FROM cells GROUP BY task"""))
def _(spark, d):
    return rounded(acc.spread(valid(spark, d)), "min_acc", "max_acc", "mean_acc", "spread", "std_acc", "var_acc")


@query("A6_most_variable_task", o.with_(o.VALID, CELLS, ", s AS (SELECT task, var_pop(accuracy) AS v FROM cells GROUP BY task)".lstrip(", "),
       body="SELECT task, round(v,6) AS var_acc FROM s ORDER BY v DESC, task DESC LIMIT 1"))
def _(spark, d):
    return rounded(acc.most_variable_task(valid(spark, d)), "var_acc")


W = o.wilson("n_correct", "n")
WCELLS = "wc AS (SELECT model, task, n, n_correct, " + ", ".join(f"{e} AS {k}" for k, e in W.items()) + " FROM (SELECT model, task, n, n_correct FROM cells))"


@query("A7_wilson_interval", o.with_(o.VALID, CELLS, WCELLS, body="SELECT model, task, n, n_correct, " + ", ".join(f"round({k},6) AS {k}" for k in W) + " FROM wc"))
def _(spark, d):
    table = acc.with_wilson(acc.cells(valid(spark, d), ["model", "task"]))
    return rounded(table, *W)


@query("A8_ci_overlap_pairs", o.with_(o.VALID, CELLS, WCELLS, body="""
SELECT a.task, a.model AS model_a, b.model AS model_b, round(abs(a.accuracy-b.accuracy),6) AS abs_delta, round(a.half_width+b.half_width,6) AS hw_sum
FROM wc a JOIN wc b ON a.task=b.task AND a.model<b.model WHERE abs(a.accuracy-b.accuracy) < a.half_width+b.half_width"""))
def _(spark, d):
    table = acc.with_wilson(acc.cells(valid(spark, d), ["model", "task"]))
    return rounded(acc.ci_overlap_pairs(table), "abs_delta", "hw_sum").select("task", "model_a", "model_b", "abs_delta", "hw_sum")


BASE_SQL = """base AS (SELECT count(*) FILTER (lower(trim(prediction)) LIKE 'yes%') AS yes_count, count(*) FILTER (lower(trim(prediction)) LIKE 'no%') AS no_count, count(*) AS total FROM valid)"""


@query("A9_majority_baseline", o.with_(o.VALID, BASE_SQL, body="""
SELECT yes_count, no_count, total, CASE WHEN yes_count>no_count THEN 'Yes' ELSE 'No' END AS majority_class,
 round(greatest(yes_count,no_count)/total,6) AS majority_baseline, 0.5::DOUBLE AS random_baseline FROM base"""))
def _(spark, d):
    return rounded(acc.majority_baseline(valid(spark, d), "prediction"), "majority_baseline")


@query("A9_above_baseline", o.with_(o.VALID, BASE_SQL, body="""
SELECT model, count(*) AS n, sum(correct)::BIGINT AS n_correct, round(avg(correct),6) AS accuracy,
 avg(correct) > (SELECT greatest(yes_count,no_count)/total FROM base) + 0.05 AS above FROM valid GROUP BY model"""))
def _(spark, d):
    rows = valid(spark, d)
    return rounded(acc.above_baseline(rows, acc.majority_baseline(rows, "prediction")), "accuracy")


@query("A10_label_distribution", o.with_(o.EVAL, body="""
SELECT model, count(*) FILTER (lower(trim(prediction)) LIKE 'yes%') AS n_yes, count(*) FILTER (lower(trim(prediction)) LIKE 'no%') AS n_no,
 count(*) FILTER (lower(trim(prediction)) NOT LIKE 'yes%' AND lower(trim(prediction)) NOT LIKE 'no%') AS n_other, round(avg(correct),6) AS accuracy FROM eval_long GROUP BY model"""))
def _(spark, d):
    return rounded(acc.label_distribution(b.eval_long(spark, d)), "accuracy")


STATS_SQL = """st AS (SELECT item_id, avg(correct) AS accuracy, var_samp(correct) AS variance, sum(correct)::BIGINT AS n_correct, count(*) AS n_total FROM valid GROUP BY item_id),
st2 AS (SELECT *, 1-accuracy AS difficulty, 4*accuracy*(1-accuracy) AS discrimination FROM st)"""
CAT_SQL = """cat AS (SELECT *, CASE WHEN accuracy>0.3 AND accuracy<0.8 AND discrimination > (SELECT quantile_cont(discrimination,0.5) FROM st2) THEN 'Highly Discriminative'
 WHEN accuracy<=0.1 THEN 'Hard (floor)' WHEN accuracy>=0.9 THEN 'Easy (ceiling)' ELSE 'Medium' END AS category FROM st2)"""


@query("A11_item_stats", o.with_(o.VALID, STATS_SQL, body="""
SELECT item_id, round(accuracy,6) AS accuracy, round(variance,6) AS variance, n_correct, n_total, round(difficulty,6) AS difficulty, round(discrimination,6) AS discrimination FROM st2"""))
def _(spark, d):
    return rounded(it.item_stats(valid(spark, d)), "accuracy", "variance", "difficulty", "discrimination")


@query("A12_item_category", o.with_(o.VALID, STATS_SQL, CAT_SQL, body="SELECT item_id, round(discrimination,6) AS discrimination, category FROM cat"))
def _(spark, d):
    return rounded(it.item_category(it.item_stats(valid(spark, d))).select("item_id", "discrimination", "category"), "discrimination")


@query("A12_category_summary", o.with_(o.VALID, STATS_SQL, CAT_SQL, body="""
SELECT count(*) FILTER (category='Highly Discriminative') AS highly_discriminative, count(*) FILTER (category='Easy (ceiling)') AS ceiling_items,
 count(*) FILTER (category='Hard (floor)') AS floor_items, round(avg(discrimination),6) AS mean_discrimination, round(quantile_cont(accuracy,0.5),6) AS median_accuracy FROM cat"""))
def _(spark, d):
    return rounded(it.category_summary(it.item_category(it.item_stats(valid(spark, d)))), "mean_discrimination", "median_accuracy")


@query("A13_consensus_items", o.with_(o.VALID, STATS_SQL, body="""
SELECT item_id, round(accuracy,6) AS accuracy, CASE WHEN accuracy<0.2 THEN 'hard' ELSE 'easy' END AS consensus FROM st2 WHERE accuracy<0.2 OR accuracy>0.9"""))
def _(spark, d):
    return rounded(it.consensus_items(it.item_stats(valid(spark, d))).select("item_id", "accuracy", "consensus"), "accuracy")


@query("O2_top_discriminative", o.with_(o.VALID, STATS_SQL, body="SELECT item_id, round(discrimination,6) AS discrimination FROM st2 ORDER BY st2.discrimination DESC, item_id LIMIT 10"))
def _(spark, d):
    return rounded(it.top_discriminative(it.item_stats(valid(spark, d))).select("item_id", "discrimination"), "discrimination")


@query("D12_ensemble_accuracy", o.with_(o.VALID, body="SELECT item_id, round(avg(correct),6) AS ensemble_accuracy FROM valid GROUP BY item_id"))
def _(spark, d):
    return rounded(it.ensemble_accuracy(valid(spark, d)), "ensemble_accuracy")


@query("A14_error_taxonomy", o.with_(o.VALID, body=f"""
SELECT m.model, t.error_type, count(v.item_id) AS count FROM (SELECT DISTINCT model FROM valid) m CROSS JOIN {SQL_TYPES} t
LEFT JOIN (SELECT *, {SQL_TASK_DIFF} AS error_type FROM valid WHERE correct=0) v ON v.model=m.model AND v.error_type=t.error_type GROUP BY ALL"""))
def _(spark, d):
    return err.error_taxonomy(valid(spark, d), TASK_DIFF)


@query("A15_error_taxonomy_by_task", o.with_(o.VALID, body=f"""
SELECT m.model, t.error_type, count(v.item_id) AS count, sum(count(v.item_id)) OVER (PARTITION BY m.model)::BIGINT AS total_errors,
 round(count(v.item_id)/sum(count(v.item_id)) OVER (PARTITION BY m.model),6) AS share
FROM (SELECT DISTINCT model FROM valid) m CROSS JOIN {SQL_TYPES} t
LEFT JOIN (SELECT *, {SQL_TASK_ERR} AS error_type FROM valid WHERE correct=0) v ON v.model=m.model AND v.error_type=t.error_type GROUP BY m.model, t.error_type"""))
def _(spark, d):
    return rounded(err.error_taxonomy_by_task(valid(spark, d), TASK_ERR), "share")


@query("W3_examples_per_group", o.with_(o.VALID, f"f AS (SELECT *, {SQL_TASK_DIFF} AS error_type FROM valid WHERE correct=0)", body="""
SELECT model, error_type, rn, item_id, left(text,120) AS question FROM (SELECT *, row_number() OVER (PARTITION BY model, error_type ORDER BY item_id) AS rn FROM f) WHERE rn<=2"""))
def _(spark, d):
    rows = err.failures(valid(spark, d, ["text"]), TASK_DIFF).withColumnRenamed("text", "question")
    out = err.examples_per_group(rows, previews={"question": 120})
    return out.select("model", "error_type", F.col("rn").cast("long").alias("rn"), "item_id", "question")


@query("W4_first_per_group", o.with_(o.VALID, f"f AS (SELECT *, {SQL_TASK_DIFF} AS error_type FROM valid WHERE correct=0)", body="""
SELECT model, error_type, item_id FROM (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY model, item_id) AS rn FROM f) WHERE rn=1"""))
def _(spark, d):
    return err.first_per_group(err.failures(valid(spark, d), TASK_DIFF)).select("model", "error_type", "item_id")


MATRIX_SQL = "mx AS (SELECT model, avg(CASE WHEN task='de' THEN correct END) AS de, avg(CASE WHEN task='fr' THEN correct END) AS fr, avg(correct) AS ov FROM valid GROUP BY model)"


@query("A17_dissociation_index", o.with_(o.VALID, MATRIX_SQL, body='SELECT model, round(de,6) AS de, round(fr,6) AS fr, round((de-fr)/(de+fr),6) AS "DI" FROM mx WHERE de+fr>0'))
def _(spark, d):
    matrix = acc.task_accuracy_matrix(valid(spark, d), b.LANGS)
    return rounded(acc.dissociation_index(matrix, "de", "fr").select("model", "de", "fr", "DI"), "de", "fr", "DI")


@query("A17_dissociation_summary", o.with_(o.VALID, MATRIX_SQL, "di AS (SELECT model, (de-fr)/(de+fr) AS x FROM mx WHERE de+fr>0)", body="""
SELECT round(max(x),6) AS max_di, max_by(model,x) AS max_model, round(min(x),6) AS min_di, min_by(model,x) AS min_model, round(avg(x),6) AS mean_di FROM di"""))
def _(spark, d):
    matrix = acc.task_accuracy_matrix(valid(spark, d), b.LANGS)
    return rounded(acc.dissociation_summary(acc.dissociation_index(matrix, "de", "fr")), "max_di", "min_di", "mean_di")


@query("W5_flag_best_worst", o.with_(o.VALID, MATRIX_SQL, body="""
SELECT model, round(de,6) AS de, round(ov,6) AS "Overall", CASE WHEN de=max(de) OVER () THEN 'best' WHEN de=min(de) OVER () THEN 'worst' END AS de_flag,
 CASE WHEN ov=max(ov) OVER () THEN 'best' WHEN ov=min(ov) OVER () THEN 'worst' END AS "Overall_flag" FROM mx"""))
def _(spark, d):
    matrix = acc.task_accuracy_matrix(valid(spark, d), ["de"])
    return rounded(acc.flag_best_worst(matrix, ["de", "Overall"]), "de", "Overall")


LB = {}
for _c, _f in [(t, f"task='{t}'") for t in b.LANGS] + [("Overall", "true")]:
    _k, _n = f"sum(CASE WHEN {_f} THEN correct ELSE 0 END)", f"count(CASE WHEN {_f} THEN 1 END)"
    _w = o.wilson(_k, _n)
    LB[_c] = f'round({_w["accuracy"]},6) AS "{_c}", round({_w["ci_lower"]},6) AS "{_c}_ci_lo", round({_w["ci_upper"]},6) AS "{_c}_ci_hi"'


@query("A35_combined_leaderboard", o.with_(o.VALID, body="SELECT model, " + ", ".join(LB.values()) + " FROM valid GROUP BY model HAVING count(*)>=100"))
def _(spark, d):
    table = acc.combined_leaderboard(valid(spark, d), b.LANGS)
    return rounded(table, *[c for c in table.columns if c != "model"])


# A run is a system on one language; languages differ in size.
RUNS_SQL = "runs AS (SELECT item_id, model||'_'||task AS model, correct FROM eval_long), sizes AS (SELECT model, count(*) AS c FROM runs GROUP BY model)"


@query("IO3_discover_runs", o.with_(o.EVAL, RUNS_SQL, body="SELECT item_id, model, correct FROM runs WHERE model IN (SELECT model FROM sizes WHERE c>=125)"))
def _(spark, d):
    runs = b.eval_long(spark, d).withColumn("model", F.concat_ws("_", "model", "task"))
    return acc.discover_runs(runs, 125).select("item_id", "model", "correct")


COND_SQL = "cond AS (SELECT *, CASE WHEN item_id%2=0 THEN 'zero_shot' ELSE 'cot' END AS condition FROM valid)"


def _conditions(spark, d):
    return valid(spark, d).withColumn("condition", F.when(F.col("item_id") % 2 == 0, "zero_shot").otherwise("cot"))


@query("A31_condition_summary", o.with_(o.VALID, COND_SQL, body="SELECT model, condition, " + ", ".join(
    f"round(avg(CASE WHEN task='{t}' THEN correct END),6) AS {t}" for t in b.LANGS) + ', round(avg(correct),6) AS "Overall" FROM cond GROUP BY model, condition'))
def _(spark, d):
    return rounded(acc.condition_summary(_conditions(spark, d), b.LANGS), *b.LANGS, "Overall")


@query("J11_condition_compare", o.with_(o.VALID, COND_SQL, body="""
SELECT r.model, r.task, round(r.a,6) AS other_acc, round(b.a,6) AS base_acc, round(b.a-r.a,6) AS drop
FROM (SELECT model, task, avg(correct) AS a FROM cond WHERE condition='cot' GROUP BY ALL) r
LEFT JOIN (SELECT model, task, avg(correct) AS a FROM cond WHERE condition='zero_shot' AND task<>'es' GROUP BY ALL) b USING (model, task)"""))
def _(spark, d):
    rows = _conditions(spark, d)

    def table(cond, name):
        return acc.accuracy(rows.where((F.col("condition") == name) & cond), overall=["model", "task"]).distinct()

    base, other = table(F.col("task") != "es", "zero_shot"), table(F.lit(True), "cot")
    return rounded(acc.condition_compare(base, other), "other_acc", "base_acc", "drop")


@query("J12_expected_vs_actual", o.with_(o.VALID, CELLS, body="""
SELECT model, task, n, n_correct, round(accuracy,6) AS accuracy, round(0.9-0.06*substr(model,2)::BIGINT,6)::DOUBLE AS expected,
 round(abs(accuracy-round((0.9-0.06*substr(model,2)::BIGINT)::DOUBLE,6)),6) AS diff FROM cells WHERE abs(accuracy-round((0.9-0.06*substr(model,2)::BIGINT)::DOUBLE,6))>0.005"""))
def _(spark, d):
    table = acc.cells(valid(spark, d), ["model", "task"]).withColumn("accuracy", acc.ratio("n_correct", "n"))
    expected = table.select("model", "task", F.round(0.9 - 0.06 * F.substring("model", 2, 9).cast("long"), 6).alias("expected"))
    return rounded(acc.expected_vs_actual(table, expected), "accuracy", "diff")


ERA = "CASE WHEN y>0 AND y<=1999 THEN 'Pre-2000' WHEN y>1999 AND y<=2015 THEN '2000-2015' WHEN y>2015 AND y<=2100 THEN 'Post-2015' END"
ERA_SQL = f"""era AS (SELECT e, model, sum(c)::BIGINT AS n_correct, count(*) AS n FROM (
 SELECT {ERA} AS e, 'm'||m AS model, CASE WHEN (id*7919+m*104729)%1000 < 900-60*m THEN 1 ELSE 0 END AS c
 FROM (SELECT id, try_cast(substr(document,5,4) AS INTEGER) AS y FROM reg_text) CROSS JOIN (SELECT unnest(range(0,6)) AS m) r) WHERE e IS NOT NULL GROUP BY ALL)"""


def reg_eval(spark, d):
    rows = b.reg_text(spark, d).withColumn("_m", F.explode(F.array(*[F.lit(i).cast("long") for i in range(6)])))
    hit = (F.col("id") * 7919 + F.col("_m") * 104729) % 1000 < 900 - 60 * F.col("_m")
    return rows.select(F.col("id").alias("item_id"), "document", F.concat(F.lit("m"), F.col("_m").cast("string")).alias("model"), F.when(hit, 1).otherwise(0).alias("correct"))


@query("A26_accuracy_by_era", o.with_(o.REG, ERA_SQL, body="SELECT e AS era, model, n, n_correct, round(n_correct/n,6) AS accuracy FROM era"))
def _(spark, d):
    return rounded(acc.accuracy_by_era(reg_eval(spark, d), year_from_name("document")), "accuracy")


@query("A26_era_summary", o.with_(o.REG, ERA_SQL, body="SELECT e AS era, round(avg(n_correct/n),6) AS mean_acc, round(stddev_samp(n_correct/n),6) AS std_acc FROM era GROUP BY e"))
def _(spark, d):
    return rounded(acc.era_summary(acc.accuracy_by_era(reg_eval(spark, d), year_from_name("document"))), "mean_acc", "std_acc")


MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATES = rf"\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\b{MONTHS}[a-z]* \d{{4}}|\b\d{{4}}\b"
STEMS = [r"\bsupersed", r"\bamend", r"\bmodif", r"\breplace", r"\bsubstitut", r"\bhereby circu", r"\bin supersession", r"\bin partial modification",
         r"\bwith effect from", r"\beffective from", r"\bprevious circular", r"\bearlier circular", r"\bprior circular"]
REFS = r"\bcircular\b|\bnotification\b|\bdirective\b|\bregulation\b|\bmaster direction\b"
CPX_SQL = f"""cpx0 AS (SELECT id, len(list_distinct(regexp_extract_all(text||' ', '{DATES}'))) AS num_dates,
 {' + '.join(o.count_matches("lower(text)", s) for s in STEMS)} AS amendment_count, {o.count_matches("lower(text)", REFS)} AS circular_refs,
 {o.word_count('text')} AS context_len, len(list_distinct(regexp_extract_all(text, '\\b(?:19[89]\\d|20[0-2]\\d)\\b'))) AS num_years FROM reg_text),
cpx AS (SELECT *, 0.3::DOUBLE*least(num_dates/5,1.0)+0.4::DOUBLE*least(amendment_count/3,1.0)+0.2::DOUBLE*least(num_years/4,1.0)+0.1::DOUBLE*least(circular_refs/5,1.0) AS raw FROM cpx0),
cpt AS (SELECT *, CASE WHEN raw<0.2 THEN 'Low' WHEN raw<0.5 THEN 'Medium' ELSE 'High' END AS complexity_tier FROM cpx)"""


@query("N5_complexity_features", o.with_(o.REG, CPX_SQL, body="""
SELECT id, num_dates, amendment_count, circular_refs, context_len, num_years, round(raw,3) AS complexity_score, complexity_tier FROM cpt"""))
def _(spark, d):
    out = feat.complexity_features(b.reg_text(spark, d), "text", None).drop("text", "document")
    return out.withColumns({c: F.col(c).cast("long") for c in ("num_dates", "amendment_count", "circular_refs", "context_len", "num_years")})


TIER_EVAL = """te AS (SELECT 'm'||m AS model, complexity_tier, raw, CASE WHEN (id*7919+m*104729)%1000 < 900-60*m THEN 1 ELSE 0 END AS correct
 FROM cpt CROSS JOIN (SELECT unnest(range(0,6)) AS m) r)"""


def _tiers(spark, d):
    scored = feat.complexity_features(b.reg_text(spark, d), "text", None).select(F.col("id").alias("item_id"), "complexity_score", "complexity_tier")
    return reg_eval(spark, d).join(scored, "item_id")


@query("A25_accuracy_by_tier", o.with_(o.REG, CPX_SQL, TIER_EVAL, body="SELECT model, " + ", ".join(
    f'round(avg(CASE WHEN complexity_tier=\'{t}\' THEN correct END),6) AS "{t}_acc", count(CASE WHEN complexity_tier=\'{t}\' THEN 1 END) AS "{t}_n"' for t in ("Low", "Medium", "High")) + """,
 round(coalesce(avg(CASE WHEN complexity_tier='Low' THEN correct END),0)-coalesce(avg(CASE WHEN complexity_tier='High' THEN correct END),0),6) AS drop FROM te GROUP BY model"""))
def _(spark, d):
    tiers = acc.accuracy_by_level(_tiers(spark, d), "complexity_tier", ["Low", "Medium", "High"], clean=False)
    return rounded(acc.tier_drop(tiers), "Low_acc", "Medium_acc", "High_acc", "drop")


AUDIT_SQL = """audit AS (SELECT item_id, task, CASE item_id%7 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'CORRECT' ELSE 'INCORRECT' END AS verdict FROM valid WHERE correct=0),
rates AS (SELECT CASE WHEN grouping(task)=1 THEN 'OVERALL' ELSE task END AS task, count(*) AS n, count(*) FILTER (verdict='CORRECT') AS n_correct,
 count(*) FILTER (verdict='PARTIAL') AS n_partial, count(*) FILTER (verdict='INCORRECT') AS n_incorrect FROM audit GROUP BY GROUPING SETS ((task),()))"""


def _audit(spark, d):
    i = F.col("item_id") % 7
    return valid(spark, d).where("correct = 0").withColumn("verdict", F.when((i == 0) | (i == 2), "CORRECT").when(i == 1, "PARTIAL").otherwise("INCORRECT"))


@query("A27_audit_rates", o.with_(o.VALID, AUDIT_SQL, body="""
SELECT *, round(n_correct/n,6) AS fn_rate, round(n_partial/n,6) AS partial_rate, round(n_incorrect/n,6) AS incorrect_rate, round(0.5*n_correct/n,6) AS correction FROM rates"""))
def _(spark, d):
    return rounded(acc.audit_rates(_audit(spark, d)), "fn_rate", "partial_rate", "incorrect_rate", "correction")


@query("A28_fnr_corrected", o.with_(o.VALID, CELLS, AUDIT_SQL, body="""
SELECT c.model, c.task, c.n, c.n_correct, round(c.accuracy,6) AS accuracy, round(r.n_correct/r.n,6) AS fnr,
 round(CASE WHEN r.n_correct/r.n>=1 THEN c.accuracy ELSE least(1.0, c.accuracy/(1-r.n_correct/r.n)) END,6) AS corrected FROM cells c JOIN rates r ON r.task=c.task"""))
def _(spark, d):
    rates = acc.audit_rates(_audit(spark, d))
    table = acc.cells(valid(spark, d), ["model", "task"]).withColumn("accuracy", acc.ratio("n_correct", "n"))
    return rounded(acc.fnr_correct(table, rates), "accuracy", "fnr", "corrected")


RUB_SQL = """rub AS (SELECT model, item_id, item_id%2 AS event_score, (item_id//2)%2 AS ordering_score, correct AS final_score, CASE WHEN item_id%3=0 THEN 1 ELSE correct END AS standard_correct FROM valid)"""


def rubric_rows(spark, d):
    rows = valid(spark, d).select(
        "model", "item_id", (F.col("item_id") % 2).alias("event_score"), (F.floor(F.col("item_id") / 2) % 2).alias("ordering_score"),
        F.col("correct").alias("final_score"), F.when(F.col("item_id") % 3 == 0, 1).otherwise(F.col("correct")).alias("standard_correct"),
    )
    return acc.weighted_rubric(rows)


@query("A29_weighted_rubric", o.with_(o.VALID, RUB_SQL, body="""
SELECT model, round(avg(r),6) AS rubric, round(avg(standard_correct),6) AS standard, round(avg(event_score),6) AS event, round(avg(ordering_score),6) AS ordering,
 round(avg(final_score),6) AS final, round(avg(standard_correct)-avg(r),6) AS gap FROM (SELECT *, round(0.25*event_score+0.25*ordering_score+0.5*final_score,3)::DOUBLE AS r FROM rub) GROUP BY model"""))
def _(spark, d):
    return rounded(acc.rubric_summary(rubric_rows(spark, d)), "rubric", "standard", "event", "ordering", "final", "gap")


def perturbed_predictions(spark, d):
    """Four conditions per item; the answer changes with the condition on some items."""
    rows = valid(spark, d, ["text"])
    conds = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(i).alias("k")) for i, c in enumerate(["original", "date", "number", "synonym"])]))
    rows = rows.withColumn("_c", conds)
    k, i = F.col("_c.k"), F.col("item_id")
    changed = (k > 0) & ((i * (k + 2)) % 4 == 0)
    return rows.select(
        "model", "item_id", "task", F.col("_c.condition").alias("condition"),
        F.when(changed, F.concat(F.lit("changed "), F.col("text"))).otherwise(F.concat(F.lit(" "), F.col("text"), k.cast("string"))).alias("prediction"),
        F.when(changed, 1 - F.col("correct")).otherwise(F.col("correct")).alias("correct"),
    )


ROB_SQL = f"""pp AS (SELECT model, item_id, task, k, CASE WHEN k>0 AND (item_id*(k+2))%4=0 THEN 'changed '||text ELSE ' '||text||k END AS prediction,
 CASE WHEN k>0 AND (item_id*(k+2))%4=0 THEN 1-correct ELSE correct END AS correct FROM valid CROSS JOIN (SELECT unnest(range(0,4)) AS k) t),
op AS (SELECT model, item_id, task, k, left({o.strip('prediction')},50) AS s, correct FROM pp),
rob AS (SELECT a.model, a.item_id, a.task, a.correct AS original_correct, b.correct AS date_correct, c.correct AS number_correct, e.correct AS synonym_correct,
 (a.s=b.s)::INTEGER AS consistency_date, (a.s=c.s)::INTEGER AS consistency_number, (a.s=e.s)::INTEGER AS consistency_synonym
 FROM op a JOIN op b ON (a.model,a.item_id)=(b.model,b.item_id) AND b.k=1 JOIN op c ON (a.model,a.item_id)=(c.model,c.item_id) AND c.k=2
 JOIN op e ON (a.model,a.item_id)=(e.model,e.item_id) AND e.k=3 WHERE a.k=0),
rb AS (SELECT *, (consistency_date+consistency_number+consistency_synonym)/3.0 AS robustness FROM rob)"""
ROB_COLS = ["robustness", "consistency_date", "consistency_number", "consistency_synonym", "original_correct", "date_correct", "number_correct", "synonym_correct"]


@query("A30_robustness", o.with_(o.VALID, ROB_SQL, body="SELECT * REPLACE (round(robustness,6) AS robustness) FROM rb"))
def _(spark, d):
    return rounded(acc.robustness(perturbed_predictions(spark, d)), "robustness")


@query("A30_robustness_by_task", o.with_(o.VALID, ROB_SQL, body="SELECT task, " + ", ".join(f"round(avg({c}),6) AS {c}" for c in ROB_COLS) + " FROM rb GROUP BY task"))
def _(spark, d):
    return rounded(acc.robustness_summary(acc.robustness(perturbed_predictions(spark, d)), ["task"]), *ROB_COLS)
