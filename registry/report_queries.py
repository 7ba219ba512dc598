"""The composed reports, table by table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions import scoring
from gradeframe.operators import accuracy as acc
from gradeframe.plans import reports as rp
from registry import bindings as b
from registry import oracle as o
from registry import query
from registry.accuracy_queries import (
    CAT_SQL, GROUPS, RUB_SQL, SQL_GROUPS, STATS_SQL, SQL_TYPES, W, rounded, rubric_rows, valid,
)
from registry.agreement_queries import FLEISS
from registry.corpus_queries import TOPK, run_folder
from registry.pair_queries import AP, TWO, TWO_BODY, TWO_TAIL
from registry.scoring_queries import A34, CON, FUZZY, SP, UNCLEAR, strict_sql
from registry.statistics_queries import RANK

SC = SP + f", sc AS (SELECT item_id, model, task, {strict_sql()} AS correct FROM sp WHERE prediction NOT LIKE '%FAIL%')"


@query("C1_evaluate", "WITH " + SC + """, c AS (SELECT model, CASE WHEN grouping(task)=1 THEN 'OVERALL' ELSE task END AS task, count(*) AS n, sum(correct)::BIGINT AS n_correct FROM sc GROUP BY GROUPING SETS ((model,task),(model)))
SELECT model, task, n, n_correct, """ + ", ".join(f"round({e},6) AS {k}" for k, e in W.items()) + " FROM c")
def _(spark, d):
    rows = b.answer_pairs(spark, d)
    out = rp.evaluate(rows.select("item_id", "task", "reference"), rows.select("item_id", "model", "prediction"))
    return rounded(out["leaderboard"], *W)


BOARD = ", ".join(f"round(avg(CASE WHEN task='{t}' THEN correct END),6) AS {t}" for t in fv.TASKS)


@query("C1_evaluate_board", "WITH " + SC + f", bd AS (SELECT model, {BOARD}, avg(correct) AS accuracy, count(*) AS n, sum(correct)::BIGINT AS n_correct FROM sc GROUP BY model)" + f"""
SELECT row_number() OVER (ORDER BY accuracy DESC, model) AS rank, model, {', '.join(fv.TASKS)}, round(accuracy,6) AS overall, round({W['ci_lower']},6) AS ci_lower, round({W['ci_upper']},6) AS ci_upper, n FROM bd""")
def _(spark, d):
    rows = b.answer_pairs(spark, d)
    out = rp.evaluate(rows.select("item_id", "task", "reference"), rows.select("item_id", "model", "prediction"))["board"]
    return rounded(out, *fv.TASKS, "overall", "ci_lower", "ci_upper")


@query("C2_full_report_intervals", o.with_(o.VALID, "c AS (SELECT model, CASE WHEN grouping(task)=1 THEN 'OVERALL' ELSE task END AS task, count(*) AS n, sum(correct)::BIGINT AS n_correct FROM valid GROUP BY GROUPING SETS ((model,task),(model)))",
       body="SELECT model, task, n, n_correct, " + ", ".join(f"round({e},6) AS {k}" for k, e in W.items()) + " FROM c"))
def _(spark, d):
    return rounded(rp.full_report(valid(spark, d), b.LANGS)["intervals"], *W)


@query("C2_full_report_matrix", o.with_(o.VALID, body="SELECT model, " + ", ".join(
    f"round(avg(CASE WHEN task='{t}' THEN correct END),6) AS {t}" for t in b.LANGS) + ', round(avg(correct),6) AS "Overall" FROM valid GROUP BY model'))
def _(spark, d):
    return rounded(rp.full_report(valid(spark, d), b.LANGS)["matrix"], *b.LANGS, "Overall")


@query("C2_full_report_difficulty", o.with_(o.VALID, body="SELECT model, " + ", ".join(
    f"round(avg(CASE WHEN difficulty='{t}' THEN correct END),6) AS {t}_acc, count(CASE WHEN difficulty='{t}' THEN 1 END) AS {t}_n" for t in b.LEVELS) + " FROM valid GROUP BY model"))
def _(spark, d):
    return rounded(rp.full_report(valid(spark, d), b.LANGS)["difficulty"], *[f"{x}_acc" for x in b.LEVELS])


@query("C2_full_report_significance", o.with_(o.VALID, AP, body="SELECT model_a, model_b, count(*) AS n, round(avg(ca-cb),6) AS delta FROM ap GROUP BY ALL"))
def _(spark, d):
    return rounded(rp.full_report(valid(spark, d), b.LANGS)["significance"].select("model_a", "model_b", "n", "delta"), "delta")


@query("C2_full_report_incomplete_runs", o.with_(o.VALID, body="SELECT model, count(*) AS n FROM valid GROUP BY model HAVING count(*) <> 973"))
def _(spark, d):
    return rp.full_report(valid(spark, d), b.LANGS, expected_rows=973)["incomplete"]


@query("C3_threshold_ablation", "WITH " + A34 + "\nSELECT * FROM agg")
def _(spark, d):
    return rp.threshold_ablation(b.answer_pairs(spark, d))["sweep"]


C4 = SP + f""", g AS (SELECT task, CASE WHEN {CON} THEN ({o.yn('rn', UNCLEAR)}={o.yn('pn', UNCLEAR)})::INTEGER ELSE {FUZZY} END AS agree, {o.yn('rn', UNCLEAR)} AS gl, {o.yn('pn', UNCLEAR)} AS pl FROM sp),
r AS (SELECT CASE WHEN grouping(task)=1 THEN 'OVERALL' ELSE task END AS task, count(*) AS n, sum(agree)::BIGINT AS n_agree, round(100.0*sum(agree)/count(*),6) AS agreement_pct FROM g GROUP BY GROUPING SETS ((task),()))"""


@query("C4_agreement_report", "WITH " + C4 + """, p AS (SELECT gl, pl FROM g WHERE task='contradiction_detection'), m AS (SELECT (SELECT avg((gl=pl)::INT) FROM p) AS po,
 (SELECT sum(a.c*coalesce(b.c,0))/((SELECT count(*) FROM p)::DOUBLE*(SELECT count(*) FROM p)) FROM (SELECT gl AS v, count(*) AS c FROM p GROUP BY 1) a LEFT JOIN (SELECT pl AS v, count(*) AS c FROM p GROUP BY 1) b USING (v)) AS pe)
SELECT r.*, CASE WHEN r.task='contradiction_detection' AND pe<1 THEN round((po-pe)/(1-pe),6) END AS kappa,
 CASE WHEN r.task='contradiction_detection' THEN least((SELECT count(DISTINCT gl) FROM p),(SELECT count(DISTINCT pl) FROM p))<2 END AS constant_labels,
 CASE WHEN agreement_pct>=85 THEN 'PASS' WHEN agreement_pct>=70 THEN 'BORDERLINE' ELSE 'REVIEW' END AS band FROM r, m""")
def _(spark, d):
    return rounded(rp.agreement_report(b.answer_pairs(spark, d))["agreement"], "agreement_pct", "kappa")


@query("C5_multi_rater_report", o.with_(o.RATINGS, FLEISS, body="""
SELECT task, n_items, round(u,6) AS agreement_pct, k AS fleiss_kappa, CASE WHEN k<0 THEN 'poor' WHEN k<0.2 THEN 'slight' WHEN k<0.4 THEN 'fair' WHEN k<0.6 THEN 'moderate' WHEN k<0.8 THEN 'substantial' ELSE 'almost perfect' END AS interpretation
FROM (SELECT *, CASE WHEN pe<1 THEN round((pb-pe)/(1-pe),4) ELSE 1 END AS k FROM f)"""))
def _(spark, d):
    return rounded(rp.multi_rater_report(b.eval_ratings(spark, d), 3)["kappa"], "agreement_pct")


LEVEL_SQL = "CASE (item_id//3)%3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END"
ETYPE = """CASE WHEN task='numerical_reasoning' THEN 'Numerical Reasoning Failure' WHEN task='regulatory_interpretation' AND difficulty='hard' THEN 'Context Grounding Failure'
 WHEN task='contradiction_detection' THEN CASE WHEN difficulty='easy' THEN 'Context Grounding Failure' ELSE 'Temporal Reasoning Failure' END
 WHEN task='temporal_reasoning' AND difficulty<>'hard' THEN 'Temporal Reasoning Failure' ELSE 'Domain Knowledge Failure' END"""


def scored_levels(spark, d):
    rows = scoring.score(acc.drop_failed(b.answer_pairs(spark, d)))
    k = F.floor(F.col("item_id") / 3) % 3
    return rows.withColumn("difficulty", F.when(k == 0, "easy").when(k == 1, "medium").otherwise("hard"))


@query("C6_error_report_taxonomy", "WITH " + SC + f""", lv AS (SELECT *, {LEVEL_SQL} AS difficulty FROM sc), er AS (SELECT model, {ETYPE} AS error_type FROM lv WHERE correct=0)
SELECT m.model, t.error_type, count(er.model) AS count FROM (SELECT DISTINCT model FROM sc) m CROSS JOIN {SQL_TYPES} t LEFT JOIN er ON er.model=m.model AND er.error_type=t.error_type GROUP BY ALL""")
def _(spark, d):
    return rp.error_report(scored_levels(spark, d))["taxonomy"]


@query("C6_error_report_ranking", "WITH " + SC + ", c AS (SELECT model, task, avg(correct) AS a FROM sc GROUP BY ALL) SELECT task, round(avg(a),6) AS mean_acc, count(*) AS n_models FROM c GROUP BY task")
def _(spark, d):
    return rounded(rp.error_report(scored_levels(spark, d))["ranking"], "mean_acc")


@query("C7_item_analysis", o.with_(o.VALID, STATS_SQL, CAT_SQL, body="SELECT item_id, n_correct, n_total, round(accuracy,6) AS accuracy, category FROM cat"))
def _(spark, d):
    return rounded(rp.item_analysis(valid(spark, d))["items"].select("item_id", "n_correct", "n_total", "accuracy", "category"), "accuracy")


@query("C7_item_analysis_summary", o.with_(o.VALID, STATS_SQL, CAT_SQL, body="""
SELECT count(*) FILTER (category='Highly Discriminative') AS highly_discriminative, count(*) FILTER (category='Easy (ceiling)') AS ceiling_items,
 count(*) FILTER (category='Hard (floor)') AS floor_items, round(avg(discrimination),6) AS mean_discrimination, round(quantile_cont(accuracy,0.5),6) AS median_accuracy FROM cat"""))
def _(spark, d):
    return rounded(rp.item_analysis(valid(spark, d))["summary"], "mean_discrimination", "median_accuracy")


C8 = """cx AS (SELECT query_id, left(string_agg('From '||source||': '||text, chr(10)||chr(10)||'---'||chr(10)||chr(10) ORDER BY rank), 3000) AS context FROM hits JOIN documents ON doc_id=vec_id GROUP BY query_id),
np AS (SELECT e.vec_id AS item_id, d.lang AS task, d.source AS rn, regexp_extract(coalesce(context,''),'From ([a-z0-9]+):',1) AS pn FROM embeddings e JOIN documents d ON d.doc_id=e.vec_id LEFT JOIN cx ON cx.query_id=e.vec_id)"""


def _source_of(prompts: list[str]) -> list[str]:
    """A stand-in for a model: the source that the first retrieved text names."""
    found = [re.search("From ([a-z0-9]+):", p) for p in prompts]
    return [f.group(1) if f else "" for f in found]


@query("C8_retrieval_compare", o.with_(TOPK, C8, o.token_set_ratio("np", "item_id"), "sc AS (SELECT task, CASE WHEN contains(pn,rn) OR ratio/100.0>=0.72 THEN 1 ELSE 0 END AS c FROM np JOIN tsr USING (item_id))", body="""
SELECT 'retrieval' AS model, coalesce(task,'OVERALL') AS task, round(avg(c),6) AS other_acc, CASE WHEN task IS NOT NULL THEN 0.9::DOUBLE END AS base_acc, CASE WHEN task IS NOT NULL THEN round(0.9-avg(c),6) END AS drop FROM sc GROUP BY GROUPING SETS ((task),())"""))
def _(spark, d):
    """Which source a document is from, told from the texts of its nearest neighbours."""
    vectors = b.table(spark, d, "embeddings").select("vec_id", "embedding")
    docs = b.table(spark, d, "documents")
    texts = docs.select(F.col("doc_id").alias("vec_id"), F.concat(F.lit("From "), "source", F.lit(": "), "text").alias("text"))
    items = docs.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("task"), F.lit("Which source is it from?").alias("question"), F.col("source").alias("reference"))
    items = items.join(vectors.select(F.col("vec_id").alias("query_id")), "query_id", "left_semi")
    base = items.select(F.lit("retrieval").alias("model"), "task").distinct().withColumn("accuracy", F.lit(0.9))
    out = rp.retrieval_compare(items, vectors.withColumnRenamed("vec_id", "query_id"), vectors, texts, base, predict_batch=_source_of, exclude_self=True)
    return rounded(out["comparison"], "other_acc", "base_acc", "drop")


def perturbed(spark, d):
    """Each regulation in four forms; the answer repeats the perturbed text."""
    items = b.reg_text(spark, d).select(
        F.col("id").alias("item_id"), F.lit("m0").alias("model"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("task"),
        F.lower(F.regexp_extract("text", r"Limit of .*? applies", 0)).alias("reference"), F.col("text").alias("context"), F.lit("").alias("question"))
    return rp.perturbed_items(items).withColumnRenamed("context", "prediction").drop("question")


YEARS = r"\b(?:19[89]\d|20[0-2]\d)\b"


def _c9_sql() -> str:
    from registry.corpus_queries import synonyms_sql

    year = f"""array_to_string(list_transform(list_zip(string_split_regex(text,'{YEARS}'), list_append(list_transform(regexp_extract_all(text,'{YEARS}'), lambda m: CASE WHEN m::INT BETWEEN 1990 AND 2025 THEN (m::INT+5)::VARCHAR ELSE m END), '')), lambda z: z[1]||z[2]), '')"""
    crore = r"""regexp_extract(text,'^(.*?)(\d+\.25) crore(.*)$',1)||round_even(10*regexp_extract(text,'(\d+\.25) crore',1)::DOUBLE,0)::BIGINT||' million'||regexp_extract(text,'^(.*?)(\d+\.25) crore(.*)$',3)"""
    return o.with_(
        o.REG,
        f"""fm AS (SELECT id, 'original' AS condition, text AS p, text FROM reg_text UNION ALL SELECT id, 'date', {year}, text FROM reg_text
 UNION ALL SELECT id, 'number', {crore}, text FROM reg_text UNION ALL SELECT id, 'synonym', {synonyms_sql()}, text FROM reg_text),
np AS (SELECT id||condition AS k, id, condition, {o.strip('p')} AS raw, lower(regexp_extract(text,'Limit of .*? applies')) AS rn, {o.strip('lower(p)')} AS pn FROM fm)""",
        o.token_set_ratio("np", "k"),
        """sc AS (SELECT np.id, condition, left(raw,50) AS s, CASE WHEN contains(pn,rn) OR ratio/100.0>=0.72 THEN 1 ELSE 0 END AS c FROM np JOIN tsr USING (k)),
w AS (SELECT id, max(CASE WHEN condition='original' THEN s END) AS o, max(CASE WHEN condition='date' THEN s END) AS a, max(CASE WHEN condition='number' THEN s END) AS b, max(CASE WHEN condition='synonym' THEN s END) AS e,
 max(CASE WHEN condition='original' THEN c END) AS oc, max(CASE WHEN condition='date' THEN c END) AS ac, max(CASE WHEN condition='number' THEN c END) AS bc, max(CASE WHEN condition='synonym' THEN c END) AS ec FROM sc GROUP BY id)""",
        body="""SELECT CASE WHEN id%2=0 THEN 'even' ELSE 'odd' END AS task, round(avg(((o=a)::INT+(o=b)::INT+(o=e)::INT)/3.0),6) AS robustness, round(avg((o=a)::INT),6) AS consistency_date, round(avg((o=b)::INT),6) AS consistency_number,
 round(avg((o=e)::INT),6) AS consistency_synonym, round(avg(oc),6) AS original_correct, round(avg(ac),6) AS date_correct, round(avg(bc),6) AS number_correct, round(avg(ec),6) AS synonym_correct FROM w GROUP BY 1""",
    )


@query("C9_perturbation_report", _c9_sql())
def _(spark, d):
    out = rp.perturbation_report(perturbed(spark, d))["by_task"]
    return rounded(out, *[c for c in out.columns if c != "task"])


KEY = "(item_id*7919+42)%1000003"
C10 = SC + f""", wr AS (SELECT * FROM sc WHERE correct=0), s1 AS (SELECT item_id, task FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY {KEY}, item_id) AS r FROM wr) WHERE r<=25),
s2 AS (SELECT item_id, task, row_number() OVER (ORDER BY {KEY}, item_id) AS r FROM wr WHERE item_id NOT IN (SELECT item_id FROM s1)),
sm AS (SELECT item_id, task FROM s1 UNION ALL SELECT item_id, task FROM s2 WHERE r<=120-(SELECT count(*) FROM s1)),
au AS (SELECT task, CASE WHEN item_id%11=0 THEN 'UNKNOWN' WHEN item_id%4=0 THEN 'CORRECT' WHEN item_id%4=1 THEN 'PARTIAL' ELSE 'INCORRECT' END AS v FROM sm),
ra AS (SELECT CASE WHEN grouping(task)=1 THEN 'OVERALL' ELSE task END AS task, count(*) AS n, count(*) FILTER (v='CORRECT') AS n_correct, count(*) FILTER (v='PARTIAL') AS n_partial, count(*) FILTER (v='INCORRECT') AS n_incorrect FROM au GROUP BY GROUPING SETS ((task),()))"""


def audited(spark, d):
    """Verdicts of all answers, written once: the sample and the accuracies read them several times."""
    rows = scoring.score(acc.drop_failed(b.answer_pairs(spark, d)))
    return rp.keep(rows.select("item_id", "model", "task", "correct"), run_folder(spark), "verdicts")


@query("C10_scoring_audit", "WITH " + C10 + "\nSELECT *, round(n_correct/n,6) AS fn_rate, round(n_partial/n,6) AS partial_rate, round(n_incorrect/n,6) AS incorrect_rate, round(0.5*n_correct/n,6) AS correction FROM ra")
def _(spark, d):
    rows = audited(spark, d)
    i = F.col("item_id") % 4
    replies = b.answer_pairs(spark, d, partners=False).where("item_id % 11 <> 0").select("item_id", "model", F.when(i == 0, "correct | same").when(i == 1, "Only PARTIAL").when(i == 2, "INCORRECT|no").otherwise("clearly incorrect").alias("reply"))
    order = (F.col("item_id") * 7919 + 42) % 1000003
    out = rp.scoring_audit(rows.where("correct = 0").select("item_id", "model", "task"), replies, 25, 120, order=order)
    return rounded(out["rates"], "fn_rate", "partial_rate", "incorrect_rate", "correction")


AUDITED = ", ac AS (SELECT model, CASE WHEN grouping(task)=1 THEN 'OVERALL' ELSE task END AS task, avg(correct) AS accuracy FROM sc GROUP BY GROUPING SETS ((model,task),(model))), rt AS (SELECT task, n_correct/n AS f FROM ra)"


@query("C10_scoring_audit_corrected", "WITH " + C10 + AUDITED + """, cr AS (SELECT ac.*, coalesce(rt.f, (SELECT f FROM rt WHERE task='OVERALL'), 0.05) AS fnr FROM ac LEFT JOIN rt USING (task))
SELECT model, task, round(accuracy,6) AS accuracy, round(fnr,6) AS fnr, round(CASE WHEN fnr>=1 THEN accuracy ELSE least(1.0, accuracy/(1-fnr)) END,6)::DOUBLE AS corrected FROM cr""")
def _(spark, d):
    rows = audited(spark, d)
    i = F.col("item_id") % 4
    replies = b.answer_pairs(spark, d, partners=False).where("item_id % 11 <> 0").select("item_id", "model", F.when(i == 0, "correct | same").when(i == 1, "Only PARTIAL").when(i == 2, "INCORRECT|no").otherwise("clearly incorrect").alias("reply"))
    accuracies = acc.accuracy(rows, ["model", "task"]).select("model", "task", "accuracy")
    out = rp.scoring_audit(rows.where("correct = 0").select("item_id", "model", "task"), replies, 25, 120, order=(F.col("item_id") * 7919 + 42) % 1000003, accuracies=accuracies)
    return rounded(out["corrected"].select("model", "task", "accuracy", "fnr", "corrected"), "accuracy", "fnr", "corrected")


@query("C11_group_compare_pooled", o.with_(o.VALID, body=f"""
SELECT {SQL_GROUPS} AS "group", task, count(*) AS n, sum(correct)::BIGINT AS n_correct, round(avg(correct),6) AS accuracy FROM valid WHERE {SQL_GROUPS} IS NOT NULL GROUP BY ALL"""))
def _(spark, d):
    return rounded(rp.group_compare(valid(spark, d), GROUPS, "reasoning", "standard")["pooled"], "accuracy")


@query("C11_group_compare_significance", o.with_(o.VALID, TWO, TWO_TAIL, body=TWO_BODY))
def _(spark, d):
    return rounded(rp.group_compare(valid(spark, d), GROUPS, "reasoning", "standard")["significance"], "acc_a", "acc_b", "p_value")


Q2 = chr(39) * 2
C12 = SP + f""", st AS (SELECT task, CASE WHEN rn=pn THEN 1 WHEN {CON} AND {o.yn('rn', Q2)}<>'' AND {o.yn('pn', Q2)}<>'' THEN ({o.yn('rn', Q2)}={o.yn('pn', Q2)})::INTEGER
 WHEN {o.same(o.numbers('rn'), o.numbers('pn'))} THEN 1 WHEN ratio/100.0>=0.72 THEN 1 ELSE 0 END AS c FROM sp WHERE trim(prediction)<>'')"""


@query("C12_human_baseline", "WITH " + C12 + """
SELECT CASE WHEN grouping(task)=1 THEN 'OVERALL' ELSE task END AS task, count(*) AS n, sum(c)::BIGINT AS n_correct, round(avg(c),6) AS accuracy FROM st GROUP BY GROUPING SETS ((task),())""")
def _(spark, d):
    rows = b.answer_pairs(spark, d)
    out = rp.human_baseline(rows.select("item_id", "task", "prediction"), rows.select("item_id", "reference"))
    return rounded(out["by_task"], "accuracy")


@query("C12_human_baseline_gap", "WITH " + C12 + """, g AS (SELECT count(*) AS n, sum(c)::BIGINT AS n_correct, avg(c) AS a, round(100*avg(c)-91.3,4) AS gap FROM st)
SELECT 'OVERALL' AS task, n, n_correct, round(a,6) AS accuracy, gap, CASE WHEN gap>3 THEN 'substantial room for model improvement' WHEN gap<-3 THEN 'near-human or above-human parity on this subset' ELSE 'near-human parity on this subset' END AS reading FROM g""")
def _(spark, d):
    rows = b.answer_pairs(spark, d)
    return rounded(rp.human_baseline(rows.select("item_id", "task", "prediction"), rows.select("item_id", "reference"))["gap"], "accuracy")


C13 = f"""j AS (SELECT round(0.25*event_score+0.25*ordering_score+0.5*final_score,3)::DOUBLE AS r1, final_score AS f1,
 round(0.25*event_score+0.25*ordering_score+0.5*CASE WHEN item_id%8=0 THEN 1-final_score ELSE final_score END,3)::DOUBLE AS r2, CASE WHEN item_id%8=0 THEN 1-final_score ELSE final_score END AS f2 FROM rub),
jr AS (SELECT *, 1 AS one FROM j), k AS (SELECT {RANK.format(p='one', v='r1')} AS a, {RANK.format(p='one', v='r2')} AS b FROM jr),
m AS (SELECT avg((f1=f2)::INT) AS po, avg(f1)*avg(f2)+(1-avg(f1))*(1-avg(f2)) AS pe FROM j)"""


@query("C13_judge_agreement", o.with_(o.VALID, RUB_SQL, C13, body="""
SELECT (SELECT count(*) FROM j) AS n, (SELECT round(corr(r1,r2),6) FROM j) AS pearson_r, (SELECT round(corr(a,b),6) FROM k) AS spearman_r, (SELECT round((po-pe)/(1-pe),6) FROM m) AS kappa_final"""))
def _(spark, d):
    first = rubric_rows(spark, d)
    flip = F.when(F.col("item_id") % 8 == 0, 1 - F.col("final_score")).otherwise(F.col("final_score"))
    second = acc.weighted_rubric(first.withColumn("final_score", flip))
    return rounded(rp.judge_agreement(first, second, p_value=False), "pearson_r", "spearman_r", "kappa_final")


