"""Text scoring over ``answer_pairs``, conversations and document names."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.functions import bands, fuzzy, scoring
from gradeframe.functions import text as t
from gradeframe.operators import accuracy as acc
from registry import bindings as b
from registry import oracle as o
from registry import query
from registry.accuracy_queries import rounded

TURNS_SQL = """turns AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u
 JOIN conversations a ON a.conv_id=u.conv_id AND a.turn=u.turn+1 AND a.role='assistant' WHERE u.role='user')"""


def turns(spark, d):
    c = b.table(spark, d, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return user.join(reply, ["conv_id", "turn"])


@query("T1_normalise", f"SELECT doc_id, {o.normalise('text')} AS norm FROM documents")
def _(spark, d):
    return b.table(spark, d, "documents").select("doc_id", t.normalise("text").alias("norm"))


@query("T2_number_set", f"SELECT doc_id, array_to_string({o.numbers(o.normalise('text'))}, ' ') AS numbers FROM documents")
def _(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.array_join(t.number_set(t.normalise("text")), " ").alias("numbers"))


@query("T3_number_set_lenient", f"SELECT doc_id, array_to_string({o.lenient_numbers('text')}, ' ') AS numbers FROM documents")
def _(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.array_join(t.number_set_lenient("text"), " ").alias("numbers"))


NP = f"np AS (SELECT *, {o.normalise('reference')} AS rn, {o.normalise('prediction')} AS pn FROM answer_pairs)"


@query("T4_yn_label", o.with_(o.PAIRS, NP, body=f"SELECT item_id, {o.yn('rn','rn')} AS ref_label, {o.yn('pn', chr(39)+'unclear'+chr(39))} AS pred_label FROM np"))
def _(spark, d):
    return b.answer_pairs(spark, d).select(
        "item_id", t.yn_label(t.normalise("reference")).alias("ref_label"), t.yn_label(t.normalise("prediction"), "unclear").alias("pred_label"))


@query("T5_yn_first", o.with_(o.EVAL, body=r"SELECT item_id, model, regexp_extract(lower(prediction||' '||text), '\b(yes|no)\b', 1) AS yn FROM eval_long"))
def _(spark, d):
    rows = b.eval_long(spark, d, ["text"])
    return rows.select("item_id", "model", t.yn_first(F.concat("prediction", F.lit(" "), "text")).alias("yn"))


@query("T6_exact_match", o.with_(o.PAIRS, NP, body="SELECT item_id, rn=pn AS exact, (rn=pn OR pn='' OR pn=rn||' .') AS exact_any FROM np"))
def _(spark, d):
    rows = b.answer_pairs(spark, d).withColumn("variants", F.array(F.lit("!!"), F.concat("reference", F.lit(" ."))))
    return rows.select("item_id", t.exact_match("reference", "prediction").alias("exact"), t.exact_match_any("reference", "variants", "prediction").alias("exact_any"))


F1_SQL = """tok AS (SELECT item_id, s, w, count(*) AS c FROM (SELECT item_id, 'g' AS s, unnest(string_split(rn,' ')) AS w FROM np UNION ALL SELECT item_id, 'p', unnest(string_split(pn,' ')) FROM np) WHERE w<>'' GROUP BY ALL),
ov AS (SELECT g.item_id, sum(least(g.c,p.c)) AS common FROM tok g JOIN tok p ON g.item_id=p.item_id AND g.w=p.w AND g.s='g' AND p.s='p' GROUP BY 1),
sz AS (SELECT item_id, sum(c) AS total FROM tok GROUP BY 1)"""


@query("T7_token_f1", o.with_(o.PAIRS, NP, F1_SQL, body="SELECT np.item_id, round(coalesce(2.0*common/total,0)::DOUBLE,6) AS f1 FROM np LEFT JOIN ov USING (item_id) LEFT JOIN sz USING (item_id)"))
def _(spark, d):
    rows = b.answer_pairs(spark, d).select("item_id", t.normalise("reference").alias("g"), t.normalise("prediction").alias("p"))
    return rows.select("item_id", F.round(t.token_f1("g", "p"), 6).alias("f1"))


SP = o.scored_pairs()
SAME = o.same(o.numbers("rn"), o.numbers("pn"))
BAD = "(prediction='' OR lower(prediction) LIKE '%fail:%')"
CBD = f"({BAD} OR lower(prediction) LIKE '%cannot be determined%')"
CON = "task='contradiction_detection'"


@query("T8_token_set_ratio", "WITH " + SP + "\nSELECT item_id, round(ratio,6) AS ratio FROM sp")
def _(spark, d):
    rows = b.answer_pairs(spark, d).select("item_id", t.normalise("reference").alias("r"), t.normalise("prediction").alias("p"))
    return rounded(fuzzy.token_set_ratio(rows, "r", "p", spaced=True).select("item_id", "ratio"), "ratio")


CASES = f"cs AS (SELECT p_partkey, p_name AS a, p_brand||' '||p_type AS b FROM part)"


@query("U1_common_subsequence", o.with_(CASES, body=f"SELECT p_partkey, {o.lcs('a', 'b')} AS length FROM cs"))
def _(spark, d):
    rows = b.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.concat("p_brand", F.lit(" "), "p_type").alias("b"))
    return rows.select("p_partkey", fuzzy.common_subsequence("a", "b").alias("length"))


def strict_sql(threshold: str = "0.72", guard: str = CBD) -> str:
    return f"""CASE WHEN {guard} THEN 0 WHEN {CON} THEN ({o.yn('rn','rn')} = {o.yn('pn','pn')})::INTEGER
 WHEN {SAME} THEN 1 WHEN ratio/100.0 >= {threshold} THEN 1 ELSE 0 END"""


FUZZY = f"CASE WHEN rn='' OR pn='' THEN 0 WHEN rn=pn THEN 1 WHEN {SAME} THEN 1 WHEN ratio/100.0>=0.72 THEN 1 ELSE 0 END"


@query("T9_fuzzy_match", "WITH " + SP + f"\nSELECT item_id, {FUZZY} AS correct FROM sp")
def _(spark, d):
    return scoring.score(b.answer_pairs(spark, d), "fuzzy").select("item_id", "correct")


@query("T10_score_strict", "WITH " + SP + f"\nSELECT item_id, {strict_sql()} AS correct FROM sp")
def _(spark, d):
    return scoring.score(b.answer_pairs(spark, d), "strict").select("item_id", "correct")


@query("T10b_score_strict_nocbd", "WITH " + SP + f"\nSELECT item_id, {strict_sql(guard=BAD)} AS correct FROM sp")
def _(spark, d):
    return scoring.score(b.answer_pairs(spark, d), "strict_nocbd").select("item_id", "correct")


UNCLEAR = chr(39) + "unclear" + chr(39)


@query("T11_score_demo", "WITH " + SP + f"""
SELECT item_id, CASE WHEN {CBD} THEN 0 WHEN {CON} THEN ({o.yn('rn', UNCLEAR)}={o.yn('pn', UNCLEAR)} AND {o.yn('rn', UNCLEAR)}<>'unclear')::INTEGER
 WHEN rn=pn OR pn=rn||' .' THEN 1 ELSE {FUZZY} END AS correct FROM sp""")
def _(spark, d):
    rows = b.answer_pairs(spark, d).withColumn("variants", F.array(F.concat("reference", F.lit(" ."))))
    return scoring.score(rows, "demo", variants="variants").select("item_id", "correct")


LOW = o.PAIRS + f""",
np AS (SELECT *, {o.strip("lower(reference)")} AS rn, {o.strip("lower(prediction)")} AS pn FROM answer_pairs),
""" + o.token_set_ratio("np", "item_id") + ", sp AS (SELECT np.*, tsr.ratio FROM np JOIN tsr USING (item_id))"
LSAME = o.same(o.lenient_numbers("rn"), o.lenient_numbers("pn"))


@query("T12_score_lenient", "WITH " + LOW + rf"""
SELECT item_id, CASE WHEN rn=pn THEN 1 WHEN ratio>=72 THEN 1 WHEN {LSAME} THEN 1
 WHEN {CON} THEN CASE WHEN regexp_extract(rn,'\b(yes|no)\b',1)<>'' AND regexp_extract(rn,'\b(yes|no)\b',1)=regexp_extract(pn,'\b(yes|no)\b',1) THEN 1 ELSE 0 END ELSE 0 END AS correct FROM sp""")
def _(spark, d):
    return scoring.score(b.answer_pairs(spark, d), "lenient").select("item_id", "correct")


STAGE = f"""CASE WHEN rn=pn THEN 'exact' WHEN {CON} AND {o.yn('rn', chr(39)*2)}<>'' AND {o.yn('pn', chr(39)*2)}<>''
 THEN CASE WHEN {o.yn('rn', chr(39)*2)}={o.yn('pn', chr(39)*2)} THEN 'yn' ELSE 'yn_miss' END WHEN {SAME} THEN 'numerical' WHEN ratio/100.0>=0.72 THEN 'fuzzy' ELSE 'incorrect' END"""


@query("T13_score_with_stage", "WITH " + SP + f"\nSELECT item_id, stage, (stage NOT IN ('yn_miss','incorrect'))::INTEGER AS correct FROM (SELECT item_id, {STAGE} AS stage FROM sp)")
def _(spark, d):
    return scoring.score_with_stage(b.answer_pairs(spark, d)).select("item_id", "stage", "correct")


@query("T14_score_containment", "WITH " + LOW + "\nSELECT item_id, CASE WHEN contains(pn, rn) OR ratio/100.0>=0.72 THEN 1 ELSE 0 END AS correct FROM sp")
def _(spark, d):
    return scoring.score(b.answer_pairs(spark, d), "containment").select("item_id", "correct")


TH = "(SELECT unnest([0.60,0.65,0.68,0.70,0.72,0.75,0.78,0.80,0.85]::DOUBLE[]) AS threshold)"
GOODP = "lower(prediction) NOT LIKE '%fail%'"


@query("J9_sweep", "WITH " + SP + f"\nSELECT item_id, model, task, threshold, {strict_sql('threshold', BAD)} AS match FROM sp CROSS JOIN {TH} WHERE {GOODP}")
def _(spark, d):
    rows, verdicts = scoring.sweep_verdicts(acc.drop_failed(b.answer_pairs(spark, d), any_case=True))
    return acc.sweep(rows, verdicts).select("item_id", "model", "task", "threshold", "match")


A34 = SP + f""", sw AS (SELECT model, task, threshold, {strict_sql('threshold', BAD)} AS match FROM sp CROSS JOIN {TH} WHERE {GOODP}),
agg AS (SELECT CASE WHEN grouping(model)=1 THEN 'OVERALL' ELSE model END AS model, CASE WHEN grouping(task)=1 THEN 'OVERALL' ELSE task END AS task, threshold,
 count(*) AS n, sum(match)::BIGINT AS n_correct, round(100.0*sum(match)/count(*),2) AS accuracy FROM sw GROUP BY GROUPING SETS ((threshold),(threshold,task),(threshold,model)))"""


def _sweep(spark, d):
    rows, verdicts = scoring.sweep_verdicts(acc.drop_failed(b.answer_pairs(spark, d), any_case=True))
    return acc.sweep_accuracy(rows, verdicts)


@query("A34_sweep_accuracy", "WITH " + A34 + "\nSELECT * FROM agg")
def _(spark, d):
    return _sweep(spark, d)


@query("A34_stability_swing", "WITH " + A34 + "\nSELECT round(max(accuracy)-min(accuracy),6) AS swing FROM agg WHERE model='OVERALL' AND task='OVERALL' AND threshold BETWEEN 0.68 AND 0.75")
def _(spark, d):
    return rounded(acc.stability_swing(_sweep(spark, d)), "swing")


# Numeric answers with spelling variants, from orders.
NUM_SQL = """num AS (SELECT o_orderkey AS item_id, CASE o_orderkey%3 WHEN 0 THEN 'numerical_reasoning' WHEN 1 THEN 'numerical_reasoning' ELSE 'temporal_reasoning' END AS task,
 CASE o_orderkey%4 WHEN 0 THEN 'Rs. '||(o_custkey+1000)||'.50 crore rupees (see note)' WHEN 1 THEN strftime(o_orderdate,'%d %B %Y')||'. Calculation: none'
  WHEN 2 THEN (o_custkey%90)||'.00%' ELSE 'within 12,'||lpad((o_custkey%1000)::VARCHAR,3,'0')||' days' END AS reference,
 CASE o_orderkey%5 WHEN 0 THEN 'no idea' ELSE CASE o_orderkey%4 WHEN 0 THEN (o_custkey+1000)||'.5 crore' WHEN 1 THEN 'by '||strftime(o_orderdate,'%d %m %Y')
  WHEN 2 THEN (o_custkey%90)||'%' ELSE '12'||lpad((o_custkey%1000)::VARCHAR,3,'0') END END AS prediction, (o_orderkey%7=0)::INTEGER AS agree FROM orders)"""


def numeric_answers(spark, d):
    r = b.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: x.cast("string")
    pad = F.lpad(s(c % 1000), 3, "0")
    ref = (
        F.when(k % 4 == 0, F.concat(F.lit("Rs. "), s(c + 1000), F.lit(".50 crore rupees (see note)")))
        .when(k % 4 == 1, F.concat(F.date_format("o_orderdate", "dd MMMM yyyy"), F.lit(". Calculation: none")))
        .when(k % 4 == 2, F.concat(s(c % 90), F.lit(".00%"))).otherwise(F.concat(F.lit("within 12,"), pad, F.lit(" days")))
    )
    pred = (
        F.when(k % 5 == 0, "no idea").when(k % 4 == 0, F.concat(s(c + 1000), F.lit(".5 crore")))
        .when(k % 4 == 1, F.concat(F.lit("by "), F.date_format("o_orderdate", "dd MM yyyy")))
        .when(k % 4 == 2, F.concat(s(c % 90), F.lit("%"))).otherwise(F.concat(F.lit("12"), pad))
    )
    task = F.when(k % 3 == 2, "temporal_reasoning").otherwise("numerical_reasoning")
    return r.select(k.alias("item_id"), task.alias("task"), ref.alias("reference"), pred.alias("prediction"), (k % 7 == 0).cast("int").alias("agree"))


def canonical_sql(x: str) -> str:
    out = rf"regexp_extract({o.strip(f'lower({x})')}, '^[^(\[]*')"
    out = rf"regexp_replace({out}, '\b(calculation|reason|note|i\.e\.|i\.e|viz\.?).*', '', 'g')"
    out = f"rtrim({o.strip(out)}, '.,;')"
    rules = [(r"[₹]|rs\.?\s*", ""), (r"crore\s+rupees?", "crore"), (r"(\d),(\d{3})", r"\1\2"), (r"(\d+\.\d*?)0+\b", r"\1"), (r"(\d+)\.$", r"\1")]
    for i, m in enumerate("january february march april may june july august september october november december".split(), 1):
        rules.append((rf"\b(?:{m}|{m[:3]})\b", f"{i:02d}"))
    rules.append((r"\b(by|on|from|before|after)\b\s+", ""))
    for pattern, to in rules:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return o.strip(out)


CAN = f"can AS (SELECT *, {canonical_sql('reference')} AS cr, {canonical_sql('prediction')} AS cp FROM num)"
NUMS = [rf"list_sort(list_distinct(regexp_extract_all(translate({x},'₹,%',''), '\p{{Nd}}+(?:\.\p{{Nd}}+)?')))" for x in ("cr", "cp")]
MATCH = f"(cr=cp OR (cr<>'' AND cp<>'' AND (contains(cr,cp) OR contains(cp,cr))) OR {o.same(*NUMS)})"


@query("T15_canonical_answer", o.with_(NUM_SQL, CAN, body="SELECT item_id, cr, cp FROM can"))
def _(spark, d):
    return numeric_answers(spark, d).select("item_id", t.canonical_answer("reference").alias("cr"), t.canonical_answer("prediction").alias("cp"))


@query("T16_answers_match", o.with_(NUM_SQL, CAN, body=f"SELECT item_id, {MATCH} AS match FROM can"))
def _(spark, d):
    rows = numeric_answers(spark, d).select("item_id", t.canonical_answer("reference").alias("cr"), t.canonical_answer("prediction").alias("cp"))
    return rows.select("item_id", t.answers_match("cr", "cp").alias("match"))


@query("T17_rescore_upgrade_only", o.with_(NUM_SQL, CAN, body=f"""
SELECT item_id, CASE WHEN task='numerical_reasoning' AND agree=0 AND {MATCH} THEN 1 ELSE agree END AS agree,
 CASE WHEN task='numerical_reasoning' AND agree=0 AND {MATCH} THEN 1 ELSE 0 END AS changed FROM can"""))
def _(spark, d):
    return scoring.rescore_upgrade_only(numeric_answers(spark, d)).select("item_id", "agree", "changed")


@query("T17_changed_count", o.with_(NUM_SQL, CAN, body=f"SELECT task, count(*) FILTER (task='numerical_reasoning' AND agree=0 AND {MATCH}) AS n_changed FROM can GROUP BY task"))
def _(spark, d):
    return scoring.rescore_upgrade_only(numeric_answers(spark, d)).groupBy("task").agg(F.sum("changed").alias("n_changed"))


THINK = "'<think>'||text||chr(10)||'x</think>'||CASE WHEN doc_id%5=0 THEN ' ' ELSE ' '||text||'<think>again</think>' END"


@query("T18_strip_think", f"""
SELECT doc_id, CASE WHEN x='' THEN 'FAIL: empty after reasoning' ELSE x END AS answer
FROM (SELECT doc_id, {o.strip(f"regexp_replace({THINK}, '(?s)<think>.*?</think>', '', 'g')")} AS x FROM documents)""")
def _(spark, d):
    text = F.concat(F.lit("<think>"), "text", F.lit("\nx</think>"),
                    F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "text", F.lit("<think>again</think>"))))
    return b.table(spark, d, "documents").select("doc_id", t.strip_think(text).alias("answer"))


RAW = "CASE conv_id%4 WHEN 0 THEN 'The answer is: ' WHEN 1 THEN 'Based on the text, ' WHEN 2 THEN ' According to it ' ELSE '' END||answer"


def raw_answers(spark, d):
    head = F.when(F.col("conv_id") % 4 == 0, "The answer is: ").when(F.col("conv_id") % 4 == 1, "Based on the text, ").when(F.col("conv_id") % 4 == 2, " According to it ").otherwise("")
    task = F.when(F.col("turn") % 4 == 0, "contradiction_detection").otherwise("temporal_reasoning")
    return turns(spark, d).select("conv_id", "turn", task.alias("task"), F.concat(head, F.col("answer")).alias("raw"))


def extract_sql() -> str:
    x = o.strip("raw")
    for p in (r"(?im)^(the\s+)?answer\s+(is|:)\s*", r"(?im)^based on .*?,?\s*", r"(?im)^according to .*?,?\s*", r"(?im)^from the (context|passage).*?,?\s*"):
        x = o.strip(f"regexp_replace({x}, '{p}', '', 'g')")
    return x


@query("T19_extract_answer", o.with_(TURNS_SQL, f"raws AS (SELECT conv_id, turn, CASE WHEN turn%4=0 THEN 'contradiction_detection' ELSE 'temporal_reasoning' END AS task, {RAW} AS raw FROM turns)",
       f"ex AS (SELECT *, {extract_sql()} AS x FROM raws)", body=f"""
SELECT conv_id, turn, CASE WHEN task='contradiction_detection' THEN {o.strip("split_part(x, chr(10), 1)")} ELSE {o.strip("left(x,200)")} END AS answer FROM ex"""))
def _(spark, d):
    return raw_answers(spark, d).select("conv_id", "turn", t.extract_answer("raw", "task").alias("answer"))


COT = "CASE WHEN conv_id%2=0 THEN answer||chr(10)||'Answer: '||question||chr(10)||'end' ELSE answer||chr(10)||chr(10)||' '||question||chr(10) END"


AFTER_MARKER = r"regexp_extract(raw, '(?is)ANSWER:\s*(.+?)(?:\n|$)', 1)"


@query("T20_extract_cot_answer", o.with_(TURNS_SQL, f"cot AS (SELECT conv_id, turn, {COT} AS raw FROM turns)",
       f"l AS (SELECT *, list_filter(list_transform(string_split(raw, chr(10)), lambda s: {o.strip('s')}), lambda s: s<>'') AS lines FROM cot)", body=rf"""
SELECT conv_id, turn, CASE WHEN regexp_matches(raw, '(?is)ANSWER:\s*(.+?)(?:\n|$)') THEN {o.strip(AFTER_MARKER)} ELSE lines[-1] END AS answer FROM l"""))
def _(spark, d):
    raw = F.when(F.col("conv_id") % 2 == 0, F.concat("answer", F.lit("\nAnswer: "), F.col("question"), F.lit("\nend"))).otherwise(
        F.concat("answer", F.lit("\n\n "), F.col("question"), F.lit("\n")))
    return turns(spark, d).withColumn("raw", raw).select("conv_id", "turn", t.extract_cot_answer("raw").alias("answer"))


@query("T21_truncate_words", f"SELECT doc_id, array_to_string({o.words('text')}[1:450], ' ') AS cut FROM documents")
def _(spark, d):
    return b.table(spark, d, "documents").select("doc_id", t.truncate_words("text", 450).alias("cut"))


@query("P3_task_filter_and_code", o.with_(o.PAIRS, body="""
SELECT item_id, lower(task) LIKE '%temporal%' AS is_temporal, CASE task WHEN 'regulatory_interpretation' THEN 'REG' WHEN 'numerical_reasoning' THEN 'NUM'
 WHEN 'contradiction_detection' THEN 'CON' ELSE 'TMP' END AS code FROM answer_pairs"""))
def _(spark, d):
    return b.answer_pairs(spark, d).select("item_id", bands.task_filter("task", "TEMPORAL").alias("is_temporal"), bands.task_code("task").alias("code"))


@query("P2_drop_failed", o.with_(o.PAIRS, body="SELECT item_id, lower(prediction) NOT LIKE '%fail%' AS any_case FROM answer_pairs WHERE prediction NOT LIKE '%FAIL%'"))
def _(spark, d):
    kept = acc.drop_failed(b.answer_pairs(spark, d))
    strict = acc.drop_failed(b.answer_pairs(spark, d), any_case=True).select("item_id", F.lit(True).alias("any_case"))
    return kept.select("item_id").join(strict, "item_id", "left").select("item_id", F.coalesce("any_case", F.lit(False)).alias("any_case"))
