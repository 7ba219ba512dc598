"""Normalising, matching, extending and ranking tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeframe.functions import bands, parsing
from gradeframe.functions import corpus as cp
from gradeframe.operators import boards, sampling
from gradeframe.operators import documents as dc
from gradeframe.operators import tables as tb
from registry import bindings as b
from registry import oracle as o
from registry import query
from registry.accuracy_queries import rounded, valid
from registry.scoring_queries import TURNS_SQL, turns

RAW_SQL = """raw AS (SELECT doc_id, CASE WHEN doc_id%5=0 THEN 'item_'||doc_id ELSE doc_id::VARCHAR END AS id,
 CASE WHEN lang='es' THEN 'contradiction_detection' ELSE 'temporal_reasoning' END AS task_type,
 CASE doc_id%4 WHEN 0 THEN NULL WHEN 1 THEN 'Easy' WHEN 2 THEN 'MEDIUM' ELSE 'hard' END AS difficulty,
 CASE WHEN doc_id%3=0 THEN NULL ELSE source END AS source, CASE WHEN lang<>'es' THEN text END AS context, CASE WHEN lang='es' THEN text END AS context_a,
 CASE WHEN lang='es' THEN reverse(source) END AS context_b, CASE WHEN doc_id%2=0 THEN 'doc'||doc_id END AS document, CASE WHEN doc_id%6=0 THEN 'da'||doc_id END AS document_a,
 CASE WHEN doc_id%7<3 THEN 'reg'||doc_id END AS regulation, CASE WHEN doc_id%7<3 THEN 'ra'||doc_id END AS regulation_a,
 'Which source is '||source||'?' AS question, source AS answer FROM documents)"""


def raw_items(spark, d):
    i, es = F.col("doc_id"), F.col("lang") == "es"
    s = i.cast("string")
    return b.table(spark, d, "documents").select(
        "doc_id",
        F.when(i % 5 == 0, F.concat(F.lit("item_"), s)).otherwise(s).alias("id"),
        F.when(es, "contradiction_detection").otherwise("temporal_reasoning").alias("task_type"),
        F.when(i % 4 == 1, "Easy").when(i % 4 == 2, "MEDIUM").when(i % 4 == 3, "hard").alias("difficulty"),
        F.when(i % 3 != 0, F.col("source")).alias("source"), F.when(~es, F.col("text")).alias("context"),
        F.when(es, F.col("text")).alias("context_a"), F.when(es, F.reverse("source")).alias("context_b"),
        F.when(i % 2 == 0, F.concat(F.lit("doc"), s)).alias("document"), F.when(i % 6 == 0, F.concat(F.lit("da"), s)).alias("document_a"),
        F.when(i % 7 < 3, F.concat(F.lit("reg"), s)).alias("regulation"), F.when(i % 7 < 3, F.concat(F.lit("ra"), s)).alias("regulation_a"),
        F.concat(F.lit("Which source is "), F.col("source"), F.lit("?")).alias("question"), F.col("source").alias("answer"),
    )


@query("P1_resolve_columns", o.with_(o.PAIRS, body="SELECT item_id AS id, task AS task_type, reference AS ref_answer, prediction, 1 AS correct FROM answer_pairs"))
def _(spark, d):
    odd = b.answer_pairs(spark, d).withColumnsRenamed({"prediction": "model_prediction", "reference": "gold_answer"}).withColumn("Correct", F.lit(1))
    return tb.resolve_columns(odd).select("id", "task_type", "ref_answer", "prediction", "correct")


@query("P4_canonicalise_items", o.with_(RAW_SQL, body="""
SELECT CASE WHEN id LIKE 'item\\_%' ESCAPE '\\' THEN id ELSE 'item_'||id END AS id, task_type, lower(coalesce(difficulty,'medium')) AS difficulty, upper(coalesce(source,'SEBI')) AS source,
 CASE WHEN task_type='contradiction_detection' THEN 'Passage A:'||chr(10)||coalesce(context_a,'')||chr(10)||chr(10)||'Passage B:'||chr(10)||coalesce(context_b,'') ELSE coalesce(context,'') END AS context,
 question, answer AS reference_answer,
 CASE WHEN task_type='contradiction_detection' THEN coalesce(document_a,document,regulation_a,'unknown') ELSE coalesce(document,regulation,'unknown') END AS source_document FROM raw"""))
def _(spark, d):
    return tb.canonicalise_items(raw_items(spark, d))


@query("P5_project_result", "SELECT conv_id, turn, left(question,80) AS question, left(answer,100) AS ref_answer, left(question||answer,200) AS prediction FROM turns".join(["WITH " + TURNS_SQL + "\n", ""]))
def _(spark, d):
    rows = turns(spark, d).select("conv_id", "turn", "question", F.col("answer").alias("ref_answer"), F.concat("question", "answer").alias("prediction"))
    return tb.project_result(rows)


@query("P6_era_bucket", o.with_(o.REG, body="""
SELECT era, count(*) AS n FROM (SELECT CASE WHEN y<=1999 THEN 'Pre-2000' WHEN y<=2015 THEN '2000-2015' ELSE 'Post-2015' END AS era FROM
 (SELECT try_cast(substr(document,5,4) AS INTEGER) AS y FROM reg_text)) GROUP BY era"""))
def _(spark, d):
    return b.reg_text(spark, d).groupBy(bands.era_bucket(cp.year_from_name("document")).alias("era")).agg(F.count(F.lit(1)).alias("n"))


@query("P7_complexity_tier", "SELECT event_id, CASE WHEN value/50<0.2 THEN 'Low' WHEN value/50<0.5 THEN 'Medium' WHEN value IS NOT NULL THEN 'High' END AS tier FROM events")
def _(spark, d):
    return b.table(spark, d, "events").select("event_id", bands.complexity_tier(F.col("value") / 50).alias("tier"))


@query("P8_item_filter", o.with_(o.ITEMS, body="SELECT item_id, task, difficulty FROM items WHERE task='fr' AND difficulty='hard'"))
def _(spark, d):
    return sampling.item_filter(b.items(spark, d), "fr", "Hard", "task").select("item_id", "task", "difficulty")


def arithmetic():
    return (F.col("item_id") * 7919 + 42) % 1000003


@query("P8_pick_one", o.with_(o.ITEMS, body="SELECT item_id, difficulty FROM items WHERE difficulty='medium' ORDER BY (item_id*7919+42)%1000003, item_id LIMIT 1"))
def _(spark, d):
    return sampling.pick_one(sampling.item_filter(b.items(spark, d), "All", "Medium", "task"), "item_id", key=arithmetic()).select("item_id", "difficulty")


@query("P9_P10_bands", """
SELECT event_id, CASE WHEN value>=85 THEN 'PASS' WHEN value>=70 THEN 'BORDERLINE' WHEN value IS NOT NULL THEN 'REVIEW' END AS agreement,
 CASE WHEN value/50-0.1<0 THEN 'poor' WHEN value/50-0.1<0.2 THEN 'slight' WHEN value/50-0.1<0.4 THEN 'fair' WHEN value/50-0.1<0.6 THEN 'moderate'
  WHEN value/50-0.1<0.8 THEN 'substantial' WHEN value IS NOT NULL THEN 'almost perfect' END AS kappa,
 CASE WHEN value/50>0.7 THEN 'Strong' WHEN value/50>0.4 THEN 'Moderate' WHEN value IS NOT NULL THEN 'Weak' END AS w FROM events""")
def _(spark, d):
    v = F.col("value")
    return b.table(spark, d, "events").select(
        "event_id", bands.agreement_band(v).alias("agreement"), bands.kappa_band(v / 50 - 0.1).alias("kappa"), bands.concordance_band(v / 50).alias("w"))


@query("J3_resume_remaining", o.with_(o.EVAL, body="""
SELECT item_id, source FROM items WHERE item_id NOT IN (SELECT item_id FROM eval_long WHERE model='m0' AND correct=1 AND prediction NOT LIKE '%FAIL%')"""))
def _(spark, d):
    done = b.eval_long(spark, d).where("model = 'm0' AND correct = 1")
    return tb.resume_remaining(b.items(spark, d), done).select("item_id", "source")


@query("J3_resume_remaining_composite", o.with_(o.EVAL, body="SELECT item_id, model FROM eval_long WHERE prediction LIKE '%FAIL%' OR correct=0"))
def _(spark, d):
    rows = b.eval_long(spark, d)
    return tb.resume_remaining(rows.select("item_id", "model"), rows.where("correct = 1").select("item_id", "model", "prediction"), ["model", "item_id"]).select("item_id", "model")


@query("J4_attach_predictions", o.with_(o.EVAL, body="""
SELECT i.item_id, coalesce(e.prediction,'') AS prediction, i.task FROM items i LEFT JOIN (SELECT item_id, prediction FROM eval_long WHERE model='m1' AND correct=1) e USING (item_id)"""))
def _(spark, d):
    given = b.eval_long(spark, d).where("model = 'm1' AND correct = 1")
    return tb.attach_predictions(b.items(spark, d).select("item_id", "task"), given)


@query("J4_submission_counts", o.with_(o.EVAL, body="SELECT (SELECT count(*) FROM eval_long WHERE model='m1' AND correct=1) AS n_scored, (SELECT count(*) FROM items) AS n_total"))
def _(spark, d):
    given = b.eval_long(spark, d).where("model = 'm1' AND correct = 1")
    return tb.submission_counts(tb.attach_predictions(b.items(spark, d).select("item_id", "task"), given))


@query("J5_attach_attributes", "SELECT d.doc_id, d.lang, coalesce(quality,-1) AS quality, coalesce(toxic,0) AS toxic FROM documents d LEFT JOIN labels USING (doc_id)")
def _(spark, d):
    return tb.attach_attributes(b.table(spark, d, "documents").select("doc_id", "lang"), b.table(spark, d, "labels"), "doc_id", {"quality": -1, "toxic": 0})


@query("J8_judge_align", o.with_(o.VALID, body="""
SELECT a.item_id, a.model, a.correct AS score_j1, CASE WHEN (a.item_id+substr(a.model,2)::BIGINT)%9=0 THEN 1-a.correct ELSE a.correct END AS score_j2 FROM valid a"""))
def _(spark, d):
    first = valid(spark, d).select("item_id", "model", F.col("correct").alias("score"))
    flip = (F.col("item_id") + F.substring("model", 2, 9).cast("long")) % 9 == 0
    second = first.withColumn("score", F.when(flip, 1 - F.col("score")).otherwise(F.col("score")))
    return tb.judge_align(first, second, ["item_id", "model"], ["score"])


@query("K1_concat_runs", """
SELECT doc_id, lang, NULL::INTEGER AS quality, n_chars FROM documents UNION ALL SELECT doc_id, NULL, quality, NULL FROM labels""")
def _(spark, d):
    return tb.concat_runs(b.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), b.table(spark, d, "labels").select("doc_id", "quality"))


@query("K2_common_items", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(spark, d):
    return tb.common_items(b.table(spark, d, "documents"), b.table(spark, d, "labels"), "doc_id")


@query("K3_pool_without", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return tb.pool_without(b.table(spark, d, "documents"), b.table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query("K4_dedupe", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def _(spark, d):
    return tb.dedupe(b.table(spark, d, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


# The batch carries ids of orders; lines of one order make duplicates, unlabelled ones lack a field.
BATCH_SQL = """batch AS (SELECT 'q'||doc_id AS id, lang AS question, CASE WHEN doc_id%11<>0 THEN source END AS answer FROM documents
 UNION ALL SELECT 'q'||(doc_id*2), 'en', 'src' FROM labels), existing AS (SELECT 'q'||(item_id*50) AS id, text AS question, 'a' AS answer FROM benchmark),
v AS (SELECT id, 'duplicate_in_batch' AS violation FROM batch GROUP BY id HAVING count(*)>1
 UNION ALL SELECT DISTINCT id, 'already_present' FROM batch WHERE id IN (SELECT id FROM existing) UNION ALL SELECT id, 'missing_field' FROM batch WHERE answer IS NULL)"""


def _batch(spark, d):
    q = lambda c: F.concat(F.lit("q"), c.cast("string")).alias("id")
    docs = b.table(spark, d, "documents").select(q(F.col("doc_id")), F.col("lang").alias("question"), F.when(F.col("doc_id") % 11 != 0, F.col("source")).alias("answer"))
    more = b.table(spark, d, "labels").select(q(F.col("doc_id") * 2), F.lit("en").alias("question"), F.lit("src").alias("answer"))
    existing = b.table(spark, d, "benchmark").select(q(F.col("item_id") * 50), F.col("text").alias("question"), F.lit("a").alias("answer"))
    return existing, docs, docs.unionByName(more)


@query("K5_validate_batch", o.with_(BATCH_SQL, body="SELECT id, violation FROM v"))
def _(spark, d):
    existing, _, batch = _batch(spark, d)
    return tb.validate_batch(existing, batch, required=["id", "question", "answer"])


@query("K6_merge_batch_refused", o.with_(BATCH_SQL, body="SELECT id, question, answer FROM existing"))
def _(spark, d):
    existing, _, batch = _batch(spark, d)
    return tb.merge_batch(existing, batch, required=["id", "question", "answer"])


@query("K6_merge_batch", """SELECT 'x'||item_id AS id, text AS question, 'a' AS answer FROM benchmark UNION ALL SELECT 'd'||doc_id, text, source FROM documents""")
def _(spark, d):
    existing = b.table(spark, d, "benchmark").select(F.concat(F.lit("x"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("question"), F.lit("a").alias("answer"))
    batch = b.table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("question"), F.col("source").alias("answer"))
    return tb.merge_batch(existing, batch, required=["id", "question", "answer"])


@query("K7_seed_baselines", o.with_(o.SUBMISSIONS, body="""
SELECT hf_id, overall, NULL::INTEGER AS is_baseline FROM submissions UNION ALL
SELECT 'org/sys'||(c_custkey%80), max(c_acctbal), 1 FROM customer WHERE 'org/sys'||(c_custkey%80) NOT IN (SELECT hf_id FROM submissions) GROUP BY 1"""))
def _(spark, d):
    board = b.submissions(spark, d).select("hf_id", "overall")
    base = b.table(spark, d, "customer").select(F.concat(F.lit("org/sys"), (F.col("c_custkey") % 80).cast("string")).alias("hf_id"), F.col("c_acctbal").alias("overall"))
    return tb.seed_baselines(board, base)


@query("K8_append_result", o.with_(o.SUBMISSIONS, body="""
SELECT hf_id, overall, regexp_extract(hf_id,'[^/]+$') AS model_id, 0 AS is_baseline FROM submissions UNION ALL SELECT 'base/'||p_name, p_retailprice, p_name, 1 FROM part"""))
def _(spark, d):
    board = b.table(spark, d, "part").select(
        F.concat(F.lit("base/"), F.col("p_name")).alias("hf_id"), F.col("p_retailprice").alias("overall"), F.col("p_name").alias("model_id"), F.lit(1).alias("is_baseline"))
    return tb.append_result(board, b.submissions(spark, d).select("hf_id", "overall"))


K9_SQL = """found AS (SELECT page_id, url, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages),
known AS (SELECT 'http://x/'||doc_id AS url, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM documents JOIN pages ON page_id=doc_id AND lang='en'),
fresh AS (SELECT * FROM found WHERE url NOT IN (SELECT url FROM known) AND title NOT IN (SELECT title FROM known))"""


@query("K9_ingest_new_docs", o.with_(K9_SQL, body="""
SELECT page_id, url, title FROM (SELECT unnest(list_reduce(list_prepend({'t': [], 'r': NULL}, list({'t': [{'page_id': page_id, 'url': url, 'title': title}], 'r': NULL} ORDER BY page_id)),
 lambda a, x: CASE WHEN len(list_filter(a.t, lambda y: y.url = x.t[1].url OR y.title = x.t[1].title)) > 0 THEN a ELSE {'t': list_concat(a.t, x.t), 'r': NULL} END).t, recursive := true) FROM fresh)"""))
def _(spark, d):
    title = F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title")
    pages = b.table(spark, d, "pages")
    docs = b.table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("page_id"))
    known = pages.join(docs, "page_id").select(F.concat(F.lit("http://x/"), F.col("page_id").cast("string")).alias("url"), title)
    return tb.ingest_new_docs(known, pages.select("page_id", "url", title), "page_id").select("page_id", "url", "title")


BOARD = """SELECT row_number() OVER (ORDER BY overall DESC, submitted_at, {tie}) AS rank, event_id, hf_id, round(overall*100,1) AS overall, round(score_REG*100,1) AS "score_REG" FROM {src}"""


@query("W1_leaderboard", o.with_(o.SUBMISSIONS, "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hf_id ORDER BY overall DESC, submitted_at, event_id) AS r FROM submissions) WHERE r=1)",
       body=BOARD.format(tie="event_id", src="best")))
def _(spark, d):
    return boards.leaderboard(b.submissions(spark, d), tie="event_id").select("rank", "event_id", "hf_id", "overall", "score_REG")


@query("W1_leaderboard_with_duplicates", o.with_(o.SUBMISSIONS, body=BOARD.format(tie="event_id", src="submissions")))
def _(spark, d):
    return boards.leaderboard(b.submissions(spark, d), include_duplicates=True, tie="event_id").select("rank", "event_id", "hf_id", "overall", "score_REG")


@query("O1_top_docs", f"SELECT doc_id, {o.word_count('text')} AS words FROM documents WHERE {o.word_count('text')}>400 ORDER BY words DESC, doc_id LIMIT 40")
def _(spark, d):
    return dc.top_docs(b.table(spark, d, "documents")).select("doc_id", F.col("words").cast("long").alias("words"))


@query("O3_shuffle", o.with_(o.ITEMS, body="SELECT item_id, task, row_number() OVER (ORDER BY (item_id*7919+42)%1000003, item_id) AS place FROM items"))
def _(spark, d):
    return sampling.shuffled_places(b.items(spark, d), "item_id", key=arithmetic()).select("item_id", "task", "place")


RATER = """lines AS (SELECT doc_id//25 AS sheet, string_agg('Row '||(doc_id%20)||': '||CASE WHEN toxic=1 THEN 'no' ELSE 'YES' END||CASE WHEN doc_id%3=0 THEN ' | q'||quality ELSE '' END, chr(10) ORDER BY doc_id) AS text FROM labels GROUP BY 1)"""


@query("IO7_parse_rater_lines", o.with_(RATER, body="""
SELECT sheet, doc_id%20 AS row_number, CASE WHEN toxic=1 THEN 'NO' ELSE 'YES' END AS label, CASE WHEN doc_id%3=0 THEN 'q'||quality ELSE '' END AS note
FROM (SELECT *, doc_id//25 AS sheet, row_number() OVER (PARTITION BY doc_id//25, doc_id%20 ORDER BY doc_id DESC) AS r FROM labels) WHERE r=1"""))
def _(spark, d):
    i = F.col("doc_id")
    line = F.concat(F.lit("Row "), (i % 20).cast("string"), F.lit(": "), F.when(F.col("toxic") == 1, "no").otherwise("YES"),
                    F.when(i % 3 == 0, F.concat(F.lit(" | q"), F.col("quality").cast("string"))).otherwise(""))
    sheets = b.table(spark, d, "labels").groupBy(F.floor(i / 25).alias("sheet")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(i.alias("i"), line.alias("l")))), lambda s: s["l"]), "\n").alias("text"))
    return parsing.parse_rater_lines(sheets, by=["sheet"])


@query("N1_parse_judge_json", """
SELECT event_id, (event_id%2)::INTEGER AS event_score, ((event_id//2)%2)::INTEGER AS ordering_score, (CASE WHEN value>20 THEN 1 ELSE 0 END)::INTEGER AS final_score
FROM events WHERE event_type<>'error'""")
def _(spark, d):
    e = F.col("event_id")
    reply = F.when(F.col("event_type") == "error", F.concat(F.lit("no json } here {"), F.col("props"))).otherwise(F.format_string(
        'Sure:\n{"event_identification": {"score": "%d", "reason": "{x}"}, "temporal_ordering": {"score": %d}, "final_state_answer": {"score": %d, "reason": "ok"}} done',
        e % 2, F.floor(e / 2) % 2, F.when(F.col("value") > 20, 1).otherwise(0)))
    rows = b.table(spark, d, "events").select("event_id", parsing.judge_scores(reply).alias("s"))
    return rows.where("s IS NOT NULL").select("event_id", "s.*")


VERD = "CASE event_id%6 WHEN 0 THEN ' correct | same: '||event_type WHEN 1 THEN 'INCORRECT|'||props WHEN 2 THEN 'I think it is incorrect' WHEN 3 THEN 'partial match' WHEN 4 THEN 'It is correct.' ELSE event_type END"


@query("N2_parse_verdict", f"""
SELECT event_id, CASE WHEN contains(r,'|') THEN upper(trim(split_part(r,'|',1))) WHEN upper(r) LIKE '%INCORRECT%' THEN 'INCORRECT' WHEN upper(r) LIKE '%CORRECT%' THEN 'CORRECT'
 WHEN upper(r) LIKE '%PARTIAL%' THEN 'PARTIAL' ELSE 'UNKNOWN' END AS verdict, CASE WHEN contains(r,'|') THEN trim(substr(r, position('|' IN r)+1)) ELSE '' END AS reason
FROM (SELECT event_id, {VERD} AS r FROM events)""")
def _(spark, d):
    k = F.col("event_id") % 6
    r = (F.when(k == 0, F.concat(F.lit(" correct | same: "), F.col("event_type"))).when(k == 1, F.concat(F.lit("INCORRECT|"), F.col("props")))
         .when(k == 2, "I think it is incorrect").when(k == 3, "partial match").when(k == 4, "It is correct.").otherwise(F.col("event_type")))
    return b.table(spark, d, "events").select("event_id", parsing.parse_verdict(r).alias("v")).select("event_id", "v.*")


@query("N3_rater_label", """
SELECT event_id, CASE WHEN event_id%5 IN (0,1) THEN 1 WHEN event_id%5 IN (2,3) THEN 0 END::INTEGER AS label FROM events""")
def _(spark, d):
    k = F.col("event_id") % 5
    value = F.when(k == 0, " Yes ").when(k == 1, "1").when(k == 2, "N").when(k == 3, "no").otherwise(F.col("event_type"))
    return b.table(spark, d, "events").select("event_id", parsing.rater_label(value).alias("label"))


@query("N4_explode_scores", o.with_(o.SUBMISSIONS, body="""
SELECT event_id, 'REG' AS task, score_REG AS score FROM submissions UNION ALL SELECT event_id, 'ALL', overall FROM submissions"""))
def _(spark, d):
    rows = b.submissions(spark, d).select("event_id", F.create_map(F.lit("REG"), F.col("score_REG"), F.lit("ALL"), F.col("overall")).alias("scores"))
    return parsing.explode_scores(rows)
