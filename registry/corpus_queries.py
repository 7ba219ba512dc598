"""Documents, pages, prompts, features, perturbations, retrieval and streams."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from gradeframe.functions import corpus as cp
from gradeframe.functions import features as feat
from gradeframe.functions import prompts as pm
from gradeframe.functions import text as t
from gradeframe.functions.predictor import apply_predictor
from gradeframe.functions.scoring import score
from gradeframe.functions.table_functions import register_chunk_words
from gradeframe.operators import documents as dc
from gradeframe.operators import retrieval as rt
from gradeframe.operators import sampling as sm
from gradeframe.operators.ranks import spread_join
from gradeframe.session import ensure_checkpoint_dir
from gradeframe.streaming import flows
from registry import bindings as b
from registry import oracle as o
from registry import query
from registry.accuracy_queries import rounded, valid
from registry.scoring_queries import TURNS_SQL, strict_sql, turns

JUNK = r"[\x00-\x08\x0b-\x1f\x7f-\x{9f}\x{ad}\x{600}-\x{605}\x{200b}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{feff}\x{a0}\x{1680}\x{2000}-\x{200a}\x{3000}\x{e000}-\x{f8ff}]"


def clean_sql(x: str) -> str:
    text = f"translate(regexp_replace(coalesce({x},''), '{JUNK}', '', 'g'), '–—‘’“”', '--''''\"\"')"
    lines = f"list_transform(string_split({text}, chr(10)), lambda s: {o.strip('s')})"
    return rf"array_to_string(list_filter({lines}, lambda s: length(s)>=3 AND NOT regexp_matches(s, '(?i)^(page\s+)?\d+(\s+of\s+\d+)?$')), chr(10))"


@query("T22_clean_text", f"SELECT doc_id, {clean_sql('text')} AS clean FROM documents")
def _(spark, d):
    return b.table(spark, d, "documents").select("doc_id", cp.clean_text("text").alias("clean"))


@query("T22_clean_text_pages", f"SELECT page_id, {clean_sql('numbered')} AS clean FROM (SELECT page_id, 'Page 3 of 9'||chr(10)||replace(html,'>','>'||chr(10))||chr(10)||' 12 '||chr(7)||'–' AS numbered FROM pages)")
def _(spark, d):
    text = F.concat(F.lit("Page 3 of 9\n"), F.replace("html", F.lit(">"), F.lit(">\n")), F.lit("\n 12 \x07–"))
    return b.table(spark, d, "pages").select("page_id", cp.clean_text(text).alias("clean"))


REP = f"rep AS (SELECT doc_id, {o.word_count(clean_sql('text'))} AS word_count, source, lang FROM documents), rp AS (SELECT *, CASE WHEN word_count>=50 THEN 'success' ELSE 'empty' END AS status FROM rep)"


def report(spark, d):
    return cp.parse_report(b.table(spark, d, "documents").select("doc_id", "source", "lang", "text"))


@query("T23_parse_report", o.with_(REP, body="SELECT doc_id, word_count, status, CASE WHEN status='success' AND word_count=0 THEN 'empty' ELSE status END AS effective FROM rp"))
def _(spark, d):
    return report(spark, d).select("doc_id", F.col("word_count").cast("long").alias("word_count"), "status", cp.effective_status("status", "word_count").alias("effective"))


@query("T24_extract_year", o.with_(o.REG, body=r"""
SELECT id, try_cast(regexp_extract(document,'(?:^|[^0-9])(19[89][0-9]|20[0-2][0-9])(?:[^0-9]|$)',1) AS INTEGER) AS name_year, try_cast(regexp_extract(text,'\b((?:19|20)\d{2})\b',1) AS INTEGER) AS text_year FROM reg_text"""))
def _(spark, d):
    return b.reg_text(spark, d).select("id", cp.year_from_name("document").alias("name_year"), cp.year_from_date("text").alias("text_year"))


@query("T25_infer_category", o.with_(o.REG, body="""
SELECT id, CASE WHEN document LIKE '%circular%' THEN 'Circular' WHEN document LIKE '%master%' THEN 'Master Circular' WHEN document LIKE '%order%' THEN 'Order' ELSE 'Other' END AS category FROM reg_text"""))
def _(spark, d):
    return b.reg_text(spark, d).select("id", cp.infer_category("document").alias("category"))


@query("T26_slug_filename", rf"""
SELECT o_orderkey AS id, 'SRC_'||strftime(o_orderdate,'%Y-%m-%d')||'_'||left(regexp_replace({o.strip("regexp_replace(lower(o_orderpriority||' / Terms & Conditions of the Offer, No. '||o_totalprice||'  final text of the order'), '[^a-z0-9 _-]', '', 'g')")}, '\s+', '_', 'g'),55)||'_'||
 CASE WHEN length((o_custkey%2000)::VARCHAR)>=3 THEN (o_custkey%2000)::VARCHAR ELSE lpad((o_custkey%2000)::VARCHAR,3,'0') END||'.pdf' AS name FROM orders""")
def _(spark, d):
    title = F.concat("o_orderpriority", F.lit(" / Terms & Conditions of the Offer, No. "), F.col("o_totalprice").cast("string"), F.lit("  final text of the order"))
    return b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), cp.slug_filename(F.lit("SRC"), title, F.date_format("o_orderdate", "yyyy/MM/dd"), F.col("o_custkey") % 2000).alias("name"))


HREFS = r"""list_filter(list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["''][^"'']*["'']'), lambda a: trim(regexp_extract(a, '(?is)\bhref\s*=\s*["'']([^"'']*)["'']$', 1))), lambda h: lower(h) LIKE '%on')"""


@query("T27_first_pdf_link", rf"""
SELECT page_id, CASE WHEN h LIKE 'http%' THEN h WHEN h LIKE '/%' THEN 'https://site.example'||h WHEN h IS NOT NULL THEN 'https://site.example/'||h
 WHEN regexp_extract(html, '(?i)https?://[^\s"''<>]+on')<>'' THEN regexp_extract(html, '(?i)https?://[^\s"''<>]+on') END AS link FROM (SELECT page_id, html, {HREFS}[1] AS h FROM pages)""")
def _(spark, d):
    return b.table(spark, d, "pages").select("page_id", cp.first_pdf_link("html", "https://site.example", "on").alias("link"))


# One listing page per order: a heading, the order itself and a navigation row.
@query("T28_listing_rows", """
SELECT o_orderkey AS id, 1 AS row_index, o_orderpriority||' no. '||o_orderkey AS title, strftime(o_orderdate,'%d/%m/%Y') AS date,
 CASE WHEN o_orderkey%2=0 THEN 'https://site.example/doc/'||o_orderkey ELSE 'https://site.example/files/'||o_orderkey||'.pdf' END AS detail_url
FROM orders WHERE o_orderstatus<>'P' AND length(o_orderpriority||' no. '||o_orderkey)>=8""")
def _(spark, d):
    k = F.col("o_orderkey").cast("string")
    href = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/doc/"), k)).otherwise(F.concat(F.lit("files/"), k, F.lit(".pdf")))
    title = F.concat("o_orderpriority", F.lit(" no. "), k, F.when(F.col("o_orderstatus") == "P", " next page").otherwise(""))
    page = F.concat(
        F.lit("<table>\n<tr><th>Date</th><th>Title</th></tr>\n<tr class='x'><td>"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("</td>\n<td> <a href=\""), href,
        F.lit("\"><b>"), title, F.lit("</b></a></td></tr><tr><td>1</td><td><a href='/more'>Previous orders</a></td></tr></table>"),
    )
    return cp.listing_rows(b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), page.alias("html")), base="https://site.example", by=["id"])


FIELDS = [("num_numbers", r"\b\d+(?:,\d+)*(?:\.\d+)?\b"), ("num_currencies", r"(?i)₹|crore|lakh|cr\.?|Rs\.?"), ("num_amendments", r"(?i)\bsupersed|\bamend|\bmodif|\breplace|\bhereby\b"),
          ("num_refs", r"\bSEBI\b|\bRBI\b|\bCircular\b|\bNotification\b"), ("num_conditions", r"(?i)\bif\b|\bwhere\b|\bprovided that\b|\bsubject to\b|\bnotwithstanding\b"), ("sentence_count", "[.;]")]
DATES = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{4}|\b\d{4}\b"


def features_sql(source: str, key: str) -> str:
    return f"""f0 AS (SELECT {key}, text, {o.word_count('text')} AS ctx_len, 0::BIGINT AS q_len, len(list_distinct(regexp_extract_all(text,'{DATES}'))) AS num_dates,
 {', '.join(f"{o.count_matches('text', p)} AS {n}" for n, p in FIELDS)},
 greatest({o.word_count('text')},1)::DOUBLE AS w, greatest({o.count_matches('text','[.!?]+')},1)::DOUBLE AS s, greatest({o.count_matches('lower(text)','[aeiouyàâäéèêëïîôöùûü]+')},1)::DOUBLE AS y FROM {source})"""


FEAT_COLS = ", ".join(["ctx_len", "q_len", "num_dates", *[n for n, _ in FIELDS]]) + """,
 round(CASE WHEN length(text)>50 THEN 206.835-1.015*(w/s)-84.6*(y/w) ELSE 50 END,6)::DOUBLE AS flesch_ease, round(CASE WHEN length(text)>50 THEN 0.39*(w/s)+11.8*(y/w)-15.59 ELSE 10 END,6)::DOUBLE AS fk_grade"""


def _features(df, key):
    out = rounded(feat.text_features(df, "text", None), "flesch_ease", "fk_grade")
    counts = [c for c in feat.FEATURES if c not in ("flesch_ease", "fk_grade")]
    return out.select(key, *[F.col(c).cast("long").alias(c) for c in counts], "flesch_ease", "fk_grade")


@query("N6_text_features", o.with_(features_sql("documents", "doc_id"), body=f"SELECT doc_id, {FEAT_COLS} FROM f0"))
def _(spark, d):
    return _features(b.table(spark, d, "documents"), "doc_id")


@query("N6_text_features_regulations", o.with_(o.REG, features_sql("reg_text", "id"), body=f"SELECT id, {FEAT_COLS} FROM f0"))
def _(spark, d):
    return _features(b.reg_text(spark, d), "id")


YEARS = r"\b(?:19[89]\d|20[0-2]\d)\b"


@query("N7_perturb_years", o.with_(o.REG, body=f"""
SELECT id, array_to_string(list_transform(list_zip(string_split_regex(text,'{YEARS}'), list_append(list_transform(regexp_extract_all(text,'{YEARS}'),
 lambda m: CASE WHEN m::INT BETWEEN 1990 AND 2025 THEN (m::INT+5)::VARCHAR ELSE m END), '')), lambda z: z[1]||z[2]), '') AS moved FROM reg_text"""))
def _(spark, d):
    return b.reg_text(spark, d).select("id", feat.perturb_years("text").alias("moved"))


@query("N8_perturb_crore", o.with_(o.REG, body=r"""
SELECT id, regexp_extract(text,'^(.*?)(\d+\.25) crore(.*)$',1)||round_even(10*regexp_extract(text,'(\d+\.25) crore',1)::DOUBLE,0)::BIGINT||' million'||regexp_extract(text,'^(.*?)(\d+\.25) crore(.*)$',3) AS moved FROM reg_text"""))
def _(spark, d):
    return b.reg_text(spark, d).select("id", feat.perturb_crore("text").alias("moved"))


def synonyms_sql() -> str:
    x = "text"
    for p, r in [("supersedes", "replaces"), ("superseded", "replaced"), ("in supersession of", "in replacement of"), ("hereby", "as a result"), ("with effect from", "effective"), ("amended", "modified")]:
        x = rf"regexp_replace({x}, '(?i)\b{p}\b', '{r}', 'g')"
    return x


@query("N9_perturb_synonyms", o.with_(o.REG, body=f"SELECT id, {synonyms_sql()} AS moved FROM reg_text"))
def _(spark, d):
    return b.reg_text(spark, d).select("id", feat.perturb_synonyms("text").alias("moved"))


CHUNKS = f"cw AS (SELECT doc_id, {o.words('text')} AS w FROM documents), ch AS (SELECT doc_id, w, unnest(range(0, len(w), 300)) AS st FROM cw)"
CHUNK_BODY = "SELECT doc_id, st::INTEGER AS word_start, (st//300)::INTEGER AS chunk_index, array_to_string(w[st+1:st+400],' ') AS chunk FROM ch"


@query("N10_chunk_words", o.with_(CHUNKS, body=CHUNK_BODY))
def _(spark, d):
    return dc.chunk_words(b.table(spark, d, "documents").select("doc_id", "text"))


@query("U4_chunk_words_table_function", o.with_(CHUNKS, body=CHUNK_BODY))
def _(spark, d):
    register_chunk_words(spark)
    b.table(spark, d, "documents").select("doc_id", "text").createOrReplaceTempView("chunk_source")
    return spark.sql("SELECT doc_id, c.* FROM chunk_source, LATERAL chunk_words(text, 400, 100) c")


# Lines stand for paragraphs: line breaks of the documents are doubled first.
PASS = f"""pp AS (SELECT doc_id, unnest(p) AS p, generate_subscripts(p,1)-1 AS para_index FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text,chr(10),chr(10)||chr(10)),chr(10)||chr(10)), lambda s: {o.strip('s')}), lambda s: s<>'') AS p FROM documents)),
ps AS (SELECT doc_id, para_index, CASE WHEN len({o.words('p')})>60 THEN array_to_string({o.words('p')}[1:60],' ') ELSE p END AS passage FROM pp WHERE len({o.words('p')})>=20)"""


def passages(spark, d):
    docs = b.table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return dc.extract_passages(docs, low=20, high=60)


@query("N11_extract_passages", o.with_(PASS, body="SELECT doc_id, para_index::INTEGER AS para_index, passage FROM ps"))
def _(spark, d):
    return passages(spark, d)


@query("W6_limit_per_doc", o.with_(PASS, body="SELECT doc_id, para_index::INTEGER AS para_index, passage FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_index) AS r FROM ps) WHERE r<=5"))
def _(spark, d):
    return dc.limit_per_doc(passages(spark, d))


LENGTHS = f"ln AS (SELECT doc_id, lang, {o.word_count('text')} AS n_words FROM documents)"


def lengths(spark, d):
    return b.table(spark, d, "documents").select("doc_id", "lang", t.word_count("text").alias("n_words"))


SUMMARY = """count(*) AS n, round(avg(n_words),6) AS mean, round(stddev_samp(n_words),6) AS std, min(n_words)::BIGINT AS min, round(quantile_cont(n_words,0.25),6) AS q25,
 round(quantile_cont(n_words,0.5),6) AS q50, round(quantile_cont(n_words,0.75),6) AS q75, max(n_words)::BIGINT AS max"""


@query("N12_length_buckets", o.with_(LENGTHS, "q AS (SELECT quantile_cont(n_words,0.25) a, quantile_cont(n_words,0.5) b, quantile_cont(n_words,0.75) c FROM ln)", body="""
SELECT doc_id, n_words, CASE WHEN n_words<=a THEN 1 WHEN n_words<=b THEN 2 WHEN n_words<=c THEN 3 ELSE 4 END::INTEGER AS length_bucket FROM ln, q"""))
def _(spark, d):
    return dc.length_buckets(lengths(spark, d), "n_words").select("doc_id", F.col("n_words").cast("long").alias("n_words"), "length_bucket")


@query("N12_length_summary", o.with_(LENGTHS, body=f"SELECT {SUMMARY} FROM ln"))
def _(spark, d):
    out = rounded(dc.length_summary(lengths(spark, d), "n_words"), "mean", "std", "q25", "q50", "q75")
    return out.withColumns({c: F.col(c).cast("long") for c in ("min", "max")})


@query("N13_binned_accuracy", o.with_(o.VALID, f"ln AS (SELECT model, correct, {o.word_count('text')} AS x FROM valid)", "r AS (SELECT min(x)::DOUBLE AS lo, max(x)::DOUBLE AS hi FROM ln)", body="""
SELECT model, floor((x-lo)/((hi-lo)/9))::INTEGER AS bin, count(*) AS n, sum(correct)::BIGINT AS n_correct, round(avg(correct),6) AS accuracy, round(any_value(lo)+(floor((x-lo)/((hi-lo)/9))+0.5)*any_value((hi-lo)/9),6) AS center
FROM ln, r WHERE x<hi GROUP BY model, floor((x-lo)/((hi-lo)/9)) HAVING count(*)>3"""))
def _(spark, d):
    rows = valid(spark, d, x=t.word_count("text"))
    return rounded(dc.binned_accuracy(rows, "x", ["model"]), "accuracy", "center")


@query("A16_value_counts", o.with_(o.ITEMS, body=" UNION ALL ".join(f"SELECT '{c}' AS attribute, {c} AS value, count(*) AS n FROM items GROUP BY {c}" for c in ("task", "difficulty", "source"))))
def _(spark, d):
    return dc.value_counts(b.items(spark, d), ["task", "difficulty", "source"])


@query("A16_cross_tab", o.with_(o.ITEMS, body="""
SELECT CASE WHEN grouping(task)=1 THEN 'OVERALL' ELSE task END AS task, CASE WHEN grouping(difficulty)=1 THEN 'OVERALL' ELSE difficulty END AS difficulty, count(*) AS n FROM items GROUP BY CUBE (task, difficulty)"""))
def _(spark, d):
    return dc.cross_tab(b.items(spark, d))


@query("A16_max_id_suffix", """SELECT upper(lang) AS prefix, max(doc_id) AS max_id FROM documents WHERE doc_id%10<>7 GROUP BY 1""")
def _(spark, d):
    i = F.col("doc_id").cast("string")
    rows = b.table(spark, d, "documents").select(F.concat(F.upper("lang"), F.lit("_"), F.when(F.col("doc_id") % 10 == 7, F.concat(i, F.lit("x"))).otherwise(i)).alias("id"))
    return dc.max_id_suffix(rows)


@query("A32_corpus_profile", o.with_(REP, body=" UNION ALL ".join(f"SELECT '{c}' AS attribute, {c} AS value, count(*) AS n FROM rp GROUP BY {c}" for c in ("source", "status", "lang"))))
def _(spark, d):
    return dc.value_counts(report(spark, d), ["source", "status", "lang"])


@query("A32_year_counts", o.with_(o.REG, body="SELECT 'year' AS attribute, substr(document,5,4) AS value, count(*) AS n FROM reg_text GROUP BY 2 UNION ALL SELECT 'category', CASE WHEN document LIKE '%circular%' THEN 'Circular' WHEN document LIKE '%order%' THEN 'Order' ELSE 'Other' END, count(*) FROM reg_text GROUP BY 2"))
def _(spark, d):
    rows = b.reg_text(spark, d).select(cp.year_from_name("document").alias("year"), cp.infer_category("document").alias("category"))
    return dc.value_counts(rows, ["year", "category"])


@query("A32_word_summary", o.with_(REP, "ln AS (SELECT lang, word_count AS n_words FROM rp WHERE status='success')", body=f"SELECT lang, {SUMMARY} FROM ln GROUP BY lang"))
def _(spark, d):
    out = dc.length_summary(report(spark, d).where("status = 'success'"), "word_count", ["lang"])
    return rounded(out, "mean", "std", "q25", "q50", "q75").withColumns({c: F.col(c).cast("long") for c in ("min", "max")})


@query("A32_success_rate", o.with_(REP, body="SELECT lang, count(*) AS n, count(*) FILTER (status='success') AS n_success, round(count(*) FILTER (status='success')/count(*),6) AS success_rate FROM rp GROUP BY lang"))
def _(spark, d):
    return rounded(dc.success_rate(report(spark, d), by=["lang"]), "success_rate")


PI = """pi AS (SELECT doc_id, CASE doc_id%4 WHEN 0 THEN 'regulatory_interpretation' WHEN 1 THEN 'numerical_reasoning' WHEN 2 THEN 'contradiction_detection' ELSE 'temporal_reasoning' END AS task_type,
 text AS context, text AS context_a, reverse(text) AS context_b, 'What about '||source||'?' AS question, source AS answer FROM documents)"""


def prompt_items(spark, d):
    k = F.col("doc_id") % 4
    task = F.when(k == 0, "regulatory_interpretation").when(k == 1, "numerical_reasoning").when(k == 2, "contradiction_detection").otherwise("temporal_reasoning")
    return b.table(spark, d, "documents").select(
        "doc_id", task.alias("task_type"), F.col("text").alias("context"), F.col("text").alias("context_a"), F.reverse("text").alias("context_b"),
        F.concat(F.lit("What about "), "source", F.lit("?")).alias("question"), F.col("source").alias("answer"))


NL2 = "chr(10)||chr(10)"
ZS = f"""CASE task_type WHEN 'contradiction_detection' THEN 'Passage A:'||chr(10)||left(context_a,1500)||{NL2}||'Passage B:'||chr(10)||left(context_b,1500)||{NL2}||'Question: '||question||{NL2}||'Answer with ''Yes'' or ''No'' then one sentence of explanation:'
 ELSE 'Context:'||chr(10)||array_to_string({o.words('context')}[1:450],' ')||{NL2}||'Question: '||question||{NL2}||CASE task_type WHEN 'numerical_reasoning' THEN 'Show your calculation and give the final answer with units:'
 WHEN 'temporal_reasoning' THEN 'Answer precisely, noting relevant dates or sequences:' ELSE 'Answer:' END END"""


@query("T29_build_prompt", o.with_(PI, body=f"SELECT doc_id, {ZS} AS prompt FROM pi"))
def _(spark, d):
    return pm.build_prompt(prompt_items(spark, d)).select("doc_id", "prompt")


FS = f"""ex AS (SELECT task_type, string_agg('--- Example ---'||chr(10)||CASE task_type WHEN 'contradiction_detection' THEN 'Passage A:'||chr(10)||left(context_a,800)||{NL2}||'Passage B:'||chr(10)||left(context_b,800)
  ELSE 'Context:'||chr(10)||array_to_string({o.words('context')}[1:300],' ') END||{NL2}||'Question: '||question||chr(10)||'Answer: '||answer, {NL2} ORDER BY doc_id) AS examples
 FROM (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY doc_id) AS r FROM pi) WHERE r<=2 GROUP BY task_type)"""


@query("T29_build_prompt_few_shot", o.with_(PI, FS, body=f"SELECT doc_id, examples||{NL2}||'--- Your question ---'||chr(10)||{ZS} AS prompt FROM pi JOIN ex USING (task_type)"))
def _(spark, d):
    rows = prompt_items(spark, d).withColumn("difficulty", F.lit("easy"))
    shots = sm.few_shot_examples(rows, 2, "task_type", "difficulty", "doc_id")
    blocks = pm.example_blocks(pm.format_example(shots))
    return pm.build_prompt(spread_join(rows, blocks, ["task_type"]), examples="examples").select("doc_id", "prompt")


# Prompts are compared by digest: with three examples they are long.
CONDITIONS_SQL = FS.replace("r<=2 GROUP BY task_type)", "r<=n GROUP BY task_type, n)").replace("ex AS (SELECT task_type,", "ex AS (SELECT task_type, n,").replace("AS r FROM pi)", "AS r FROM pi), (SELECT unnest([1,3]) AS n)")


@query("T29_build_conditions", o.with_(PI, CONDITIONS_SQL, f"zs AS (SELECT doc_id, task_type, {ZS} AS q FROM pi)", body=f"""
SELECT doc_id, 'zero_shot' AS condition, 'Be exact.' AS system, md5(q) AS prompt_md5 FROM zs UNION ALL SELECT doc_id, 'zero_shot_cot', 'Be exact.'||{NL2}||'Think step by step before answering.', md5(q) FROM zs
UNION ALL SELECT doc_id, CASE n WHEN 1 THEN 'one_shot' ELSE 'three_shot' END, 'Be exact.', md5(examples||{NL2}||'--- Your question ---'||chr(10)||q) FROM zs JOIN ex USING (task_type)"""))
def _(spark, d):
    rows = prompt_items(spark, d).withColumn("difficulty", F.lit("easy"))
    shots = pm.format_example(sm.few_shot_examples(rows, 3, "task_type", "difficulty", "doc_id"))
    return pm.build_conditions(rows, "Be exact.", examples=shots).select("doc_id", "condition", "system", F.md5("prompt").alias("prompt_md5"))


def styled(heading: str, passage: str, question: str, context: str, a: str, b_: str, closings: dict[str, str]) -> str:
    lines = " ".join(f"WHEN '{k}' THEN {o.quoted(v)}" for k, v in closings.items() if k != "default")
    return f"""CASE task_type WHEN 'contradiction_detection' THEN '{passage} A:'||chr(10)||{a}||{NL2}||'{passage} B:'||chr(10)||{b_} ELSE '{heading}:'||chr(10)||{context} END
 ||{NL2}||'{question}: '||question||{NL2}||CASE task_type {lines} ELSE {o.quoted(closings['default'])} END"""


def words_sql(x: str, n: int) -> str:
    return f"array_to_string({o.words(x)}[1:{n}],' ')"


STYLED = {
    "demo": styled("Context", "Passage", "Question", words_sql("context", 450), words_sql("context_a", 200), words_sql("context_b", 200), pm.CLOSINGS["zero_shot"]),
    "annotator": styled("Context passage", "Passage", "Question", "context", "context_a", "context_b", pm.CLOSINGS["annotator"]),
    "hosted": styled("CONTEXT", "PASSAGE", "QUESTION", "context", "left(context_a,1500)", "left(context_b,800)", pm.CLOSINGS["hosted"]),
}


def _styled(style):
    @query(f"T29_build_prompt_{style}", o.with_(PI, body=f"SELECT doc_id, md5({STYLED[style]}) AS prompt_md5 FROM pi"))
    def _(spark, d):
        return pm.build_prompt(prompt_items(spark, d), style).select("doc_id", F.md5("prompt").alias("prompt_md5"))


for _style in STYLED:
    _styled(_style)


def judge_sql(kind: str, **columns: str) -> str:
    """The template's text around its fields, each cut to its cap."""
    template, caps = pm.JUDGE_TEMPLATES[kind]
    parts = []
    for part in re.split(r"(?<!{)({[a-z]+})(?!})", template):
        name = part[1:-1]
        value = columns.get(name, name)
        parts.append((f"left({value},{caps[name]})" if name in caps else value) if re.fullmatch("{[a-z]+}", part) else o.quoted(part.replace("{{", "{").replace("}}", "}")))
    return "||".join(parts)


def _judged(kind, sql):
    @query(f"T30_judge_prompt_{kind}" if kind != "verdict" else "T30_judge_prompt", o.with_(TURNS_SQL, body=f"SELECT conv_id, turn, {sql} AS prompt FROM (SELECT *, question||answer AS prediction, answer||question AS context FROM turns)"))
    def _(spark, d):
        rows = turns(spark, d).withColumns({"prediction": F.concat("question", "answer"), "context": F.concat("answer", "question")})
        return pm.judge_prompt(rows, kind, reference="answer").select("conv_id", "turn", "prompt")


for _kind in pm.JUDGE_TEMPLATES:
    _judged(_kind, judge_sql(_kind, reference="answer"))


@query("T31_passage_display", o.with_(PI, body=f"""
SELECT doc_id, CASE task_type WHEN 'contradiction_detection' THEN 'PASSAGE A:'||chr(10)||left(context_a,500)||{NL2}||'PASSAGE B:'||chr(10)||left(context_b,300) ELSE left(context,700) END AS context_display FROM pi"""))
def _(spark, d):
    return pm.passage_display(prompt_items(spark, d)).select("doc_id", "context_display")


@query("T32_shots_block", o.with_(PI, "sh AS (SELECT task_type, string_agg('CONTEXT:'||chr(10)||left(context,400)||chr(10)||'QUESTION: '||question||chr(10)||'ANSWER: '||answer||chr(10)||chr(10), '' ORDER BY doc_id) AS shots FROM (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY doc_id) AS r FROM pi) WHERE r<=3 GROUP BY task_type)", body="""
SELECT doc_id, shots||'CONTEXT:'||chr(10)||left(context,600)||chr(10)||'QUESTION: '||question||chr(10)||'ANSWER:' AS prompt FROM pi JOIN sh USING (task_type)"""))
def _(spark, d):
    rows = prompt_items(spark, d)
    first = sm.stratified_sample(rows, ["task_type"], 3, "doc_id", key=F.col("doc_id"))
    return pm.with_shots(rows, first, order="doc_id").select("doc_id", "prompt")


TOPK = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v,v)) AS l FROM e),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.v,b.v)/(a.l*b.l),9) AS score FROM n a JOIN n b ON a.vec_id<>b.vec_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank<=3)"""


def hits(spark, d, **blocks):
    vectors = b.table(spark, d, "embeddings").select("vec_id", "embedding")
    return rt.top_k_similar(vectors.withColumnRenamed("vec_id", "query_id"), vectors, exclude_self=True, **blocks)


J10_BODY = "SELECT query_id, vec_id, round(score,6) AS score, rank FROM hits"


def j10(found):
    return rounded(found, "score").withColumn("rank", F.col("rank").cast("long"))


@query("J10_top_k_similar", o.with_(TOPK, body=J10_BODY))
def _(spark, d):
    """All vectors as queries, in blocks."""
    return j10(hits(spark, d, block_queries=200, block_vectors=150, few_queries=0))


@query("J10_top_k_few_queries", o.with_(TOPK, body=J10_BODY + " WHERE query_id%10=0"))
def _(spark, d):
    """A tenth of the vectors as queries, sent to the vectors."""
    vectors = b.table(spark, d, "embeddings").select("vec_id", "embedding")
    queries = vectors.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    return j10(rt.top_k_similar(queries, vectors, exclude_self=True))


@query("J10_top_k_approximate", "SELECT count(*)*3 AS n, true AS reached FROM embeddings")
def _(spark, d):
    """Recall of the approximate search: at least nine of ten exact neighbours."""
    vectors = b.table(spark, d, "embeddings").select("vec_id", "embedding")
    found = rt.top_k_approximate(vectors.withColumnRenamed("vec_id", "query_id"), vectors, exclude_self=True)
    return rt.recall(found, hits(spark, d)).select("n", (F.col("recall") >= 0.9).alias("reached"))


@query("J13_retrieved_context", o.with_(TOPK, body="""
SELECT query_id, left(string_agg(text, chr(10)||chr(10)||'---'||chr(10)||chr(10) ORDER BY rank), 3000) AS context FROM hits JOIN documents ON doc_id=vec_id GROUP BY query_id"""))
def _(spark, d):
    texts = b.table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return rt.retrieved_context(hits(spark, d), texts)


def _answer(prompt: str) -> str:
    if "?" not in prompt:
        raise ValueError("no question in this prompt: " + prompt)
    return prompt.split("?")[0].upper()


U2_SQL = """SELECT doc_id, CASE WHEN contains(text,'?') THEN translate(split_part(text,'?',1),'abcdefghijklmnopqrstuvwxyz','ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE 'FAIL: '||left('no question in this prompt: '||text,80) END AS prediction
 FROM (SELECT doc_id, regexp_replace(text,'[^a-z ?]','','g')||CASE WHEN n_chars%2=0 THEN '?' ELSE '' END AS text FROM documents)"""


@query("U2_apply_predictor", U2_SQL)
def _(spark, d):
    prompt = F.concat(F.regexp_replace("text", "[^a-z ?]", ""), F.when(F.col("n_chars") % 2 == 0, "?").otherwise(""))
    return apply_predictor(b.table(spark, d, "documents").select("doc_id", prompt.alias("prompt")), _answer).select("doc_id", "prediction")


def _answers(prompts: list[str]) -> list[str]:
    return [_answer(p) for p in prompts]


@query("U2_apply_predictor_in_batches", U2_SQL)
def _(spark, d):
    """A prompt at fault is found by splitting its batch; the others keep their answers."""
    prompt = F.concat(F.regexp_replace("text", "[^a-z ?]", ""), F.when(F.col("n_chars") % 2 == 0, "?").otherwise(""))
    rows = b.table(spark, d, "documents").select("doc_id", prompt.alias("prompt"))
    return apply_predictor(rows, predict_batch=_answers, batch=16).select("doc_id", "prediction")


def run_folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/run-{uuid.uuid4().hex}"


# Predictions arrive as a stream of documents: one failed and one good answer per window.
S1_SQL = o.PAIRS + f""", st AS (SELECT a.item_id, CASE WHEN a.item_id%4=0 THEN 'no such '||a.reference WHEN a.item_id%4=1 THEN reverse(a.reference) ELSE a.reference END AS prediction, a.task, a.reference FROM answer_pairs a WHERE a.item_id%4<>3),
np AS (SELECT *, {o.normalise('reference')} AS rn, {o.normalise('prediction')} AS pn FROM st), """ + o.token_set_ratio("np", "item_id") + ", sp AS (SELECT np.*, tsr.ratio FROM np JOIN tsr USING (item_id))"


def stream_predictions(pieces):
    """Two submissions per window: a failure, then (on most windows) an answer, sent twice."""
    i = F.col("item_id")
    good = F.when(i % 4 == 0, F.concat(F.lit("no such "), F.col("reference"))).when(i % 4 == 1, F.reverse("reference")).otherwise(F.col("reference"))
    tries = F.array(F.lit("FAIL: timeout"), F.when(i % 4 != 3, good).otherwise("FAIL: again"), F.when(i % 4 != 3, good).otherwise("FAIL: again"))
    return pieces.select("item_id", F.lit("m0").alias("model"), F.explode(tries).alias("prediction"))


# Three sets of files arrive in turn. The second moves the watermark on by five hours, so in the third the first set's keys are
# forgotten (the same answers count anew) and a row of the first hour is late.
@query("S1_score_stream", "WITH " + S1_SQL + f""", on_time AS (SELECT item_id, 'm0' AS model, {strict_sql()} AS correct FROM sp)
SELECT * FROM on_time UNION ALL SELECT item_id, 'm1', correct FROM on_time WHERE item_id%3=0 UNION ALL SELECT item_id, 'm0', correct FROM on_time WHERE item_id%5=0""")
def _(spark, d):
    folder = run_folder(spark)
    b.answer_pairs(spark, d).select("item_id", "task", "reference").write.parquet(f"{folder}/items")
    items = spark.read.parquet(f"{folder}/items")

    def arrive(rows, at):
        rows.withColumn("at", F.lit(at).cast("timestamp")).write.mode("append").parquet(f"{folder}/in")

    schema = "item_id long, model string, prediction string, at timestamp"
    for step in range(3):
        made = stream_predictions(items)
        if step == 0:
            arrive(made, "2024-01-01 00:00:00")
        elif step == 1:
            arrive(made.where("item_id % 3 = 0").withColumn("model", F.lit("m1")), "2024-01-01 05:00:00")
        else:
            arrive(made.where("item_id % 5 = 0"), "2024-01-01 05:30:00")
            arrive(made.where("item_id % 7 = 0").withColumn("model", F.lit("m2")), "2024-01-01 00:10:00")
        arriving = spark.readStream.schema(schema).parquet(f"{folder}/in")
        scored = flows.score_stream(arriving, items, event_time="at")
        flows.start_scored_sink(scored.select("item_id", "model", "correct"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("item_id long, model string, correct int").parquet(f"{folder}/out")


BASELINES = "baselines AS (SELECT 'base/b'||i AS hf_id, i/10.0::DOUBLE AS overall FROM (SELECT unnest(range(1,10)) AS i) UNION ALL SELECT 'org/sys1', 1.0)"
BEST = "best AS (SELECT hf_id, overall, submitted_at FROM (SELECT *, row_number() OVER (PARTITION BY hf_id ORDER BY overall DESC, submitted_at) AS r FROM submissions) WHERE r=1)"
SEEDED = "seeded AS (SELECT * FROM best UNION ALL SELECT hf_id, overall, NULL FROM baselines WHERE hf_id NOT IN (SELECT hf_id FROM best))"


@query("S2_live_leaderboard", o.with_(o.SUBMISSIONS, BASELINES, BEST, SEEDED, body="""
SELECT row_number() OVER (ORDER BY overall DESC, submitted_at NULLS LAST, hf_id) AS rank, hf_id, regexp_extract(hf_id,'[^/]+$') AS model_id, round(overall*100,1) AS overall FROM seeded"""))
def _(spark, d):
    """Five batches; the last one comes twice, as after a crash between the write and the commit."""
    folder = run_folder(spark)
    rows = b.submissions(spark, d).select("hf_id", "overall", "submitted_at")
    rows.repartition(5).write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    seeds = spark.range(1, 10).select(F.concat(F.lit("base/b"), F.col("id").cast("string")).alias("hf_id"), (F.col("id") / 10).alias("overall"))
    seeds = seeds.union(spark.range(1).select(F.lit("org/sys1"), F.lit(1.0))).withColumn("submitted_at", F.lit(None).cast("timestamp"))

    def publish(board, batch_id):
        board.select("rank", "hf_id", "model_id", "overall").write.mode("overwrite").parquet(f"{folder}/board")

    store, state = f"{folder}/store", f"{folder}/state"
    flows.start_live_leaderboard(arriving, store, state, publish, seeds).awaitTermination()
    flows.start_live_leaderboard(arriving, store, forget_last_commit(spark, state), publish, seeds).awaitTermination()
    return spark.read.schema("rank long, hf_id string, model_id string, overall double").parquet(f"{folder}/board")


def forget_last_commit(spark, state: str) -> str:
    """Delete the newest commit of a stream's checkpoint, so that its batch runs again."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{state}/commits")
    files = path.getFileSystem(conf)
    last = max((f.getPath() for f in files.listStatus(path) if f.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
    files.delete(last, False)
    return state


@query("S2_live_accuracy", "WITH " + S1_SQL + f", sc AS (SELECT item_id%10 AS model, {strict_sql()} AS c FROM sp) SELECT model, count(*) AS n, sum(c)::BIGINT AS n_correct, round(avg(c),6) AS accuracy FROM sc GROUP BY model")
def _(spark, d):
    """Running counts per key, in update mode: the newest row of each key is the sum of all batches."""
    folder = run_folder(spark)
    made = stream_predictions(b.answer_pairs(spark, d, partners=False).select("item_id", "reference"))
    scored = score(made.where("prediction not like 'FAIL%'").dropDuplicates(["item_id"]).join(b.answer_pairs(spark, d).select("item_id", "task", "reference"), "item_id"))
    scored.select((F.col("item_id") % 10).alias("model"), "correct").repartition(4).write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema("model long, correct int").option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")

    def keep(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{folder}/out/part={batch_id}")

    flows.live_accuracy(arriving).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("model long, n long, n_correct long, accuracy double, batch long").parquet(f"{folder}/out")
    return rounded(rows.groupBy("model").agg(*[F.max_by(c, "batch").alias(c) for c in ("n", "n_correct", "accuracy")]), "accuracy")
