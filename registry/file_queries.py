"""Files written and read back: every given row must come through the formats whole."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gradeframe.functions.prompts import fill_template
from gradeframe.functions.stats import chi2_sf
from gradeframe.session import ensure_checkpoint_dir
from gradeframe.sources import read_corpus, read_items, read_predictions, read_prompt_templates, write_results
from registry import bindings as b
from registry import query

#: Items in one file of a wrapped array.
PER_FILE = 50


def folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


@query("IO1_items_under_a_wrapper", """
SELECT CAST(doc_id AS VARCHAR) AS id, lang AS task_type, md5(text) AS context_md5, CAST(n_chars AS VARCHAR) AS answer FROM documents""")
def _(spark, d):
    """One array per file: under ``items``, under a name the reader does not know, or bare."""
    path = folder(spark)
    item = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("task_type"), F.col("text").alias("context"), F.col("n_chars").cast("string").alias("answer"))
    file = F.floor(F.col("doc_id") / PER_FILE)
    arrays = b.table(spark, d, "documents").groupBy(file.alias("file")).agg(F.collect_list(item).alias("items"))
    kind = F.col("file") % 3
    text = (
        F.when(kind == 0, F.to_json(F.struct(F.lit("v1").alias("version"), "items")))
        .when(kind == 1, F.to_json(F.struct(F.lit("v1").alias("version"), F.col("items").alias("questions")))).otherwise(F.to_json("items"))
    )
    arrays.select("file", text.alias("value")).write.partitionBy("file").text(path)
    return read_items(spark, path).select("id", "task_type", F.md5("context").alias("context_md5"), "answer")


@query("IO2_IO5_result_files", r"""
SELECT CAST(doc_id AS VARCHAR) AS id, lang AS task_type, md5('p,"' || regexp_replace(coalesce(text, ''), '[^A-Za-z0-9,"\n]', '', 'g') || '"e') AS prediction_md5,
 CASE WHEN doc_id%2=0 THEN source END AS ref_answer, CAST(doc_id%3=0 AS INTEGER) AS correct, CASE WHEN doc_id%2=0 THEN NULL ELSE 'v' || doc_id%7 END AS model_version
FROM documents""")
def _(spark, d):
    """Two layouts: one orders its columns anew, names the reference otherwise and lacks the version."""
    path, i = folder(spark), F.col("doc_id")
    prediction = F.concat(F.lit('p,"'), F.regexp_replace(F.coalesce("text", F.lit("")), '[^A-Za-z0-9,"\n]', ""), F.lit('"e'))
    rows = b.table(spark, d, "documents").select(
        i, i.cast("string").alias("id"), F.col("lang").alias("task_type"), prediction.alias("prediction"), F.col("source").alias("reference_answer"),
        (i % 3 == 0).cast("int").alias("correct"), F.concat(F.lit("v"), (i % 7).cast("string")).alias("model_version"),
    )
    write_results(rows.where(i % 2 == 1), f"{path}/one", "csv")
    write_results(rows.where(i % 2 == 0), f"{path}/two", "csv", ["correct", "prediction", "reference_answer", "task_type", "id"])
    found = read_predictions(spark, [f"{path}/one", f"{path}/two", f"{path}/none"])
    return found.select("id", "task_type", F.md5("prediction").alias("prediction_md5"), "ref_answer", "correct", "model_version")


#: Texts in one folder.
PER_FOLDER = 500


@query("IO4_text_files", "SELECT doc_id, md5(coalesce(text, '') || chr(10)) AS text_md5 FROM documents")
def _(spark, d):
    """Many documents per folder and file, each with its id; a row for every document with its whole text.

    A record is an id, a colon and the text, ended by NUL 2; a NUL within a text is followed by 1.
    """
    path, i = folder(spark), F.col("doc_id")
    record = F.concat(F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), F.replace(F.coalesce("text", F.lit("")), F.lit("\0"), F.lit("\0\1")), F.lit("\0\2"))
    docs = b.table(spark, d, "documents").select(F.floor(i / PER_FOLDER).alias("folder"), record.alias("value"))
    docs.repartition("folder").write.partitionBy("folder").text(path)
    records = read_corpus(spark, path, "*.txt").select(F.explode(F.split("text", "\0\2\n")).alias("record")).where("record <> ''")
    text = F.replace(F.expr("substr(record, instr(record, ':') + 1)"), F.lit("\0\1"), F.lit("\0"))
    return records.select(F.nullif(F.substring_index("record", ":", 1), F.lit("")).cast("long").alias("doc_id"), F.md5(F.concat(text, F.lit("\n"))).alias("text_md5"))


@query("IO6_prompt_templates", """
SELECT lang AS task_type, max(length(source)) AS longest, md5('Task '||lang||': {context}'||chr(10)||'From '||min(source)||chr(10)) AS template_md5,
 md5('Task '||lang||': '||max(source)||chr(10)||'From '||min(source)||chr(10)) AS filled_md5 FROM documents GROUP BY lang""")
def _(spark, d):
    """One template file per language, read back and filled."""
    path = folder(spark)
    docs = b.table(spark, d, "documents").groupBy("lang").agg(F.min("source").alias("low"), F.max("source").alias("high"), F.max(F.length("source")).cast("long").alias("longest"))
    template = F.concat(F.lit("Task "), "lang", F.lit(": {context}\nFrom "), "low")
    docs.select("lang", template.alias("value")).repartition("lang").write.partitionBy("lang").text(path)
    templates = read_prompt_templates(spark, path, by_folder="lang")
    filled = templates.join(docs, templates["task_type"] == docs["lang"])
    return filled.select("task_type", "longest", F.md5("template").alias("template_md5"), F.md5(fill_template(filled, "template", {"context": F.col("high")})).alias("filled_md5"))


@query("D1_chi_square_tail", """
WITH x AS (SELECT doc_id, CAST(1 + doc_id%5 AS INTEGER) AS m, (n_chars%4000)/200.0::DOUBLE AS h FROM documents)
SELECT doc_id, CAST(2*m AS BIGINT) AS df, round(exp(-h) * list_sum(list_transform(range(m), lambda i: pow(h, i)/factorial(CAST(i AS INTEGER)))), 8) AS p FROM x""")
def _(spark, d):
    """Even degrees of freedom, whose tail is a finite sum."""
    df = (2 * (1 + F.col("doc_id") % 5)).cast("long")
    rows = b.table(spark, d, "documents").select("doc_id", df.alias("df"), (F.col("n_chars") % 4000 / 100.0).alias("x"))
    return rows.select("doc_id", "df", F.round(chi2_sf(F.col("x"), F.col("df").cast("double")), 8).alias("p"))
