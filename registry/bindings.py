"""The shapes the library works on, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.functions.text import sealed

MODELS = [f"m{i}" for i in range(6)]
LANGS = ["en", "fr", "de", "es"]
LEVELS = ["easy", "medium", "hard"]


TEXT_TABLES = {"documents", "pages", "conversations", "orders"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A driver table, read as it is laid out.

    A file of one row group is one task, however costly its rows are. Where the
    caller's tables are such files, they name in ``gradeframe.text.partitions``
    how many partitions rows with texts are dealt to; unset, nothing is shuffled.
    """
    df = spark.read.parquet(f"{d}/{name}.parquet")
    dealt = spark.conf.get("gradeframe.text.partitions", None)
    return df.repartition(int(dealt)) if dealt and name in TEXT_TABLES else df


def items(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("lang").alias("task"),
        F.when(n < 600, "easy").when(n < 2500, "medium").otherwise("hard").alias("difficulty"),
        "source", "n_chars", "text",
    )


def eval_long(spark: SparkSession, d: str, keep: list[str] | None = None, **computed: Column) -> DataFrame:
    """Six systems on every item, deterministic outcomes, some failed predictions.

    ``computed`` columns are evaluated once per item, before systems multiply rows.
    """
    rows = items(spark, d)
    if computed:
        rows = sealed(rows, **computed)
    keep = [*(keep or []), *computed]
    rows = rows.select("item_id", "task", "difficulty", "n_chars", *keep)
    rows = rows.withColumn("_m", F.explode(F.array(*[F.lit(i).cast("long") for i in range(6)])))
    hit = (F.col("item_id") * 7919 + F.col("_m") * 104729 + F.col("n_chars") * 31) % 1000 < 900 - 60 * F.col("_m")
    return rows.select(
        "item_id", F.concat(F.lit("m"), F.col("_m").cast("string")).alias("model"), "task", "difficulty", "n_chars", *(keep or []),
        F.when(hit, 1).otherwise(0).alias("correct"),
        F.when((F.col("item_id") + F.col("_m")) % 37 == 0, "FAIL: timeout")
        .when((F.col("item_id") + F.col("_m")) % 5 < 2, "Yes, it does").when((F.col("item_id") + F.col("_m")) % 5 < 4, "no")
        .otherwise("unknown").alias("prediction"),
    )


def eval_ratings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    rows = rows.withColumn("rater", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
    q = F.col("quality")
    label = F.when((F.col("rater") == 0) | ((F.col("doc_id") * 31 + F.col("rater") * 17) % 10 < 8), q).otherwise(1 - q)
    return rows.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("task"), "rater", label.alias("label"))


def _upper_ascii(c: Column) -> Column:
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def answer_pairs(spark: SparkSession, d: str, partners: bool = True) -> DataFrame:
    """Every 12-word window of every document as a reference, with a prediction
    derived from it such that every scoring stage occurs.

    Some predictions take words of another document. Without ``partners`` they
    have none, for callers that read ids and references alone, each id once.
    """
    def split(text: Column) -> Column:
        return F.array_remove(F.split(text, r"[\s\p{Z}]+"), "")

    # Documents meet, not their windows; rows of one id are several partners.
    docs = table(spark, d, "documents").select("doc_id", "text")
    if partners:
        size = spark.read.parquet(f"{d}/documents.parquet").select(F.count(F.lit(1))).scalar()
        other = docs.groupBy(F.col("doc_id").alias("other_id")).agg(F.collect_list("text").alias("texts"))
        rows = docs.withColumn("other_id", (F.col("doc_id") * 13 + 7) % size).join(other, "other_id", "left")
    else:
        rows = docs.withColumn("texts", F.array().cast("array<string>"))
    rows = sealed(rows.select("doc_id", "text", "texts"), all=split(F.col("text")), others=F.transform("texts", split)).where(F.size("all") > 0)

    def window(s: Column) -> Column:
        w = F.slice("all", s + 1, F.lit(12))
        found = F.transform(F.filter("others", lambda o: F.size(o) > s), lambda o: F.slice(o, s + 1, F.lit(12)))
        none = F.array(F.array().cast("array<string>"))
        found = F.when(F.size(found) > 0, found).otherwise(none)
        return F.transform(found, lambda o: F.struct(F.floor(s / 12).cast("long").alias("pos"), w.alias("w"), o.alias("ow")))

    starts = F.sequence(F.lit(0), F.size("all") - 1, F.lit(12))
    rows = rows.select("doc_id", F.inline(F.flatten(F.transform(starts, window))))
    i, w, ow = F.col("doc_id") * 1000000 + F.col("pos"), F.col("w"), F.col("ow")
    rows = rows.select(i.alias("item_id"), w.alias("w"), ow.alias("ow"), F.array_join(w, " ").alias("f"), (i % 12).alias("kind"), F.floor(i / 12 % 2).alias("half"))
    i, w, ow, first, kind, half = (F.col(c) for c in ("item_id", "w", "ow", "f", "kind", "half"))
    number = (i % 500).cast("string")
    reference = (
        F.when(kind.isin(4, 5), F.concat(F.lit("Yes, "), first))
        .when(kind.isin(6, 7), F.concat(first, F.lit(" "), number, F.lit(" crore")))
        .otherwise(first)
    )
    prediction = (
        F.when(kind < 2, F.concat(_upper_ascii(first), F.lit(" !")))
        .when(kind == 2, F.array_join(F.reverse(w), " "))
        .when(kind == 3, F.array_join(F.filter(w, lambda x, k: k % 4 != 3), " "))
        .when(kind == 4, F.concat(F.lit("yes "), F.array_join(F.slice(w, 1, 6), " ")))
        .when(kind == 5, F.concat(F.lit("No, "), first))
        .when(kind.isin(6, 7), F.concat(F.lit("about "), (i % 500 + half).cast("string"), F.lit(" units in total")))
        .when(kind == 8, F.array_join(ow, " "))
        .when(kind == 9, F.concat_ws(" ", F.slice(w, 1, 9), F.slice(ow, 1, 3)))
        .when(kind == 10, F.concat(first, F.lit(" indeed")))
        .when(F.floor(i / 12) % 3 == 0, "FAIL: timeout").when(F.floor(i / 12) % 3 == 1, F.concat(first, F.lit(", or it cannot be determined"))).otherwise("")
    )
    task = (
        F.when(kind.isin(4, 5), "contradiction_detection").when(kind.isin(6, 7), "numerical_reasoning")
        .when(kind < 3, "regulatory_interpretation").otherwise("temporal_reasoning")
    )
    return rows.select(
        "item_id", F.concat(F.lit("m"), (F.floor(i / 7) % 4).cast("string")).alias("model"), task.alias("task"),
        reference.alias("reference"), prediction.alias("prediction"),
    )


def reg_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts with years, amounts and amendment wording; document names with years."""
    o, year = F.col("o_orderkey"), F.year("o_orderdate")
    return table(spark, d, "orders").select(
        o.alias("id"),
        F.concat(
            F.lit("SRC_"), (year + (o % 4) * 8).cast("string"),
            F.when(o % 3 == 0, "_notice_").when(o % 3 == 1, "_master_circular_").otherwise("_order_"),
            o.cast("string"), F.lit(".txt"),
        ).alias("document"),
        F.concat(
            F.lit("Circular "), o.cast("string"), F.lit(" is hereby amended with effect from "), year.cast("string"),
            F.lit(". Limit of Rs. "), (F.col("o_custkey") % 500).cast("string"), F.lit(".25 crore applies if the order is superseded."),
            F.when(o % 5 == 0, " The earlier circular of 01/04/1998 and the notification of March 2004 stand modified; see regulation 7.").otherwise(""),
        ).alias("text"),
    )


def submissions(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", F.concat(F.lit("org/sys"), (F.col("user_id") % 50).cast("string")).alias("hf_id"),
        ((e * 37 % 1000) / 1000.0).alias("overall"), ((e * 91 % 1000) / 1000.0).alias("score_REG"), F.col("ts").alias("submitted_at"),
    )
