"""Cutting and describing documents and item sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.functions.text import strip, word_count, words
from gradeframe.operators.accuracy import TOTAL, ratio

CHUNK_WORDS = 400
CHUNK_OVERLAP = 100


def top_docs(df: DataFrame, n: int = 40, min_words: int = 400, text: str = "text", item: str = "doc_id") -> DataFrame:
    """O1: the longest documents with more than ``min_words`` words."""
    counted = df.withColumn("words", word_count(text)).where(F.col("words") > min_words)
    return counted.orderBy(F.desc("words"), item).limit(n)


def chunk_words(df: DataFrame, text: str = "text", size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` words, each starting ``size - overlap`` words after the last."""
    step = size - overlap
    split = df.withColumn("_w", words(text)).where(F.size("_w") > 0)
    # Windows are cut before the explode, so its rows do not carry all words of the document.
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step)),
        lambda s: F.struct(
            s.alias("word_start"), (s / step).cast("int").alias("chunk_index"),
            F.array_join(F.slice("_w", s + 1, F.lit(size)), " ").alias("chunk"),
        ),
    )
    return split.select(*[c for c in df.columns if c != text], F.inline(windows))


def extract_passages(df: DataFrame, text: str = "text", low: int = 80, high: int = 200) -> DataFrame:
    """Paragraphs of at least ``low`` words, cut to ``high`` words."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    rows = df.select(*[c for c in df.columns if c != text], F.posexplode(paragraphs).alias("para_index", "_p"))
    rows = rows.withColumn("_w", words("_p")).where(F.size("_w") >= low)
    cut = F.array_join(F.slice("_w", 1, high), " ")
    return rows.withColumn("passage", F.when(F.size("_w") > high, cut).otherwise(F.col("_p"))).drop("_p", "_w")


def limit_per_doc(passages: DataFrame, n: int = 5, doc: str = "doc_id", order: str = "para_index") -> DataFrame:
    """The first ``n`` passages of each document."""
    w = Window.partitionBy(doc).orderBy(order)
    return passages.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def length_summary(df: DataFrame, length: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, deviation, minimum, exact quartiles and maximum.

    Exact percentiles keep counts of distinct lengths, which are as many as the
    longest document has words at the most.
    """
    v = F.col(length)
    q = [F.percentile(v, F.lit(p)).alias(name) for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]
    return df.groupBy(*(by or [])).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), *q, F.max(v).alias("max")
    )


def length_buckets(df: DataFrame, length: str, out: str = "length_bucket") -> DataFrame:
    """Quartile bucket of each row, right-closed; equal edges merge into one bucket."""
    edges = df.select(F.array(
        F.min(length).cast("double"), *[F.percentile(length, F.lit(p)) for p in (0.25, 0.5, 0.75)], F.max(length).cast("double")
    )).scalar()
    df = df.withColumn("_edges", F.array_distinct(edges))
    above = F.size(F.filter(F.slice("_edges", 2, 4), lambda e: F.col(length) > e))
    return df.withColumn(out, (above + 1).cast("int")).drop("_edges")


def binned_accuracy(df: DataFrame, value: str, by: list[str] | None = None, bins: int = 9, min_rows: int = 3, correct: str = "correct") -> DataFrame:
    """Accuracy in equal-width half-open bins with more than ``min_rows`` rows.

    The largest value lies on the last edge and so belongs to no bin.
    """
    by = by or []
    low = df.select(F.min(value).cast("double")).scalar()
    high = df.select(F.max(value).cast("double")).scalar()
    width = (high - low) / bins
    rows = df.where(F.col(value) < high).withColumn("bin", F.floor((F.col(value) - low) / width).cast("int"))
    table = rows.groupBy(*by, "bin").agg(F.count(correct).alias("n"), F.sum(correct).cast("long").alias("n_correct")).where(F.col("n") > min_rows)
    return table.withColumns({"accuracy": ratio("n_correct", "n"), "center": low + (F.col("bin") + 0.5) * width})


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per value of each column (attribute, value, n), in one pass."""
    entries = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns])
    # Counting combinations first keeps the unpivot off the full table.
    combined = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return combined.select("_n", F.explode(entries).alias("e")).groupBy("e.attribute", "e.value").agg(F.sum("_n").alias("n"))


def cross_tab(df: DataFrame, a: str = "task", b: str = "difficulty") -> DataFrame:
    """Counts by both attributes with margins."""
    counted = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("_n"))
    cube = counted.cube(a, b).agg(F.sum("_n").alias("n"), F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"))
    return cube.select(
        F.when(F.col("_ga") == 1, TOTAL).otherwise(F.col(a)).alias(a),
        F.when(F.col("_gb") == 1, TOTAL).otherwise(F.col(b)).alias(b), "n",
    )


def max_id_suffix(df: DataFrame, item: str = "id") -> DataFrame:
    """Largest number in ids of the form PREFIX_number, per prefix."""
    number = F.expr(f"try_cast(split_part({item}, '_', 2) AS BIGINT)")
    rows = df.select(F.split_part(F.col(item), F.lit("_"), F.lit(1)).alias("prefix"), number.alias("_n"))
    return rows.where(F.col("_n").isNotNull()).groupBy("prefix").agg(F.max("_n").alias("max_id"))


def success_rate(df: DataFrame, status: str = "status", by: list[str] | None = None) -> DataFrame:
    """Share of successfully parsed documents."""
    ok: Column = F.count_if(F.col(status) == "success")
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), ok.alias("n_success")).withColumn("success_rate", ratio("n_success", "n"))
