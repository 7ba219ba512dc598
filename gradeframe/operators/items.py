"""How systems do on each item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ["Highly Discriminative", "Easy (ceiling)", "Hard (floor)", "Medium"]


def item_stats(df: DataFrame, item: str = "item_id", correct: str = "correct") -> DataFrame:
    """Accuracy, sample variance and counts per item; difficulty and discrimination."""
    c = F.col(correct).cast("double")
    stats = df.groupBy(item).agg(
        F.avg(c).alias("accuracy"), F.var_samp(c).alias("variance"),
        F.sum(correct).cast("long").alias("n_correct"), F.count(correct).alias("n_total"),
    )
    a = F.col("accuracy")
    return stats.withColumns({"difficulty": 1 - a, "discrimination": 4 * a * (1 - a)})


def ensemble_accuracy(df: DataFrame, item: str = "item_id", correct: str = "correct") -> DataFrame:
    """Mean correctness over systems per item."""
    return df.groupBy(item).agg(F.avg(F.col(correct).cast("double")).alias("ensemble_accuracy"))


def item_category(stats: DataFrame) -> DataFrame:
    """Category of each item; the median discrimination is the exact global one.

    ``percentile`` keeps counts of distinct values, which for discrimination are
    at most as many as there are (correct, total) combinations of systems.
    """
    median = stats.select(F.percentile("discrimination", F.lit(0.5))).scalar()
    a = F.col("accuracy")
    return stats.withColumn(
        "category",
        F.when((a > 0.3) & (a < 0.8) & (F.col("discrimination") > median), CATEGORIES[0])
        .when(a <= 0.1, CATEGORIES[2])
        .when(a >= 0.9, CATEGORIES[1])
        .otherwise(CATEGORIES[3]),
    )


def category_summary(categories: DataFrame) -> DataFrame:
    """Number of items per category, mean discrimination and median accuracy."""
    c = F.col("category")
    return categories.agg(
        F.count_if(c == CATEGORIES[0]).alias("highly_discriminative"),
        F.count_if(c == CATEGORIES[1]).alias("ceiling_items"),
        F.count_if(c == CATEGORIES[2]).alias("floor_items"),
        F.avg("discrimination").alias("mean_discrimination"),
        F.percentile("accuracy", F.lit(0.5)).alias("median_accuracy"),
    )


def consensus_items(stats: DataFrame) -> DataFrame:
    """Items almost every system misses (hard) or solves (easy)."""
    a = F.col("accuracy")
    label = F.when(a < 0.2, "hard").when(a > 0.9, "easy")
    return stats.withColumn("consensus", label).where(F.col("consensus").isNotNull())


def top_discriminative(stats: DataFrame, n: int = 10, item: str = "item_id") -> DataFrame:
    """O2: the ``n`` most discriminative items."""
    return stats.orderBy(F.desc("discrimination"), item).limit(n)
