"""Concordance, correlations and trends, from histograms and moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.functions import bands, stats
from gradeframe.operators.ranks import null_safe_join, rank_average, value_ranks


def pearson(df: DataFrame, x: str, y: str, by: list[str] | None = None, p_value: bool = True) -> DataFrame:
    """Pearson correlation per group, with its two-sided p-value."""
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    out = df.where(xd.isNotNull() & yd.isNotNull()).groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.corr(xd, yd).alias("r")
    )
    return out.withColumn("p_value", stats.correlation_p("r", "n")) if p_value else out


def _weighted_corr(x: Column, y: Column, w: Column) -> Column:
    """Correlation of centred values with weights."""
    return F.sum(w * x * y) / F.nullif(F.sqrt(F.sum(w * x * x)) * F.sqrt(F.sum(w * y * y)), F.lit(0.0))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None, p_value: bool = True) -> DataFrame:
    """Spearman correlation per group.

    Rows collapse to the joint histogram of (x, y); ranks of distinct values are
    joined to it and centred, so no group is ever ranked in one task. A NULL group is a group.
    """
    by = by or []
    joint = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_w"))
    rx = value_ranks(joint, by, x, "_w").select(*by, x, F.col("avg_rank").alias("_rx"), F.col("n_total").alias("n"))
    ry = value_ranks(joint, by, y, "_w").select(*by, y, F.col("avg_rank").alias("_ry"))
    ranked = null_safe_join(null_safe_join(joint, rx, [*by, x]), ry, [*by, y])
    middle = (F.col("n") + 1) / 2.0
    out = ranked.groupBy(*by, "n").agg(
        _weighted_corr(F.col("_rx") - middle, F.col("_ry") - middle, F.col("_w").cast("double")).alias("rho")
    )
    return out.withColumn("p_value", stats.correlation_p("rho", "n")) if p_value else out


def spearman_features(df: DataFrame, features: list[str], target: str, by: str = "task", min_rows: int = 10) -> DataFrame:
    """Spearman correlation of every feature with the target, per task.

    Features become rows, so that one plan serves all of them.
    """
    entries = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("value")) for f in features])
    long = df.select(by, F.col(target).alias("_y"), F.explode(entries).alias("e")).select(by, "e.feature", "e.value", "_y")
    return spearman(long, "value", "_y", [by, "feature"]).where(F.col("n") >= min_rows)


def spearman_matrix(accuracies: DataFrame, unit: str = "model", variable: str = "task", value: str = "accuracy") -> DataFrame:
    """Spearman correlation of every pair of tasks over systems.

    Input is a finished accuracy table: one row per system and task.
    """
    ranked = rank_average(accuracies, [variable], value, "_rank")
    left = ranked.select(F.col(unit), F.col(variable).alias("task_a"), F.col("_rank").alias("_ra"))
    right = ranked.select(F.col(unit), F.col(variable).alias("task_b"), F.col("_rank").alias("_rb"))
    return left.join(right, unit).groupBy("task_a", "task_b").agg(F.corr("_ra", "_rb").alias("rho"))


def linear_trend(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Least-squares slope and intercept per group."""
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*(by or [])).agg(
        F.regr_count(yd, xd).alias("n"), F.regr_slope(yd, xd).alias("slope"), F.regr_intercept(yd, xd).alias("intercept")
    )


def kendalls_w(accuracies: DataFrame, rater: str = "model", item: str = "task", value: str = "accuracy", p_value: bool = True) -> DataFrame:
    """Concordance of systems about tasks; tied ranks are averaged, without tie correction.

    Input is a finished accuracy table: one row per system and task.
    """
    ranked = rank_average(accuracies.withColumn(value, F.coalesce(F.col(value), F.lit(0.0))), [rater], value, "_rank")
    sums = ranked.groupBy(item).agg(F.sum("_rank").alias("_s"), F.count(F.lit(1)).alias("_m"))
    total = sums.agg(
        F.max("_m").alias("n_raters"), F.count(F.lit(1)).alias("n_items"),
        (F.var_pop("_s") * F.count(F.lit(1))).alias("S"),
    )
    m, k = F.col("n_raters").cast("double"), F.col("n_items").cast("double")
    out = total.withColumn("W", 12 * F.col("S") / F.nullif(m * m * (k * k * k - k), F.lit(0.0)))
    out = out.withColumn("chi2", m * (k - 1) * F.col("W")).withColumn("strength", bands.concordance_band("W"))
    return out.withColumn("p_value", stats.chi2_sf("chi2", k - 1)) if p_value else out
