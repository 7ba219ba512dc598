"""What kind of errors systems make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe import fixed_values as fv


def error_type(task: str = "task", difficulty: str = "difficulty", mapping: dict[tuple[str, str], str] | None = None) -> Column:
    """Error type of a (task, difficulty) cell; unknown cells are domain knowledge failures."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    level = F.coalesce(F.col(difficulty), F.lit("medium"))
    for (task_name, level_name), label in (mapping or fv.ERROR_BY_TASK_DIFFICULTY).items():
        out = out.when((F.col(task) == task_name) & (level == level_name), label)
    return out.otherwise(fv.DOMAIN_ERROR)


def error_type_by_task(task: str = "task", mapping: dict[str, str] | None = None) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, label in (mapping or fv.ERROR_BY_TASK).items():
        out = out.when(F.col(task) == name, label)
    return out


def failures(df: DataFrame, mapping: dict[tuple[str, str], str] | None = None, correct: str = "correct") -> DataFrame:
    """Wrong answers with their error type."""
    return df.where(F.col(correct) == 0).withColumn("error_type", error_type(mapping=mapping))


def _dense(df: DataFrame, label: Column, wrong: Column, types: list[str], model: str) -> DataFrame:
    """Counts for every system and type, zeros included: one pass, then unpivot."""
    counted = df.groupBy(model).agg(*[F.count_if(wrong & (label == t)).alias(f"c{i}") for i, t in enumerate(types)])
    entries = F.array(*[F.struct(F.lit(t).alias("error_type"), F.col(f"c{i}").alias("count")) for i, t in enumerate(types)])
    return counted.select(model, F.explode(entries).alias("e")).select(model, "e.error_type", "e.count")


def error_taxonomy(df: DataFrame, mapping: dict[tuple[str, str], str] | None = None, model: str = "model", correct: str = "correct") -> DataFrame:
    """Errors per system and type by task and difficulty."""
    return _dense(df, error_type(mapping=mapping), F.col(correct) == 0, fv.ERROR_TYPES, model)


def error_taxonomy_by_task(df: DataFrame, mapping: dict[str, str] | None = None, model: str = "model", correct: str = "correct") -> DataFrame:
    """Errors per system and type by task alone, with their share of the system's errors."""
    table = _dense(df, error_type_by_task(mapping=mapping), F.col(correct) == 0, fv.ERROR_TYPES, model)
    total = F.sum("count").over(Window.partitionBy(model))
    return table.withColumn("total_errors", total).withColumn("share", F.col("count") / F.nullif(F.col("total_errors").cast("double"), F.lit(0.0)))


def examples_per_group(df: DataFrame, by: list[str] | None = None, n: int = 2, order: str = "item_id", previews: dict[str, int] | None = None) -> DataFrame:
    """The first ``n`` failures of each group, long texts shortened for display."""
    w = Window.partitionBy(*(by or ["model", "error_type"])).orderBy(order)
    first = df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    return first.withColumns({c: F.left(F.col(c), F.lit(k)) for c, k in (previews or {}).items()})


def first_per_group(df: DataFrame, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """One representative per group."""
    w = Window.partitionBy(*(by or ["error_type"])).orderBy(*(order or ["model", "item_id"]))
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
