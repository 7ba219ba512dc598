"""N1-N4 and IO7: replies of judges and raters as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from gradeframe import schemas
from gradeframe.functions.text import col, strip


def judge_scores(reply: Column | str) -> Column:
    """Struct of three integer scores; NULL when the reply holds no usable JSON.

    A missing score counts as 0, fractions are cut (1.0 is 1); a score that is
    no number spoils the reply.
    """
    body = F.regexp_extract(col(reply), r"(?s)\{.*\}", 0)
    parsed = F.from_json(body, schemas.JUDGE_SCORES, {"mode": "PERMISSIVE"})
    names = {"event": "event_identification", "ordering": "temporal_ordering", "final": "final_state_answer"}
    raw = {short: parsed[full]["score"] for short, full in names.items()}
    scores = {short: F.when(text.isNull(), F.lit(0)).otherwise(F.coalesce(F.trim(text).try_cast("int"), F.trim(text).try_cast("double").try_cast("int"))) for short, text in raw.items()}
    usable = F.json_object_keys(body).isNotNull()
    for score in scores.values():
        usable = usable & score.isNotNull()
    return F.when(usable, F.struct(*[score.alias(f"{short}_score") for short, score in scores.items()]))


def parse_verdict(reply: Column | str) -> Column:
    """struct(verdict, reason).

    Without a separator the verdict is found by keyword, INCORRECT before
    CORRECT (the former contains the latter).
    """
    text = col(reply)
    parts = F.split(strip(text), r"\|", 2)
    upper = F.upper(text)
    keyword = (
        F.when(upper.contains("INCORRECT"), "INCORRECT")
        .when(upper.contains("CORRECT"), "CORRECT")
        .when(upper.contains("PARTIAL"), "PARTIAL")
        .otherwise("UNKNOWN")
    )
    split = text.contains("|")
    return F.struct(
        F.when(split, F.upper(strip(parts[0]))).otherwise(keyword).alias("verdict"),
        F.when(split, strip(F.try_element_at(parts, F.lit(2)))).otherwise(F.lit("")).alias("reason"),
    )


def rater_label(value: Column | str, strict: bool = False) -> Column:
    """yes/y/1 to 1, no/n/0 to 0; other values are NULL, or an error when strict."""
    v = F.lower(strip(col(value)))
    wrong = F.raise_error(F.concat(F.lit("not a rater label: "), F.coalesce(v, F.lit("NULL")))).cast("int")
    return (
        F.when(v.isin("yes", "y", "1"), 1)
        .when(v.isin("no", "n", "0"), 0)
        .otherwise(wrong if strict else F.lit(None).cast("int"))
    )


def explode_scores(df: DataFrame, scores: str = "scores") -> DataFrame:
    """One row per entry of a task-to-score map."""
    keep = [c for c in df.columns if c != scores]
    return df.select(*keep, F.explode(scores).alias("task", "score"))


def parse_rater_lines(df: DataFrame, text: str = "text", by: list[str] | None = None) -> DataFrame:
    """IO7: lines ``Row N: YES|NO | note`` as rows; the last line of a row number wins."""
    keys = by or []
    pattern = r"(?i)^Row\s+(\d+):\s*(YES|NO)\s*\|?\s*(.*)"
    lines = df.select(*keys, F.posexplode(F.split(text, r"\r?\n")).alias("_pos", "_line"))
    lines = lines.withColumn("_line", strip("_line")).where(F.col("_line").rlike(pattern))
    rows = lines.select(
        *keys,
        "_pos",
        F.regexp_extract("_line", pattern, 1).cast("long").alias("row_number"),
        F.upper(F.regexp_extract("_line", pattern, 2)).alias("label"),
        strip(F.regexp_extract("_line", pattern, 3)).alias("note"),
    )
    last = Window.partitionBy(*keys, "row_number").orderBy(F.desc("_pos"))
    return rows.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", "_pos")
