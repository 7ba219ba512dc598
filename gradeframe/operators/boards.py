"""The leaderboard of submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.operators.ranks import null_safe_join, numbered, value_ranks
from gradeframe.operators.tables import dedupe

SCORES = ["overall", "score_REG", "score_NUM", "score_CON", "score_TMP"]


def leaderboard(submissions: DataFrame, include_duplicates: bool = False, key: str = "hf_id", tie: str | None = None) -> DataFrame:
    """Best submission per system, ranked by overall score, then by time, then by ``tie``.

    Ranks come from score and time buckets, so a board of any size is ranked
    without sorting it in one task; systems without a score come last. Scores are shown in percent, one decimal.
    """
    tie = tie or key
    order = [F.desc("overall"), F.col("submitted_at"), F.col(tie)]
    rows = submissions if include_duplicates else dedupe(submissions, [key], order)
    rows = rows.withColumns({"_all": F.lit(0), "_score": -F.col("overall"), "_time": F.unix_micros(F.col("submitted_at").cast("timestamp"))})
    before = value_ranks(rows, ["_all"], "_score").select("_score", F.col("n_before").alias("_before"))
    placed = null_safe_join(numbered(rows, ["_score"], "_time", [tie], "_rn"), before, ["_score"])
    board = placed.withColumn("rank", F.col("_before") + F.col("_rn")).drop("_all", "_score", "_time", "_rn", "_before")
    return board.withColumns({c: F.round(F.col(c) * 100, 1) for c in SCORES if c in board.columns})
