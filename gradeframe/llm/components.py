"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.shared import written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of ``edges`` (a, b); root is the smallest id reachable.

    Every step is a partial minimum per vertex and a join back, so a vertex with
    very many neighbours is never gathered; adaptive execution splits its join.
    Stops when the set of edges no longer changes. Self-loops and repeated edges
    do no harm; no edges give no rows.
    """
    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = _least(large)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m")).where("a != b").distinct()
        now = written(small, "edges")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if seen == before:
            break
        before = seen
    roots = written(now.groupBy("a").agg(F.min("b").alias("root")), "roots")
    return roots.select(F.col("a").alias("id"), "root").union(roots.select(F.col("root").alias("id"), "root").distinct())
