"""Deterministic sampling and splitting.

Rows are ordered by a hash of seed and id (or by a key column given by the
caller). Row numbers are always bounded by a literal, so each map task sends at
most that many rows of a stratum to the shuffle, however large the stratum is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe import fixed_values as fv
from gradeframe.functions import bands
from gradeframe.operators.ranks import HASH_BOUNDS, numbered


def sample_key(item: str, seed: int = 42) -> Column:
    return F.xxhash64(F.lit(seed), F.col(item))


def _first(df: DataFrame, by: list[str], key: Column, item: str, limit: int, out: str = "rn") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(key, item)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= limit)


def item_filter(df: DataFrame, task: str = "All", difficulty: str = "All", task_col: str = "task_type", difficulty_col: str = "difficulty") -> DataFrame:
    """Items of a task and difficulty; "All" keeps everything."""
    if task != "All":
        df = df.where((bands.task_code(task_col) == task) | (F.col(task_col) == task))
    if difficulty != "All":
        df = df.where(F.col(difficulty_col) == difficulty.lower())
    return df


def pick_one(df: DataFrame, item: str = "id", seed: int = 42, key: Column | None = None) -> DataFrame:
    """One reproducible pick; ``key`` replaces the hash order."""
    return df.orderBy(sample_key(item, seed) if key is None else key, item).limit(1)


def shuffle(df: DataFrame, item: str = "id", seed: int = 42, key: Column | None = None) -> DataFrame:
    """O3: reproducible random order; ``key`` replaces the hash."""
    return df.orderBy(sample_key(item, seed) if key is None else key, item)


def shuffled_places(df: DataFrame, item: str = "id", seed: int = 42, key: Column | None = None, out: str = "place") -> DataFrame:
    """O3: the place of every row in the random order, from 1, without sorting all rows in one task."""
    rows = df.withColumn("_key", sample_key(item, seed) if key is None else key)
    return numbered(rows, [], "_key", [item], out, bounds=HASH_BOUNDS if key is None else None).drop("_key")


def stratified_sample(df: DataFrame, by: list[str], n: int, item: str = "item_id", seed: int = 42, key: Column | None = None) -> DataFrame:
    """min(n, size) rows of every stratum."""
    return _first(df, by, sample_key(item, seed) if key is None else key, item, n).drop("rn")


def stratified_sample_topup(df: DataFrame, by: list[str], n: int = 25, total: int = 100, item: str = "item_id", seed: int = 42, key: Column | None = None) -> DataFrame:
    """A stratified sample, filled up to ``total`` from the remaining rows."""
    key = sample_key(item, seed) if key is None else key
    # What fills the sample lies among the next `total` rows of some stratum, so
    # one bounded pass finds both parts: n + total rows per stratum at the most.
    first = _first(df, by, key, item, n + total)
    sampled, rest = first.where(F.col("rn") <= n), first.where(F.col("rn") > n)
    missing = F.greatest(F.lit(total) - sampled.select(F.count(F.lit(1))).scalar(), F.lit(0))
    # A limit keeps at most `total` rows of each partition before rows meet; only these are numbered.
    few = rest.orderBy(key, item).limit(total)
    more = few.withColumn("_place", F.row_number().over(Window.orderBy(key, item))).where(F.col("_place") <= missing)
    return sampled.unionByName(more.drop("_place")).drop("rn")


def nested_stratified(df: DataFrame, sizes: dict[str, int] | None = None, task: str = "task", difficulty: str = "difficulty", item: str = "item_id", seed: int = 42, key: Column | None = None) -> DataFrame:
    """Per task max(1, n // levels) rows of every difficulty, at most n in all."""
    sizes = sizes or fv.SHEET_SIZES
    limit = max(sizes.values())
    key = sample_key(item, seed) if key is None else key
    rows = df.withColumn("_n", bands.lookup(task, sizes)).where(F.col("_n").isNotNull())
    levels = rows.groupBy(task).agg(F.count_distinct(difficulty).alias("_levels"))
    first = _first(rows, [task, difficulty], key, item, limit).join(levels, task)
    quota = F.greatest(F.lit(1), F.floor(F.col("_n") / F.col("_levels")))
    chosen = _first(first.where(F.col("rn") <= quota), [task], F.col(difficulty), item, limit, "_rank")
    return chosen.where(F.col("_rank") <= F.col("_n")).drop("_n", "_levels", "rn", "_rank")


def rubric_sample(df: DataFrame, size: int = 60, difficulty: str = "difficulty", item: str = "item_id", seed: int = 42, key: Column | None = None) -> DataFrame:
    """Size // 3 items per difficulty if there are more than ``size`` items, else all."""
    key = sample_key(item, seed) if key is None else key
    few = df.select(F.count(F.lit(1))).scalar() <= size
    return (
        _first(df, [difficulty], key, item, size).where(few | (F.col("rn") <= size // 3)).drop("rn")
    )


def stratified_split(df: DataFrame, by: list[str], fraction: float = 0.2, item: str = "item_id", seed: int = 42, key: str | None = None) -> DataFrame:
    """``split`` is 'dev' for round(fraction * size) rows of every stratum, else 'test'.

    Every row is ranked, so ranks come from bucket offsets: a stratum with a
    large share of all rows is spread over many tasks. NULL is a stratum.
    """
    rows = df if key else df.withColumn("_key", sample_key(item, seed))
    ranked = numbered(rows, by, key or "_key", [item], "_rn", bounds=None if key else HASH_BOUNDS, total="_size")
    out = ranked.withColumn("split", F.when(F.col("_rn") <= F.round(F.col("_size") * F.lit(fraction)), "dev").otherwise("test"))
    return out.drop("_rn", "_size", "_key") if not key else out.drop("_rn", "_size")


def hard_subset(df: DataFrame, size: int = 60, tasks: list[str] | None = None, task: str = "task", difficulty: str = "difficulty", item: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """All hard items plus medium ones shared evenly over tasks; and the pool of the rest.

    The first tasks get one more when the rest does not divide evenly. With more
    than ``size`` hard items the subset is larger than ``size``.
    """
    tasks = tasks or fv.TASKS
    level = F.lower(F.col(difficulty))
    hard = df.where(level == "hard")
    needed = F.greatest(F.lit(0), F.lit(size) - hard.select(F.count(F.lit(1))).scalar())
    position = bands.lookup(task, {name: i for i, name in enumerate(tasks)})
    quota = F.floor(needed / len(tasks)) + F.when(position < needed % len(tasks), 1).otherwise(0)
    medium = _first(df.where((level == "medium") & position.isNotNull()), [task], F.col(item), item, size)
    subset = hard.unionByName(medium.where(F.col("rn") <= quota).drop("rn"))
    return subset, df.join(subset.select(item), item, "left_anti")


def few_shot_examples(pool: DataFrame, n: int, task: str = "task", difficulty: str = "difficulty", item: str = "item_id") -> DataFrame:
    """``n`` easy items per task, or any items of a task with fewer easy ones; adds ``rank``."""
    easy = F.lower(F.col(difficulty)) == "easy"
    first_any = _first(pool, [task], F.col(item), item, n, "rank")
    first_easy = _first(pool.where(easy), [task], F.col(item), item, n, "rank")
    enough = first_easy.groupBy(task).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(task)
    return first_easy.join(enough, task, "left_semi").unionByName(first_any.join(enough, task, "left_anti"))


def eval_and_shots(df: DataFrame, by: list[str], n_eval: int = 25, n_shots: int = 3, item: str = "item_id", seed: int = 42, key: Column | None = None) -> DataFrame:
    """Shuffled per stratum, the first rows for evaluation, the next as shots (``role``)."""
    key = sample_key(item, seed) if key is None else key
    rows = _first(df, by, key, item, n_eval + n_shots)
    return rows.withColumn("role", F.when(F.col("rn") <= n_eval, "eval").otherwise("shot"))
