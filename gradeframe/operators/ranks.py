"""Ranks and row numbers that never put a whole group, or everything, in one task.

A plain window gives each partition to one task, which fails when one group
holds a large share of the rows. Here counts per value bucket give the offset
of every bucket, and only rows of one bucket meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
#: Entries of the quantile sketch for each bucket: a bucket holds its share of the values within a tenth.
SKETCH = 10
# Range of a 64-bit hash.
HASH_BOUNDS = (-(2**63), 2**63 - 1)


def _of_bounds(value: Column, low: float, high: float, buckets: int) -> Column:
    """Buckets of equal width, for values that are spread evenly."""
    width = float(high) - float(low)
    return F.coalesce(F.floor((value.cast("double") - low) / width * (buckets - 1)), F.lit(0))


def _of_splitters(value: Column, splitters: Column, buckets: int) -> Column:
    """How many of the sorted ``splitters`` are not above the value, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(buckets.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(splitters, at + step - 1) <= value.cast("double"), step).otherwise(0))


def null_safe_join(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the keys of ``df`` stay."""
    renamed = other.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys]
    return df.join(renamed, same, how).drop(*[f"_other_{k}" for k in keys])


def spread_join(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = 64) -> DataFrame:
    """Join on keys of few values; if it is shuffled, rows of a key go to ``salts`` tasks, where ``small`` is repeated."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int")
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return null_safe_join(df.withColumn("_salt", salt), repeated, [*keys, "_salt"], how).drop("_salt")


def _bucketed(df: DataFrame, value: str, buckets: int, known: tuple[int, int] | None = None) -> DataFrame:
    """Add ``_bucket``: ranges with equal shares of the values, between quantiles of a sketch, or within ``known`` bounds of even values. NULL is last."""
    if known is not None:
        place = _of_bounds(F.col(value), *known, buckets)
    else:
        # One parsed expression: an array of a thousand columns would take longer to build than to use.
        shares = F.expr(f"array({','.join(f'{i / buckets!r}D' for i in range(1, buckets))})")
        splitters = df.agg(F.percentile_approx(F.col(value).cast("double"), shares, SKETCH * buckets).alias("s")).scalar()
        df = df.withColumn("_splitters", splitters)
        place = _of_splitters(F.col(value), F.col("_splitters"), buckets)
    return df.withColumn("_bucket", F.when(F.col(value).isNull(), buckets).otherwise(place).cast("int")).drop("_splitters")


def _offsets(counted: DataFrame, by: list[str], count: Column) -> DataFrame:
    """Rows before each bucket of a group, and in the group; at most BUCKETS rows per group reach the window."""
    per_bucket = counted.groupBy(*by, "_bucket").agg(count.alias("_size"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.select(*by, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"), F.sum("_size").over(group).alias("_total"))


def numbered(
    df: DataFrame, by: list[str], order: str, ties: list[str] | None = None, out: str = "rn", buckets: int = BUCKETS,
    bounds: tuple[int, int] | None = None, total: str | None = None, carry: DataFrame | None = None,
) -> DataFrame:
    """Exact row number within ``by`` along the numeric column ``order``; NULL comes last, a NULL group is a group.

    ``bounds`` of a column of even values, where known, spare a pass over the rows.
    ``total`` names a column for the size of the group, and ``carry`` is a table
    with one row per group whose columns are added; both come with the offsets,
    so rows are not joined by group.
    """
    df = _bucketed(df, order, buckets, bounds)
    offsets = _offsets(df, by, F.count(F.lit(1)))
    offsets = offsets.withColumnRenamed("_total", total) if total else offsets.drop("_total")
    if carry is not None:
        offsets = null_safe_join(offsets, carry, by)
    inside = Window.partitionBy(*by, "_bucket").orderBy(F.col(order).asc_nulls_last(), *(ties or []))
    return (
        null_safe_join(df, offsets, [*by, "_bucket"])
        .withColumn(out, (F.col("_offset") + F.row_number().over(inside)).cast("long"))
        .drop("_offset", "_bucket")
    )


def value_ranks(
    df: DataFrame, by: list[str], value: str, weight: str | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Per group and distinct value its count, rows before it, average rank, and the group's rows ``n_total``."""
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    histogram = _bucketed(df.groupBy(*by, value).agg(size.alias("n_ties")), value, buckets)
    offsets = _offsets(histogram, by, F.sum("n_ties"))
    before = Window.partitionBy(*by, "_bucket").orderBy(F.col(value).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        null_safe_join(histogram, offsets, [*by, "_bucket"])
        .withColumn("n_before", (F.col("_offset") + F.coalesce(F.sum("n_ties").over(before), F.lit(0))).cast("long"))
        .withColumn("avg_rank", F.col("n_before") + (F.col("n_ties") + 1) / 2.0)
        .withColumnRenamed("_total", "n_total")
        .drop("_offset", "_bucket")
    )


def rank_average(df: DataFrame, by: list[str], value: str, out: str = "avg_rank") -> DataFrame:
    """The tie-averaged rank of every row within its group; NULL for a NULL value, which counts for no other rank."""
    ranks = value_ranks(df, by, value).select(*by, value, F.when(F.col(value).isNotNull(), F.col("avg_rank")).alias(out))
    return null_safe_join(df, ranks, [*by, value])
