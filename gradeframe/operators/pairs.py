"""Systems compared item by item.

Comparing M systems on N items has M*M/2 pairs for every item. Outcomes of a
system become bitmaps over numbered items, and pairs are only ever formed on
bitmaps: 64 items at once, by blocks of systems.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.functions.bands import lookup
from gradeframe.operators.accuracy import ratio
from gradeframe.operators.ranks import HASH_BOUNDS, numbered
from gradeframe.session import ensure_checkpoint_dir

REPLICATES = 10_000
SEED = 42
ALPHA = 0.05
#: Systems in a block, and words of 64 items that two blocks compare at once.
SYSTEMS, WORDS = 256, 4096
#: Ranges of hashes within which items are numbered.
ITEM_BUCKETS = 1024
#: Parts that each side of a grid of systems is dealt to.
PARTS = 8
#: Indexed bootstrap: items in a row and in a task (one number each), replicates in a block, draws made at once, tasks.
PART, SPAN, BLOCK_REPLICATES, DRAWS, TASKS = 1 << 14, 1 << 24, 50, 1 << 15, 200


def aligned_pairs(df: DataFrame, a: str, b: str, item: str = "item_id", model: str = "model", correct: str = "correct", keep: list[str] | None = None) -> DataFrame:
    """Items both systems answered, with both outcomes, in one aggregation."""
    keys = [item, *(keep or [])]

    def of(name: str) -> Column:
        return F.max(F.when(F.col(model) == name, F.col(correct)))

    both = df.where(F.col(model).isin(a, b)).groupBy(*keys).agg(of(a).alias("correct_a"), of(b).alias("correct_b"))
    return both.where(F.col("correct_a").isNotNull() & F.col("correct_b").isNotNull())


def correctness_matrix(df: DataFrame, models: list[str], item: str = "item_id", model: str = "model", correct: str = "correct") -> DataFrame:
    """One row per item, one column per system, NULL where a system has no answer."""
    return df.groupBy(item).pivot(model, models).agg(F.max(correct))


def outcome_bitmaps(df: DataFrame, by: list[str] | None = None, item: str = "item_id", model: str = "model", correct: str = "correct") -> DataFrame:
    """(by, model, word, answered, right): for each system and up to 64 items, which it answered and got right.

    Items are numbered within ITEM_BUCKETS ranges of their hash, alike for all
    systems. Repeated rows of an item merge before the shuffle; if copies
    disagree the better outcome counts. Runs at once and is checkpointed: pairs
    read the bitmaps from several sides.
    """
    by = by or []
    told = df.where(F.col(correct).isNotNull() & F.col(model).isNotNull())
    found = told.groupBy(*by, item, model).agg(F.max(F.col(correct).cast("int")).alias("_c"))
    bucket = F.pmod(F.xxhash64(*by, item), F.lit(ITEM_BUCKETS))
    place = F.dense_rank().over(Window.partitionBy("_bucket").orderBy(*by, item)) - 1
    placed = found.withColumn("_bucket", bucket).withColumn("_i", place)
    bit = F.expr("shiftleft(1L, _i % 64)")
    ensure_checkpoint_dir(df.sparkSession)
    return placed.groupBy(*by, model, (F.shiftleft("_bucket", 32) + F.floor(F.col("_i") / 64)).alias("word")).agg(
        F.bit_or(bit).alias("answered"), F.bit_or(F.when(F.col("_c") == 1, bit).otherwise(F.lit(0).cast("long"))).alias("right")
    ).checkpoint()


def _block_counts(by: list[str], model: str, schema: T.StructType):
    def dense(side: pd.DataFrame, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names, rows = np.unique(side[model].to_numpy(dtype=object), return_inverse=True)
        out = np.zeros((2, len(names), len(words)), np.uint64)
        at = np.searchsorted(words, side["word"].to_numpy())
        for k, name in enumerate(("answered", "right")):
            out[k, rows, at] = side[name].to_numpy(np.int64).view(np.uint64)
        return names, out[0], out[1]

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        words = np.intersect1d(left["word"], right["word"])
        left, right = (x[np.isin(x["word"], words)] for x in (left, right))
        a_names, a_told, a_right = dense(left, words)
        b_names, b_told, b_right = dense(right, words)
        found: list[list[np.ndarray]] = []
        for i, name in enumerate(a_names):
            # Within one block every pair is met from both sides; between blocks once.
            use = np.array([name < x for x in b_names], bool) if key[-2] == key[-1] else np.ones(len(b_names), bool)
            told, hit = b_told[use], b_right[use]
            n, both, only_a, only_b = [np.bitwise_count(m).sum(1, dtype=np.int64) for m in (a_told[i] & told, a_right[i] & hit, a_right[i] & told & ~hit, a_told[i] & ~a_right[i] & hit)]
            other, one = b_names[use], np.full(int(use.sum()), name, object)
            swap, met = np.array([x < name for x in other], bool), n > 0
            found.append([x[met] for x in (np.where(swap, other, one), np.where(swap, one, other), n, both, np.where(swap, only_b, only_a), np.where(swap, only_a, only_b))])
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, object)] * 2 + [np.zeros(0, np.int64)] * 4
        out = pd.DataFrame({n: pd.Series(c, dtype=c.dtype) for n, c in zip(("model_a", "model_b", "n", "both", "only_a", "only_b"), columns)})
        return out.assign(**dict(zip(by, key[: len(by)])))[schema.names]

    return run


def pair_counts(bitmaps: DataFrame, by: list[str] | None = None, model: str = "model", systems: int = SYSTEMS, words: int = WORDS) -> DataFrame:
    """For every unordered pair of systems that share items, how often both, one or none was right.

    Blocks of ``systems`` systems meet block by block over ``words`` words of 64
    items; a pair's counts are the bits that two bitmaps share. No row or task
    holds all systems. Runs at once to count systems and words.
    """
    by = by or []
    size = bitmaps.agg(F.count_distinct(model).alias("m"), F.approx_count_distinct("word").alias("w")).first()
    n_blocks, n_chunks = max(1, -(-size["m"] // systems)), max(1, -(-size["w"] // words))
    block, chunk = F.pmod(F.xxhash64(model), F.lit(n_blocks)), F.pmod(F.xxhash64("word"), F.lit(n_chunks)).alias("_chunk")
    rows = bitmaps.select(*by, model, "word", "answered", "right", block.alias("_b"), chunk)
    kept = (*by, "_chunk", model, "word", "answered", "right")
    left = rows.select(*[F.col(c).alias(c) for c in kept], F.col("_b").alias("_i"), F.explode(F.sequence(F.col("_b"), F.lit(n_blocks - 1).cast("long"))).alias("_j"))
    right = rows.select(*[F.col(c).alias(c) for c in kept], F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"))
    names = T.StructType([T.StructField(n, bitmaps.schema[model].dataType) for n in ("model_a", "model_b")])
    schema = T.StructType([*[bitmaps.schema[c] for c in by], *names.fields, *[T.StructField(n, T.LongType()) for n in ("n", "both", "only_a", "only_b")]])
    keys = [*by, "_chunk", "_i", "_j"]
    counts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_block_counts(by, model, schema), schema)
    return counts.groupBy(*by, "model_a", "model_b").agg(*[F.sum(n).alias(n) for n in ("n", "both", "only_a", "only_b")])


def all_pairs(df: DataFrame, by: list[str] | None = None, item: str = "item_id", model: str = "model", correct: str = "correct") -> DataFrame:
    """Counts, accuracies and difference for every pair of systems on shared items."""
    counts = pair_counts(outcome_bitmaps(df, by, item, model, correct), by, model)
    return counts.withColumns({
        "acc_a": ratio(F.col("both") + F.col("only_a"), "n"),
        "acc_b": ratio(F.col("both") + F.col("only_b"), "n"),
        "delta": ratio(F.col("only_a") - F.col("only_b"), "n"),
    })


def error_jaccard(df: DataFrame, item: str = "item_id", model: str = "model", correct: str = "correct") -> DataFrame:
    """Overlap of errors for all ordered pairs; a missing answer is an error, diagonal 1.

    Needs no dense grid: errors of a pair follow from how often a, b and both
    were right and from the number of items. The result has a row for every
    ordered pair, also of systems that share no item.
    """
    bitmaps = outcome_bitmaps(df, None, item, model, correct)
    total = bitmaps.groupBy("word").agg(F.bit_or("answered").alias("any")).select(F.sum(F.bit_count("any"))).scalar()
    right = bitmaps.groupBy(F.col(model).alias("m")).agg(F.sum(F.bit_count("right")).alias("k"))
    # Systems meet in PARTS x PARTS parts, so that no task holds one side.
    part = F.pmod(F.xxhash64("m"), F.lit(PARTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    a = right.select(F.col("m").alias("model_a"), F.col("k").alias("_ka"), part.alias("_p"), every.alias("_q"))
    b = right.select(F.col("m").alias("model_b"), F.col("k").alias("_kb"), every.alias("_p"), part.alias("_q"))
    grid = a.join(b, ["_p", "_q"]).drop("_p", "_q")
    counted = pair_counts(bitmaps, None, model).select("model_a", "model_b", "both")
    both = counted.unionByName(counted.select(F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), "both"))
    grid = grid.join(both, ["model_a", "model_b"], "left")
    same = F.col("model_a") == F.col("model_b")
    grid = grid.withColumn("both", F.when(same, F.col("_ka")).otherwise(F.coalesce("both", F.lit(0))))
    grid = grid.withColumns({"n_both_wrong": total - F.col("_ka") - F.col("_kb") + F.col("both"), "n_either_wrong": total - F.col("both")})
    value = F.when(same, 1.0).when(F.col("n_either_wrong") > 0, F.col("n_both_wrong") / F.col("n_either_wrong")).otherwise(0.0)
    return grid.select("model_a", "model_b", "n_both_wrong", "n_either_wrong", value.alias("jaccard"))


def bootstrap_p(n: int, gains: int, losses: int, replicates: int, rng: np.random.Generator) -> float:
    """Two-sided p-value of a paired, centred bootstrap from its sufficient counts.

    Resampling n differences in {-1, 0, 1} is one multinomial draw per
    replicate; comparing integers leaves no rounding at the boundary.
    """
    if n == 0:
        return 1.0
    observed = gains - losses
    draws = rng.multinomial(n, [gains / n, losses / n, (n - gains - losses) / n], size=replicates)
    shift = draws[:, 0] - draws[:, 1] - observed
    return float(np.mean(np.abs(shift) >= abs(observed)))


def exact_bootstrap_p(n: int, gains: int, losses: int) -> float:
    """What ``bootstrap_p`` tends to with ever more replicates: a tail of the difference of two multinomial counts.

    The difference of a replicate is a sum of n draws from {-1, 0, 1}. Its
    distribution comes from the draws' characteristic function by one Fourier
    transform over twelve deviations to each side; what lies beyond is below
    1e-30. The length grows with the root of n.
    """
    observed = gains - losses
    if n == 0 or observed == 0:
        return 1.0
    mean = observed / n
    deviation = math.sqrt(n * ((gains + losses) / n - mean * mean))
    if deviation == 0 or abs(observed) > 12 * deviation + 1:
        return 0.0
    size = 1 << max(6, math.ceil(math.log2(24 * deviation + 8)))
    angle = 2 * math.pi * np.arange(size) / size
    # Turned back by the mean, so that powers keep small angles.
    draw = gains / n * np.exp(1j * angle * (1 - mean)) + losses / n * np.exp(-1j * angle * (1 + mean)) + (n - gains - losses) / n * np.exp(-1j * angle * mean)
    shift = np.fft.fft(np.abs(draw) ** n * np.exp(1j * n * np.angle(draw))).real / size
    near = np.arange(-abs(observed) + 1, abs(observed))
    return float(min(max(1 - shift[near % size].sum(), 0.0), 1.0)) if len(near) < size else 0.0


@F.pandas_udf(T.DoubleType())
def _exact_p(n: pd.Series, gains: pd.Series, losses: pd.Series) -> pd.Series:
    return pd.Series([exact_bootstrap_p(int(a), int(b), int(c)) for a, b, c in zip(n, gains, losses)], dtype="float64")


def _p_values(replicates: int, seed: int):
    @F.pandas_udf(T.DoubleType())
    def p_values(key: pd.Series, n: pd.Series, gains: pd.Series, losses: pd.Series) -> pd.Series:
        return pd.Series([
            bootstrap_p(int(a), int(b), int(c), replicates, np.random.default_rng([seed, int(k) & 0xFFFFFFFF]))
            for k, a, b, c in zip(key, n, gains, losses)
        ], dtype="float64")

    return p_values


def with_bootstrap_p(pairs: DataFrame, key: list[str], replicates: int | None = None, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """P-value of each counted pair, exact, or of ``replicates`` draws; then each key has its own reproducible stream."""
    counts = [F.col("n"), F.col("only_a"), F.col("only_b")]
    p = _exact_p(*counts) if replicates is None else _p_values(replicates, seed)(F.xxhash64(*key), *counts)
    return pairs.withColumn("p_value", p).withColumn("significant", F.col("p_value") < alpha)


def paired_bootstrap(df: DataFrame, by: list[str] | None = None, replicates: int | None = None, seed: int = SEED, **names: str) -> DataFrame:
    """All pairs with accuracies, difference and bootstrap p-value: the limit of ever more replicates, or that of so many."""
    by = by or []
    return with_bootstrap_p(all_pairs(df, by, **names), [*by, "model_a", "model_b"], replicates, seed)


def _along(df: DataFrame, by: list[str], item: str, carry: DataFrame | None = None) -> DataFrame:
    """Row number ``_pos`` within ``by`` along numeric ids, or along the hash of other ids; ``carry`` adds columns of the group."""
    if isinstance(df.schema[item].dataType, T.NumericType):
        return numbered(df, by, item, out="_pos", carry=carry)
    hashed = df.withColumn("_hash", F.xxhash64(item))
    return numbered(hashed, by, "_hash", [item], "_pos", bounds=HASH_BOUNDS, carry=carry).drop("_hash")


def _drawn_sums(n: int, span: int):
    """For a block of replicates and a span of items: sums and counts of the draws that hit the span."""
    prime = 2147483647

    def run(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table.column("_part").to_pylist(), range(table.num_rows)))
        held = table.column("_d").combine_chunks()
        ends, flat = held.offsets.to_numpy(), held.values.to_numpy()
        d = np.concatenate([flat[ends[i] : ends[i + 1]] for _, i in parts])
        low, replicates = table.column("_span")[0].as_py() * span, table.column("_replicates")[0].as_py()
        sums, hits = np.zeros(len(replicates), np.result_type(d, np.int64)), np.zeros(len(replicates), np.int64)
        for start in range(0, n, DRAWS):
            j = np.arange(start, min(start + DRAWS, n), dtype=np.int64)
            step = j * 48271
            for k, r in enumerate(replicates):
                x = (step + (r + 1) * 16807) % prime
                y = (x * x + r) % prime
                at = (y * y + j) % prime % n
                if n > len(d):
                    at = at[(at >= low) & (at < low + len(d))] - low
                sums[k] += d[at].sum()
                hits[k] += len(at)
        return pa.table({"replicate": pa.array(replicates, pa.int64()), "sum": sums.astype(float), "n": hits})

    return run


def paired_bootstrap_indexed(
    df: DataFrame, a: str, b: str, index: str = "item_id", replicates: int = REPLICATES,
    model: str = "model", correct: str = "correct", part: int = PART, span: int = SPAN,
) -> DataFrame:
    """D3: explicit replicates whose draws come from arithmetic, for exact checks.

    The items both systems answered are numbered 0..n-1 along ``index`` (text
    ids along their hash). Draw j of replicate r takes an item by squaring
    ``j*48271 + (r+1)*16807`` twice modulo 2^31-1. The work is replicates * n
    draws, so this is the check of D2, not its replacement.

    Differences are packed, ``part`` to a row. A task takes a block of
    replicates and a span of about ``span`` items, makes all draws and adds up
    those that hit its span, so no draw becomes a row. Runs at once to pack.
    """
    shared = _along(aligned_pairs(df, a, b, index, model, correct), [], index).select(
        (F.col("_pos") - 1).alias("_i"), (F.col("correct_a") - F.col("correct_b")).alias("_d")
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_d"))), lambda x: x["_d"])
    ensure_checkpoint_dir(df.sparkSession)
    packed = shared.groupBy(F.floor(F.col("_i") / part).alias("_part")).agg(ordered.alias("_d")).checkpoint()
    size = F.sum(F.size("_d").cast("long")).alias("n")
    told = packed.agg(size, F.sum(F.aggregate("_d", F.lit(0.0), lambda s, x: s + x)).alias("total")).first()
    n, parts = told["n"] or 0, max(1, span // part)
    blocks = F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(BLOCK_REPLICATES))
    each = F.sequence(F.col("_first"), F.least(F.col("_first") + BLOCK_REPLICATES, F.lit(replicates)) - 1)
    rows = packed.select("_part", "_d", F.floor(F.col("_part") / parts).alias("_span"), F.explode(blocks).alias("_first")).withColumn("_replicates", each)
    # So few bytes would be put into few tasks, but the work is in the draws.
    tasks = min(TASKS, -(-replicates // BLOCK_REPLICATES) * max(1, -(-n // (parts * part))))
    sums = rows.repartition(tasks, "_first", "_span").groupBy("_first", "_span").applyInArrow(_drawn_sums(n, parts * part), "replicate long, sum double, n long")
    means = sums.groupBy("replicate").agg((F.sum("sum") / F.sum("n")).alias("mean_delta"))
    means = means.withColumn("observed", F.lit(told["total"] / n if n else None).cast("double"))
    extreme = F.abs(F.round(F.col("mean_delta") - F.col("observed"), 9)) >= F.round(F.abs("observed"), 9)
    return means.withColumn("extreme", F.when(extreme, 1).otherwise(0))


def two_sample_bootstrap(
    df: DataFrame, groups: dict[str, str], a: str, b: str, item: str = "item_id", by: str = "task",
    replicates: int | None = None, seed: int = SEED, model: str = "model", correct: str = "correct",
) -> DataFrame:
    """D4 (legacy): pooled rows of two groups, cut to the shorter one, shared draws.

    Rows are paired by their position, which is what this older comparison
    means: along numeric ids, or along the hash of text ids.
    ``paired_bootstrap`` pairs by item and is the one to use.
    """
    rows = df.withColumn("_side", lookup(model, groups)).where(F.col("_side").isin(a, b))
    # Position = rows of earlier systems in the group + position inside the system.
    sizes = rows.groupBy("_side", by, model).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_side", by).orderBy(model).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_skip", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    placed = _along(rows, ["_side", by, model], item, sizes).withColumn("_pos", F.col("_pos") + F.col("_skip"))

    def of(name: str) -> Column:
        return F.max(F.when(F.col("_side") == name, F.col(correct)))

    zipped = placed.groupBy(by, "_pos").agg(of(a).alias("ca"), of(b).alias("cb"))
    zipped = zipped.where(F.col("ca").isNotNull() & F.col("cb").isNotNull())
    counts = zipped.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("ca").cast("double")).alias("acc_a"), F.avg(F.col("cb").cast("double")).alias("acc_b"),
        F.count_if((F.col("ca") == 1) & (F.col("cb") == 0)).alias("only_a"),
        F.count_if((F.col("ca") == 0) & (F.col("cb") == 1)).alias("only_b"),
    )
    return with_bootstrap_p(counts, [by], replicates, seed)
