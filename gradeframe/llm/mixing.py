"""Temperature mixing of sources.

Source shares of tokens are raised to an exponent and normalised; the exponent
is bisected until the weights meet a target entropy, or until no source is
repeated more often than a limit. The weights become token budgets, and each
source meets its budget by whole passes (epochs) over its documents and one
partial pass. A pass is a permutation of blocks of documents.

Budgets are cut exactly without sorting a source: token sums per (source,
block) find the block where a pass ends, sums per part of that block find the
part, and only that part's documents are put in order. All tables on the way
have at most BLOCKS rows per source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.llm.shared import written

#: Blocks of a source, and parts of a block. Two cuts leave a millionth of a source to be put in order.
BLOCKS = 1024
STEPS = 60


def _shares(tokens: list[int], exponent: float) -> list[float]:
    top = max(tokens)
    raised = [(t / top) ** exponent for t in tokens]
    total = math.fsum(raised)
    return [r / total for r in raised]


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def bisect_exponent(tokens: list[int], target_entropy: float | None = None, repetition_limit: float | None = None, budget: int | None = None) -> float:
    """The exponent in [0, 1]: 0 is even weights, 1 is the sources' own shares.

    Entropy falls and the largest repetition falls as the exponent rises. Gives
    the largest exponent whose entropy reaches the target, or the smallest whose
    repetition is within the limit; at an end where the target is out of reach.
    Without a budget the largest need counts: every document once.
    """
    low, high = 0.0, 1.0

    def repeated(a: float) -> float:
        w = _shares(tokens, a)
        total = budget if budget is not None else max(t / x for t, x in zip(tokens, w, strict=True))
        return max(total * x / t for t, x in zip(tokens, w, strict=True))

    for _ in range(STEPS):
        middle = (low + high) / 2
        if target_entropy is not None:
            low, high = (middle, high) if entropy(_shares(tokens, middle)) >= target_entropy else (low, middle)
        else:
            low, high = (low, middle) if repeated(middle) <= repetition_limit else (middle, high)
    return low if target_entropy is not None else high


def source_budgets(sources: list[tuple[str, int]], target_entropy: float | None = None, repetition_limit: float | None = 2.0, budget: int | None = None) -> list[tuple[str, int, float, int]]:
    """(source, tokens, weight, token budget) of each source that has tokens.

    ``budget`` is the mixture's size; by default the smallest that holds every
    document at least once. The last digits of a budget are rounded to nearest.
    """
    known = [(s, t) for s, t in sources if t > 0]
    if not known:
        return []
    tokens = [t for _, t in known]
    weights = _shares(tokens, bisect_exponent(tokens, target_entropy, None if target_entropy is not None else repetition_limit, budget))
    total = budget if budget is not None else max(t / w for t, w in zip(tokens, weights, strict=True))
    return [(s, t, w, round(w * total)) for (s, t), w in zip(known, weights, strict=True)]


def _draw(seed: int, *parts: Column) -> Column:
    """A hash in [0, 2**31), the same in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(2**31))


def _running(rows: DataFrame, order: str) -> DataFrame:
    """Token sums before and up to each place of a source; equal places count together."""
    places = rows.groupBy("source", order).agg(F.sum("tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy("source").orderBy(order))
    return places.select("source", order, upto.alias("upto"), (upto - F.col("t")).alias("below"))


def token_count() -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as its tokens."""
    return F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), "")).cast("long")


def mix(docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = 2.0, budget: int | None = None, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """One row per use of a document: doc_id, source, tokens, epoch, block, place and the columns named in ``keep``.

    Order by (source, epoch, block, place) is the permutation; block and place
    are hashes that change with the epoch. A source's uses sum to its budget, or
    exceed it by less than its last place's documents. Rows with equal places
    (repeated rows) are used together. A null source is a source of its own;
    texts without words have no tokens and are used once per whole pass, at
    least once; a null doc_id is a document like any other. No rows, no uses.
    """
    rows = docs.select("doc_id", "source", token_count().alias("tokens"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"), *[F.col(c).alias(f"_{c}") for c in keep or []])
    small = written(rows.select("source", "tokens", "key"), "mixed")
    sizes = [tuple(r) for r in small.groupBy("source").agg(F.sum("tokens").alias("t")).orderBy(F.col("source").asc_nulls_first()).collect()]
    plan = source_budgets(sizes, target_entropy, repetition_limit, budget)
    spark = docs.sparkSession
    schema = "source string, size long, weight double, budget long"
    planned = {p[0] for p in plan}
    plan += [(s, 0, 0.0, 0) for s, _ in sizes if s not in planned]
    known = F.col("size") > 0
    passes = spark.createDataFrame(plan, schema).select(
        F.col("source").alias("_s"), F.when(known, F.floor(F.col("budget") / F.col("size"))).otherwise(1).cast("long").alias("whole"), F.when(known, F.col("budget") % F.col("size")).otherwise(0).alias("rest"),
    )
    of = F.col("source").eqNullSafe(F.col("_s"))
    group = F.pmod(F.col("key"), F.lit(BLOCKS))

    def placed(rows: DataFrame, epoch: str) -> DataFrame:
        return rows.withColumn("block", _draw(seed, F.lit(1), F.col(epoch), F.col("source"), group)).withColumn("place", _draw(seed, F.lit(2), F.col(epoch), F.col("key")))

    def ends(rows: DataFrame, order: str, rest: str) -> DataFrame:
        """The place on ``order`` where each source's ``rest`` is met, and what is left to take there."""
        here = rows.select(F.col("source").alias("_s"), rest).distinct()
        met = _running(rows, order).join(here, of).where((F.col("below") < F.col(rest)) & (F.col("upto") >= F.col(rest)))
        return written(met.select("_s", F.col(order).alias(f"end_{order}"), (F.col(rest) - F.col("below")).alias(f"{rest}_in_{order}")), "ends")

    # Where does each source's last pass end? First the block, then the part of it, then the place.
    last = placed(small.join(passes.where("rest > 0"), of).drop("_s"), "whole").withColumn("part", F.floor(F.col("place") / F.lit(2**31 // BLOCKS)))
    at_block = ends(last, "block", "rest")
    last = last.join(at_block, of & (F.col("block") == F.col("end_block"))).drop("_s")
    at_part = ends(last, "part", "rest_in_block")
    last = last.join(at_part, of & (F.col("part") == F.col("end_part"))).drop("_s")
    at_place = ends(last, "place", "rest_in_block_in_part")
    cut = passes
    for found, end in ((at_block, "end_block"), (at_place, "end_place")):
        cut = cut.join(found.select(F.col("_s").alias("_f"), end), F.col("_s").eqNullSafe(F.col("_f")), "left").drop("_f")
    cut = written(cut, "cut")
    # Every pass of every document; only the last one is cut.
    used = rows.join(cut, of).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
    used = placed(used, "epoch")
    within = (F.col("block") < F.col("end_block")) | ((F.col("block") == F.col("end_block")) & (F.col("place") <= F.col("end_place")))
    used = used.where((F.col("epoch") < F.col("whole")) | F.coalesce(within, F.lit(False)))
    return used.select("doc_id", "source", "tokens", "epoch", "block", "place", *[F.col(f"_{c}").alias(c) for c in keep or []])
