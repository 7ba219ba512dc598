"""Hard negatives by Kronecker-packed products.

An anchor is scored against many candidates at once: candidates' components are
biased by the least of their dimension, so that they are not negative, and as
many candidates as fit share one wide integer, each in a field of its own. One
multiplication per component of the anchor adds to all fields, and the fields'
sums, less what the bias added, are the exact scores. Fields are as wide as the
largest sum that the block can have. Words below 2 ** 53 stand in doubles, whose
sums of whole numbers are exact; wider sums use integers of any width.

Scores are not kept: one pass over the anchors' own labels finds positives, a
second one over all other rows the negatives in each positive's band.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.llm.impact_topk import quantised
from gradeframe.llm.shared import written

#: Mean candidates in a block, and mean anchors that meet it together.
BLOCK_VECTORS, BLOCK_ANCHORS = 4096, 2048
#: Anchors whose scores with a block are held at once.
ROWS = 256
#: Bits of a word that doubles hold exactly, and fields of a word wider than that.
EXACT_BITS, WIDE_FIELDS = 53, 16
LEAST = np.iinfo(np.int64).min


class PackedBlock:
    """Candidates' vectors of one length, several to a word, for anchors within ``lows`` and ``highs``."""

    def __init__(self, vectors: np.ndarray, lows: np.ndarray, highs: np.ndarray):
        self.n = len(vectors)
        big = max((abs(int(x)) for side in (vectors, lows, highs) if side.size for x in (side.min(), side.max())), default=0) >= 2**26
        vectors, self.lows, highs = ((x.astype(object) if big else x.astype(np.int64)) for x in (vectors, lows, highs))
        self.bias = vectors.min(0) if self.n else self.lows
        biased = vectors - self.bias
        most = sum(int(c) * int(a) for c, a in zip(biased.max(0) if self.n else [], highs - self.lows))
        self.width = max(most.bit_length(), 1)
        self.exact = not big and self.width <= EXACT_BITS
        self.fields = EXACT_BITS // self.width if self.exact else WIDE_FIELDS
        padded = np.zeros((-(-self.n // self.fields) * self.fields, vectors.shape[1]), biased.dtype if self.exact else object)
        padded[: self.n] = biased
        self.words = sum(padded[f :: self.fields] << (self.width * f) for f in range(self.fields))
        if self.exact:
            self.words = self.words.astype(float)
        # What the two biases add to a field beside the score.
        self.own = vectors @ self.lows
        self.both = self.bias @ self.lows

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products, one row per anchor. Scores beyond 64 bits are an error."""
        anchors = anchors.astype(self.lows.dtype)
        shifted = anchors - self.lows
        if self.exact:
            packed = (shifted.astype(float) @ self.words.T).astype(np.int64)
        else:
            packed = shifted.astype(object) @ self.words.T
        mask = (1 << self.width) - 1
        fields = np.stack([(packed >> (self.width * f)) & mask for f in range(self.fields)], 2).reshape(len(anchors), -1)[:, : self.n]
        return (fields + self.own[None, :] + (anchors @ self.bias)[:, None] - self.both).astype(np.int64)


def best(scores: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Up to ``k`` times: (rows, places) of each row's next highest score, the first of equals; scores of LEAST are none. Changes ``scores``."""
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(1)
        rows = np.flatnonzero(scores[np.arange(len(scores)), at] > LEAST)
        yield rows, at[rows]
        scores[rows, at[rows]] = LEAST


def _blocks(anchors: pd.DataFrame, held: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray]]:
    """(anchors, candidates by id, their scores) for vectors of equal length, ROWS anchors at a time."""
    for width in sorted(set(anchors["v"].map(len)) & set(held["v"].map(len))):
        mine = anchors[anchors["v"].map(len) == width].reset_index(drop=True)
        theirs = held[held["v"].map(len) == width].sort_values(["id", "uid"], ignore_index=True)
        a, c = (np.stack(x["v"].to_list()).astype(np.int64).reshape(len(x), width) for x in (mine, theirs))
        block = PackedBlock(c, a.min(0), a.max(0))
        for i in range(0, len(mine), ROWS):
            yield mine[i : i + ROWS], theirs, block.scores(a[i : i + ROWS])


def _positives(k: int):
    def run(key: tuple, anchors: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 4), np.int64)]
        for mine, theirs, scores in _blocks(anchors, held):
            ids, uids, own = theirs["id"].to_numpy(), theirs["uid"].to_numpy(), mine["id"].to_numpy()
            masked = np.where(ids[None, :] == own[:, None], LEAST, scores)
            out += [np.column_stack([mine["uid"].to_numpy()[r], uids[p], ids[p], scores[r, p]]) for r, p in best(masked, k)]
        return pd.DataFrame(np.concatenate(out), columns=["uid", "positive_uid", "positive_id", "positive_score"])

    return run


def _negatives(k: int, low: int, high: int):
    def run(key: tuple, anchors: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 4), np.int64)]
        for mine, theirs, scores in _blocks(anchors, held):
            other = theirs["label"].to_numpy()[None, :] != mine["label"].to_numpy()[:, None]
            ids, uids = theirs["id"].to_numpy(), mine["uid"].to_numpy()
            met = [[int(s) for s in x] for x in mine["scores"]]
            for slot in range(max(map(len, met), default=0)):
                # low * positive <= 100 * negative <= high * positive in whole numbers; no negative has a score above 2 ** 63.
                floor = np.array([-(-low * s[slot] // 100) if slot < len(s) else 1 for s in met])
                top = np.array([high * s[slot] // 100 if slot < len(s) else 0 for s in met])
                within = np.where(other & (scores >= floor[:, None]) & (scores <= top[:, None]), scores, LEAST)
                out += [np.column_stack([uids[r], np.full(len(r), slot), ids[p], scores[r, p]]) for r, p in best(within, k)]
        return pd.DataFrame(np.concatenate(out), columns=["uid", "slot", "negative_id", "negative_score"])

    return run


def _renewed(*names: str) -> list[Column]:
    """The columns under new ids, so that two tables made from one can be grouped together."""
    return [F.col(n).alias(n) for n in names]


def _numbered(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, levels: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``vectors`` (vec_id, embedding, label).

    An anchor's positives are its ``positives`` best rows of the same label,
    a positive's negatives the ``negatives`` best rows of another label whose
    scores lie between ``low`` and ``high`` percent of the positive's score.
    Scores are inner products of quantised vectors of equal length; ties go to
    the smaller vec_id; rows with the anchor's own vec_id are not its partners.

    Rows with a null vec_id, label or vector, or with null or non-finite
    components, take no part. Equal rows count once; different rows under one
    vec_id are anchors and partners each, with lists of their own. Columns other
    than the three are not read; no rows, or no row with a partner, give no rows.

    Positives are sought within their label only, in as many blocks as the label
    needs, so that no label is held by one task; negatives in blocks of all rows.
    """
    kept = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), quantised(F.col("embedding"), levels).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("q"))
    kept = kept.where("id is not null and label is not null and v is not null").distinct()
    kept = written(kept.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    of = F.xxhash64("uid")

    sizes = kept.groupBy("label").agg(F.ceil(F.count("*") / BLOCK_VECTORS).alias("cols"), F.ceil(F.count_if("q") / BLOCK_ANCHORS).alias("rows")).where("rows > 0")
    labelled = kept.join(sizes, "label")
    asked = labelled.where("q").select(*_renewed("label", "id", "uid", "v"), F.pmod(of, "rows").alias("r"), _numbered(F.col("cols")).alias("c"))
    held = labelled.select("label", "id", "uid", "v", F.pmod(of, "cols").alias("c"), _numbered(F.col("rows")).alias("r"))
    keys = ["label", "r", "c"]
    met = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(_positives(positives), "uid long, positive_uid long, positive_id long, positive_score long")
    place = Window.partitionBy("uid").orderBy(F.desc("positive_score"), "positive_id", "positive_uid")
    met = written(met.withColumn("slot", F.row_number().over(place) - 1).where(F.col("slot") < positives), "positives")

    total = kept.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    rows, cols = F.lit(max(1, -(-total["q"] // BLOCK_ANCHORS))), F.lit(max(1, -(-total["n"] // BLOCK_VECTORS)))
    scores = met.groupBy("uid").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    asked = kept.where("q").join(scores, "uid").select(*_renewed("id", "uid", "label", "v"), "scores", F.pmod(of, rows).alias("r"), _numbered(cols).alias("c"))
    held = kept.select("id", "uid", "label", "v", F.pmod(of, cols).alias("c"), _numbered(rows).alias("r"))
    found = asked.groupBy("r", "c").cogroup(held.groupBy("r", "c")).applyInPandas(_negatives(negatives, low, high), "uid long, slot int, negative_id long, negative_score long")
    place = Window.partitionBy("uid", "slot").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= negatives)
    named = found.join(met, ["uid", "slot"]).join(kept.where("q").select("uid", F.col("id").alias("anchor_id")), "uid")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
