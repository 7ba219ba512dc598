"""Exact top-k by inner product on an impact-ordered index, score at a time.

Vectors are quantised to whole numbers. Per block and dimension the index lists
postings by falling impact, cut into segments of equal impact. A query visits
segments by falling contribution (its component times the impact) and adds them
to accumulators. After each batch of segments the best score that unvisited
segments can still add is known; a vector whose accumulator plus that bound is
below the k-th best accumulator cannot be a result. Once few vectors are left,
they are scored exactly; without that proof all segments are visited.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.llm.shared import written

#: Mean vectors in an index block, and mean queries that visit it together.
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 2048
#: Shares of a block's postings after which a proof is tried.
STOPS = (0.35, 0.55, 0.75, 0.9)
#: Share of a block's members few enough to be rescored.
SHARE = 0.1


def quantised(vector: Column, levels: int = 256) -> Column:
    """floor(levels * x) of each component; null for vectors that take no part."""
    bad = vector.isNull() | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * levels).cast("long")))


class ImpactIndex:
    """Postings of a block of vectors, ordered by impact within each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, vectors = ids[order], vectors[order]
        # Doubles hold whole numbers below 2 ** 53, so their sums are exact where no score can be larger.
        most = float(np.abs(vectors.astype(float)).max(initial=0))
        self.vectors = vectors.astype(float) if most * most * max(vectors.shape[1], 1) < 2**52 else vectors
        self.postings = np.argsort(-vectors, axis=0, kind="stable").T.copy()
        self.impacts = np.take_along_axis(self.vectors.T, self.postings, 1)
        new = np.ones(self.impacts.shape, bool)
        new[:, 1:] = self.impacts[:, 1:] != self.impacts[:, :-1]
        self.dims, first = np.nonzero(new)
        self.segments = self.impacts[self.dims, first]
        self.sizes = np.diff(np.append(np.flatnonzero(new), new.size))

    def top(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best vectors other than ``own``; ties to the smaller id."""
        query, n = query.astype(self.vectors.dtype), len(self.ids)
        mine = self.ids != own
        members = np.flatnonzero(mine)
        lowest = np.minimum(query * self.impacts[:, 0], query * self.impacts[:, -1])
        gains = query[self.dims] * self.segments - lowest[self.dims]  # not negative, so an accumulator is a lower bound
        order = np.argsort(-gains)
        visited = np.cumsum(self.sizes[order])
        done, at = np.zeros(len(query), np.int64), 0
        found, met = np.zeros(n), np.zeros(n)
        for stop in STOPS if len(query) and len(members) > k else ():
            to = int(np.searchsorted(visited, stop * visited[-1]))
            part = order[at:to]
            # Within a dimension contributions fall along the list, or rise if the component is negative: segments join to one run.
            upto = done + np.bincount(self.dims[part], self.sizes[part], len(query)).astype(np.int64)
            runs = [(d, slice(a, b) if query[d] > 0 else slice(n - b, n - a)) for d, (a, b) in enumerate(zip(done.tolist(), upto.tolist(), strict=True)) if query[d] and a < b]
            done, at = upto, to
            if not runs:
                continue
            places = np.concatenate([self.postings[d, run] for d, run in runs])
            found += np.bincount(places, np.concatenate([query[d] * self.impacts[d, run] - lowest[d] for d, run in runs]), n)
            met += np.bincount(places, minlength=n)
            kth = np.partition(found[mine], len(members) - k)[len(members) - k]
            # Each dimension in which a vector was not met yet adds at most the next segment's contribution.
            next_gain = float(gains[order[to]]) if to < len(order) else 0.0
            possible = np.flatnonzero(mine & (found + (np.count_nonzero(query) - met) * next_gain >= kth))
            if len(possible) <= max(k, n * SHARE):
                members = possible
                break
        scores = self.vectors[members] @ query
        best = np.lexsort((self.ids[members], -scores))[:k]
        return scores[best].astype(np.int64), self.ids[members][best]


def _search(k: int):
    def run(key: tuple, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(vectors) and len(queries):
            for width in sorted({len(v) for v in vectors["v"]}):
                same = vectors[vectors["v"].map(len) == width]
                index = ImpactIndex(same["id"].to_numpy(np.int64), np.stack(same["v"].to_list()).reshape(len(same), width).astype(np.int64))
                for own, v in zip(queries["id"], queries["v"], strict=True):
                    if len(v) == width:
                        scores, ids = index.top(np.asarray(v, np.int64), k, own)
                        out += [(own, int(i), int(s)) for s, i in zip(scores, ids, strict=True)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(np.int64)

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, levels: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` (vec_id, embedding) for each row that ``is_query`` holds for.

    Scores are inner products of quantised vectors of equal length; ties go to
    the smaller vec_id; rows with the query's own vec_id are not its results.
    Vectors that are null or hold null or non-finite components, and rows with
    a null vec_id, take no part; empty vectors score 0 with each other. Equal
    rows count once; different vectors under one vec_id are candidates each,
    and their results share one ranking. Queries and vectors meet in blocks of
    bounded size; no task sees more than a block of either.
    """
    kept = vectors.select(F.col("vec_id").alias("id"), quantised(F.col("embedding"), levels).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("id is not null and v is not null").distinct()
    kept = written(kept.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    sizes = kept.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    rows, cols = max(1, -(-sizes["q"] // BLOCK_QUERIES)), max(1, -(-sizes["n"] // BLOCK_VECTORS))
    of = F.xxhash64("uid")
    asked = kept.where("q").select("id", "v", F.pmod(of, F.lit(rows)).alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cols - 1).cast("long"))).alias("c"))
    held = kept.select("id", "v", F.pmod(of, F.lit(cols)).alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("r"))
    found = asked.groupBy("r", "c").cogroup(held.groupBy("r", "c")).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
