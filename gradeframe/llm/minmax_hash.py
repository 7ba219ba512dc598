"""Near-duplicate documents by min-max hashing.

One evaluation of a hash function over a document's shingles gives two
signature values, the least and the greatest, so half as many evaluations fill
a signature. Each value agrees between two documents with a probability equal
to their Jaccard similarity. Bands of values collect candidates; every link is
confirmed on the full shingle sets.

No link is left out: after a bucket's members are compared with its leader, the
buckets whose members are still in different components get further leaders,
and at last an exact prefix join across components. All pairs of a group are
never made: pairs within a component need no check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.llm.components import components
from gradeframe.llm.shared import written
from gradeframe.llm.words import grams, hashes, slices, words_of

#: Hash functions; each fills two values of a signature.
FUNCTIONS = 64
#: Values in a band. A pair at similarity 0.8 misses all 32 bands with probability (1 - 0.8 ** 4) ** 32 = 5e-8.
BAND = 4
#: Rounds in which open buckets get another leader before pairs across components are made.
LEADERS = 3

SIGNED = "doc_id long, k1 long, k2 long, n_shingles long, bands array<long>"


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text after the other, their bounds, and two hashes of the word sequence.

    Texts of 1 to k - 1 words are one shingle.
    """
    found = words_of(column, lower=True)
    h = hashes(found.vocab)[found.codes]
    runs, other = grams(h, k), hashes(found.vocab, 1)[found.codes]
    sets, keys = [], np.zeros((len(column), 2), np.uint64)
    for i, (a, b) in enumerate(zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True)):
        if b - a >= k:
            sets.append(np.unique(runs[a : b - k + 1]))
        else:
            sets.append(grams(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
        if b > a:
            odd = np.arange(1, 2 * (b - a), 2, dtype=np.uint64)
            keys[i] = grams(np.array([(h[a:b] * (odd * odd + odd + np.uint64(7))).sum(), np.uint64(b - a)]), 2)[0], grams(np.array([(other[a:b] * (odd * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))).sum(), np.uint64(b - a)]), 2)[0]
    bounds = np.cumsum([0, *map(len, sets)])
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), bounds, keys


def signatures(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """2 x FUNCTIONS values per set: least and greatest of each function. Sets must not be empty."""
    draw = np.random.default_rng(20240229)
    odd = draw.integers(0, 2**63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(bounds) - 1, 2 * FUNCTIONS), np.uint32)
    for j in range(FUNCTIONS):
        v = flat * odd[j]
        v >>= np.uint64(32)
        v = v.astype(np.uint32)
        out[:, 2 * j] = np.minimum.reduceat(v, bounds[:-1])
        out[:, 2 * j + 1] = np.maximum.reduceat(v, bounds[:-1])
    return out


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 << 20):
            flat, bounds, keys = shingle_sets(batch.column("text"), k)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            n_bands = 2 * FUNCTIONS // BAND
            bands = np.zeros((0, n_bands), np.int64)
            if len(full):
                values = signatures(flat, np.append(bounds[:-1][full], bounds[-1])).astype(np.uint64)
                # A band takes one value from each quarter, so that least and greatest of one function part.
                values = values.reshape(len(full), BAND, n_bands)
                bands = np.stack([_mixed(values[:, :, b], b) for b in range(n_bands)], 1).view(np.int64)
            lists = np.zeros(len(sizes) + 1, np.int32)
            lists[1:] = np.cumsum(np.where(sizes > 0, n_bands, 0))
            keys = keys.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sizes), pa.ListArray.from_arrays(pa.array(lists), pa.array(bands.ravel()))],
                ["doc_id", "k1", "k2", "n_shingles", "bands"],
            )

    return run


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each row of values."""
    out = np.full(len(values), seed + 1, np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    for j in range(values.shape[1]):
        out = (out ^ values[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 << 20):
            flat, bounds, keys = shingle_sets(batch.column("text"), k)
            keys = keys.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int64)))], ["id", "k1", "k2", "shingles"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose full sets are similar enough."""
    fits = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    one = fits.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = one.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("x"), (F.col("na") + F.col("nb")).alias("n"))
    return both.where(100 * F.col("x") >= percent * (F.col("n") - F.col("x"))).select("a", "b")


def _led(members: DataFrame, order: Column) -> DataFrame:
    """Pairs of each bucket's leader, first by ``order``, and its members of other components."""
    leader = members.groupBy("band").agg(F.min(F.struct(order, "id", "n", "root")).alias("l"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    pairs = members.join(leader.select("band", "l"), "band").where(F.col("root") != F.col("l.root"))
    return pairs.select(F.col("id").alias("a"), F.col("l.id").alias("b"), F.col("n").alias("na"), F.col("l.n").alias("nb")).distinct()


def _crossing(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components among the open members that can be similar enough, by an exact prefix join.

    Shingles are put in order, rarest first. Sets as similar as asked share one
    of their first n - ceil(n * percent / 100) + 1 shingles, and the first they
    share leaves room for the overlap they need; only such pairs are made.
    """
    members = rest.select("id", "n", "root").distinct()
    rows = members.join(sets, "id").select("id", "n", "root", F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count("*").alias("f"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("f", "s"))
    prefix = rows.join(often, "s").withColumn("i", place).where((F.col("f") > 1) & (F.col("i") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1))
    prefix = written(prefix.select("s", "id", "n", "root", "i"), "prefix")
    other = prefix.select("s", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("root").alias("other"), F.col("i").alias("j"))
    room = (100 + percent) * (1 + F.least(F.col("n") - F.col("i"), F.col("nb") - F.col("j"))) >= percent * (F.col("n") + F.col("nb"))
    pairs = prefix.join(other, "s").where((F.col("root") < F.col("other")) & room)
    return pairs.select(F.col("id").alias("a"), "b", F.col("n").alias("na"), "nb").distinct()


def _open(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The members of buckets that hold more than one component."""
    if roots is None:
        return members.withColumn("root", F.col("id"))
    rooted = members.join(roots, "id", "left").select("id", "n", "band", F.coalesce("root", "id").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    return written(rooted.join(mixed, "band"), "open")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Texts are split into words ``[^\\x20\\x09-\\x0D]+`` after A-Z is lower-cased.
    Documents with 100 |A & B| >= percent |A | B| are linked; component_id is
    the smallest doc_id reachable. Null and empty texts have no shingles and are
    linked with nothing; texts of fewer than k words are one shingle. Of rows
    that share a doc_id, the text whose word sequence hashes lowest speaks for
    all. A null doc_id is linked with nothing, has a null component_id and is
    kept. Other columns are not read.
    """
    signed = written(docs.select("doc_id", "text").mapInArrow(_signed(k), SIGNED), "signed")
    # Documents with one word sequence are one node, named by the smallest id.
    spoken = signed.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("k")).select("doc_id", "k.k1", "k.k2")
    same = spoken.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"))
    reps = written(signed.join(same, ["k1", "k2"]).where(F.col("doc_id") == F.col("id")).select("id", "k1", "k2", F.col("n_shingles").alias("n"), "bands").dropDuplicates(["id"]), "reps")
    banded = reps.select("id", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("band")
    members = written(banded.join(shared, "band"), "members")
    texts = docs.select("doc_id", "text").join(members.select(F.col("id").alias("doc_id")).distinct(), "doc_id")
    sets = texts.mapInArrow(_sets(k), "id long, k1 long, k2 long, shingles array<long>")
    sets = written(sets.join(reps.select("id", "k1", "k2"), ["id", "k1", "k2"], "left_semi").select("id", "shingles").dropDuplicates(["id"]), "sets")
    links, roots = None, None
    # Leaders by smallest id, then by other orders; pairs across components come last.
    for order in [F.col("id"), *(F.xxhash64("id", F.lit(i)) for i in range(1, LEADERS)), None]:
        rest = _open(members, roots)
        if not rest.take(1):
            break
        found = written(_confirmed(_crossing(rest, sets, percent) if order is None else _led(rest, order.alias("o")), sets, percent), "links")
        if found.take(1):
            links = found if links is None else links.union(found)
            roots = components(links)
    twins = spoken.join(same, ["k1", "k2"]).where(F.col("doc_id") != F.col("id")).select("doc_id", "id")
    named = twins if roots is None else twins.join(roots, "id", "left").select("doc_id", F.coalesce("root", "id").alias("root")).union(roots)
    named = named.toDF("doc_id", "root")
    told = signed.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    own = F.coalesce("root", "doc_id")
    return told.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))
