"""Phrases and their collocation scores by SON partitioning.

Texts are split into pieces and words. Tasks belong to SHARDS shards, and each
shard is mined completely: a phrase that occurs ``support`` times in all texts
occurs at least ``support`` times a shard's share of all bytes in one of the
shards, so the union of the shards' frequent phrases misses none. Their number
is fixed, so that bar stays as it is while texts grow; a shard is spread over
many tasks and mined level by level: words, then pairs of its frequent words,
then longer phrases whose pairs are all frequent, each counted by shard.

The last pass counts the candidates in all texts, in few tasks that merge the
counts of their blocks. Passes know the phrases found
so far by a bitmap of fixed size, which may let others pass but loses none, and
the last one counts by the phrases themselves, so the counts of all frequent
phrases are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import or_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeframe.llm.shared import discard, written
from gradeframe.llm.words import encoded, hashes, slices, text_bytes

#: Words of the longest phrase.
LONGEST = 5
#: Shards of the corpus.
SHARDS = 8
#: Words that a task looks at together, about.
BLOCK_WORDS = 2_000_000
#: Bytes of text that are cut into words at once.
READ_BYTES = 4 << 20
#: Bytes of a batch that Spark passes to a worker, about, if the session sets none.
BATCH_BYTES = 4 << 20
#: Places whose hashes are looked up at once.
HASHED = 1 << 17
#: Bits of the map of candidates; 16 MB, whatever the number of candidates.
BITS = 1 << 27
#: Counts of blocks that a task merges before it passes them on.
HELD_ROWS = 1_000_000
#: Bytes of text that a task of the last pass counts, about, once there is enough for all cores.
TASK_BYTES = 256 << 20
#: Tasks that the phrases of one language are dealt to.
PARTS = 64
ENDS = np.zeros(256, bool)
ENDS[list(b".,;:!?\n\x0b\x0c\r")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MIX = np.uint64(0x9E3779B97F4A7C15)


class Block(NamedTuple):
    """Words one after the other: places in ``vocab``, words left in the piece (from 1 up to LONGEST), places in ``langs``; and bytes of text."""

    codes: np.ndarray
    room: np.ndarray
    lang: np.ndarray
    vocab: pa.Array
    langs: pa.Array
    n_bytes: int


def read(batch: pa.RecordBatch) -> Block:
    """The words of a batch of texts and their languages, A-Z in lower case."""
    data, at = text_bytes(batch.column("text"))
    n_bytes = len(data)
    data = LOWER[data]
    end = ENDS[data]
    solid = ~(end | (data == 32) | (data == 9))
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    firsts = at[:-1][at[:-1] < n_bytes]
    start[firsts] = solid[firsts]
    begins = np.flatnonzero(start).astype(np.int32)
    data = data[solid]
    offsets = np.append(np.flatnonzero(start[solid]), len(data)).astype(np.int32)
    del start, solid
    codes, vocab = encoded(data, offsets)
    del data, offsets
    docs = np.searchsorted(at, begins, "right").astype(np.int32) - np.int32(1)
    # A piece ends where a separator or another text comes before the next word.
    last = np.ones(len(begins), bool)
    last[:-1] = (np.diff(np.searchsorted(np.flatnonzero(end), begins)) > 0) | (np.diff(docs) > 0)
    ends = np.flatnonzero(last)
    room = np.minimum(np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(begins)) + 1, LONGEST).astype(np.uint8)
    langs = batch.column("lang").dictionary_encode()
    return Block(codes.astype(np.int32), room, langs.indices.to_numpy(zero_copy_only=False)[docs].astype(np.int32), vocab, langs.dictionary, n_bytes)


def _joined(parts: list[Block]) -> Block:
    if len(parts) == 1:
        return parts[0]

    def renumbered(codes: list[np.ndarray], names: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
        both = pa.chunked_array(names).combine_chunks().dictionary_encode()
        of, first = both.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum([0, *map(len, names)])
        return np.concatenate([of[a:][c] for a, c in zip(first, codes)]), both.dictionary

    codes, vocab = renumbered([p.codes for p in parts], [p.vocab for p in parts])
    lang, langs = renumbered([p.lang for p in parts], [p.langs for p in parts])
    return Block(codes, np.concatenate([p.room for p in parts]), lang, vocab, langs, sum(p.n_bytes for p in parts))


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_WORDS) -> Iterator[Block]:
    """The rows of a partition in blocks of about ``limit`` words; none is held here once it is passed on."""
    parts, size = [], 0

    def taken() -> Block:
        whole = _joined(parts)
        parts.clear()
        return whole

    for batch in slices(batches, limit=READ_BYTES):
        parts.append(read(batch))
        size += len(parts[-1].codes)
        if size >= limit:
            size = 0
            yield taken()
    if parts:
        yield taken()


def _numbered(key: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each distinct key, the number of each place's key, counts) of keys from 0 up to ``bound``."""
    numbers = np.empty(len(key), np.int32)
    if bound > 4 * len(key):
        order = np.argsort(key).astype(np.int32)
        ranked = key[order]
        first = np.append(True, ranked[1:] != ranked[:-1])
        del ranked
        numbers[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
        begins = np.flatnonzero(first)
        return order[begins], numbers, np.diff(begins, append=len(key))
    used = np.zeros(bound, bool)
    used[key] = True
    number = np.cumsum(used, dtype=np.int32)
    np.subtract(number[key], 1, out=numbers)
    at = np.zeros(number[-1], np.int32)
    at[numbers] = np.arange(len(key), dtype=np.int32)
    return at, numbers, np.bincount(numbers)


def levels(block: Block, last: int, may: Callable[[np.ndarray, int], np.ndarray | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, places, counts) of the block's phrases of up to ``last`` words: each once, by one of its places, if ``may`` (places, words), a mask or None for all, holds for it and for all phrases within it.

    Phrases are told apart by the numbers of their first words and last word,
    not by hashes.
    """
    n = len(block.codes)
    places, key = np.arange(n, dtype=np.int32), block.lang.astype(np.int64)
    key *= len(block.vocab)
    key += block.codes
    bound = len(block.langs) * len(block.vocab)
    for k in range(1, last + 1):
        mask = may(places, k)
        if mask is not None:
            places = places[mask]
            key = key[mask]
        if not len(places):
            return
        at, numbers, counts = _numbered(key, bound)
        yield k, places[at], counts
        if k == last:
            return
        now = np.full(n + 1, -1, np.int32)
        now[places] = numbers
        if k == 1:
            words, n_words = now, np.int64(len(at))
        found = len(at)
        del key, numbers, at, counts
        places = np.flatnonzero((block.room > k) & (now[:-1] >= 0) & (now[1:] >= 0)).astype(np.int32)
        key, bound = now[places].astype(np.int64), found * int(n_words)
        key *= n_words
        key += words[places + k]


class Hasher:
    """Hashes of a block's phrases, the same in all blocks."""

    def __init__(self, block: Block):
        self.block, self.of = block, hashes(block.vocab)
        self.langs = hashes(block.langs.cast(pa.binary()), seed=1)

    def __call__(self, places: np.ndarray, k: int) -> np.ndarray:
        out = self.langs[self.block.lang[places]]
        for j in range(k):
            out *= MIX
            out += self.of[self.block.codes[places + j]]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


def _known(bits: np.ndarray, named: Hasher) -> Callable[[np.ndarray, int], np.ndarray]:
    """Whether the bitmap holds the phrases of ``k`` words at some places."""
    last = np.uint64(len(bits) * 64 - 1)

    def may(places: np.ndarray, k: int) -> np.ndarray:
        held = np.empty(len(places), bool)
        # Hashes take many times the memory of the mask, so few places have theirs at once.
        for i in range(0, len(places), HASHED):
            h = named(places[i : i + HASHED], k) & last
            held[i : i + HASHED] = bits[h >> np.uint64(6)] >> (h & np.uint64(63)) & np.uint64(1)
        return held

    return may


def _mine(first: int, last: int, shared, limit: int):
    """Counts of a task's phrases of ``first`` to ``last`` words by shard; shorter ones are those that ``shared`` knows.

    Beside them stand the bytes of text (no phrase) and, under shard -1, the
    words of all known pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % SHARDS

        def rows(shard: int, phrase: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
            names = pa.nulls(len(n), pa.int64()) if phrase is None else pa.array(phrase.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), names, pa.array(n.astype(np.int64))], ["shard", "phrase", "n"])

        for block in blocks(batches, limit):
            named = Hasher(block)
            known = _known(shared.value, named) if shared else None
            yield rows(shard, None, np.array([block.n_bytes]))
            for k, places, counts in levels(block, last, lambda at, k: known(at, k) if k < first else None):
                if k >= first:
                    yield rows(shard, named(places, k), counts)
                elif k == 2:
                    needed = np.unique(np.concatenate([named(places, 1), named(places + 1, 1)]))
                    yield rows(-1, needed, np.zeros(len(needed)))
            # The next block is read without this one in memory.
            block = named = known = places = counts = None

    return run


def _locally_frequent(docs: DataFrame, support: int, first: int, last: int, known: np.ndarray | None, limit: int, bits: int) -> tuple[np.ndarray, int]:
    """A bitmap of what reaches its shard's bar in some shard, and of the words of known pairs; and the bytes of all texts."""
    shared = None if known is None else docs.sparkSession.sparkContext.broadcast(known)
    mined = docs.mapInArrow(_mine(first, last, shared, limit), "shard int, phrase long, n long")
    by_shard = [F.coalesce(F.sum(F.when(F.col("shard") == i, F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(SHARDS)]
    counts = mined.groupBy("phrase").agg(*by_shard, F.max(F.col("shard") < 0).alias("needed"))
    # All shards' counts are there, so what stays below the support in their sum goes before anything is written.
    enough = sum((F.col(f"n{i}") for i in range(SHARDS)), F.lit(0)) >= support
    local = written(counts.where(F.col("phrase").isNull() | F.col("needed") | enough), "local-counts")
    sizes = [local.where("phrase is null").agg(F.sum(f"n{i}")).first()[0] or 0 for i in range(SHARDS)]
    # The least whole number that is not below the shard's share of the support.
    bars = [max(1, -(-support * size // max(sum(sizes), 1))) for size in sizes]
    frequent = reduce(or_, (F.col(f"n{i}") >= bar for i, bar in enumerate(bars)))
    found = bitmap(local.where(F.col("phrase").isNotNull() & (F.col("needed") | frequent)).select("phrase"), bits)
    discard(local)
    return found, sum(sizes)


def candidates(docs: DataFrame, support: int, block_words: int = BLOCK_WORDS, bits: int = BITS) -> tuple[np.ndarray, int]:
    """A bitmap of the phrases of two words and more that may occur ``support`` times in one language, and of the words within them; and the bytes of all texts."""
    words, n_bytes = _locally_frequent(docs, support, 1, 1, None, block_words, bits)
    pairs, _ = _locally_frequent(docs, support, 2, 2, words, block_words, bits)
    # Known words and pairs in one map: a pair is looked up as a pair only.
    longer, _ = _locally_frequent(docs, support, 3, LONGEST, words | pairs, block_words, bits)
    return pairs | longer, n_bytes


def bitmap(phrases: DataFrame, bits: int = BITS) -> np.ndarray:
    """A bit for each hash; ``bits`` / 8 bytes reach the driver at most."""
    place = F.col("phrase").bitwiseAND(F.lit(bits - 1))
    words = phrases.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast((phrase & {bits - 1}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _block_counts(block: Block, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, words, n) of the phrases of a block that the bitmap holds, and the number of its words."""

    def rows(lang: np.ndarray, phrase: pa.Array, k: int, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([block.langs.take(pa.array(lang)), phrase, pa.array(np.full(len(counts), k, np.int32)), pa.array(counts.astype(np.int64))], ["lang", "phrase", "words", "n"])

    n = np.bincount(block.lang, minlength=len(block.langs))
    yield rows(np.arange(len(n)), pa.array([""] * len(n), pa.string()), 0, n)
    for k, places, counts in levels(block, LONGEST, _known(bits, Hasher(block))):
        parts = [block.vocab.take(pa.array(block.codes[places + j])) for j in range(k)]
        yield rows(block.lang[places], pc.binary_join_element_wise(*parts, b" ").cast(pa.string()), k, counts)


def _count(shared, limit: int):
    def merged(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        # One thread, as each of several would hold the counts in a table of its own.
        whole = pa.Table.from_batches(held).group_by(["lang", "phrase", "words"], use_threads=False).aggregate([("n", "sum")])
        held.clear()
        return whole.select(["lang", "phrase", "words", "n_sum"]).rename_columns(["lang", "phrase", "words", "n"]).to_batches(max_chunksize=100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept, new = [], 0, 0
        for block in blocks(batches, limit):
            made = list(_block_counts(block, shared.value))
            # Counts are merged, and the next block is read, without this one in memory.
            block = None
            held += made
            new += sum(x.num_rows for x in made)
            del made
            # Merged once as many came as are held, so that phrases that came up again take little room; HELD_ROWS in all.
            if new > min(kept, HELD_ROWS - kept):
                full = kept + new > HELD_ROWS
                held = merged(held)
                kept, new = sum(x.num_rows for x in held), 0
                # Only what is still many goes on.
                if full and kept > HELD_ROWS // 2:
                    yield from held
                    held, kept = [], 0
        if held:
            yield from merged(held)

    return run


def gathered(texts: DataFrame, n_bytes: int) -> DataFrame:
    """``texts`` in as many partitions as there are cores, or one for each TASK_BYTES of ``n_bytes`` if these are more; nothing is shuffled.

    Every task counts nearly all candidates once, so tasks that grow in number
    with the texts would make rows with the square of their size.
    """
    return texts.coalesce(max(texts.sparkSession.sparkContext.defaultParallelism, -(-n_bytes // TASK_BYTES)))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Texts go to the workers in batches of BATCH_BYTES: 10,000 rows of them fill buffers of many times this beside the executors' heaps."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(key)


def phrase_counts(docs: DataFrame, support: int, block_words: int = BLOCK_WORDS, bits: int = BITS) -> DataFrame:
    """(lang, phrase, words, n): exact counts of all phrases of two to LONGEST words that occur ``support`` times, and of the words within them; words 0 is the number of all words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null")
    with small_batches(docs.sparkSession):
        found, n_bytes = candidates(texts, support, block_words, bits)
        known = docs.sparkSession.sparkContext.broadcast(found)
        counted = gathered(texts, n_bytes).mapInArrow(_count(known, block_words), "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
        return written(counted.where((F.col("words") == 0) | (F.col("n") >= support)), "phrases")


def _run(first: Column, size: Column) -> Column:
    return F.array_join(F.slice("w", first, size), " ")


def collocations(docs: DataFrame, support: int = 100, top: int = 2000, covered: int = 100, block_words: int = BLOCK_WORDS, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to LONGEST words by collocation score.

    ``docs`` (lang, text): A-Z are lowered, pieces end at ``. , ; : ! ?`` and
    line ends, words at spaces and tabs. Of a phrase that occurs a times in n
    words, cut into parts that occur l and r times, the lowest
    floor(1000 * a * n / (l * r)) counts, the first cut of equals; products are
    decimals of 38 digits. Phrases whose words lie within a longer one with at
    least ``covered`` percent of their occurrences are left out. Ties in score
    go to the larger a, then by the phrase's bytes.

    Null texts are empty; a null language is ``und``; repeated rows count each;
    languages without frequent phrases, and empty tables, give no rows. Other
    columns are not read.
    """
    counts = phrase_counts(docs, support, block_words, bits)
    words = counts.where("words = 0").select("lang", F.col("n").alias("all"))
    phrases = counts.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    cut = F.col("cut")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _run(F.lit(1), cut).alias("left"), _run(cut + 1, F.col("words") - cut).alias("right"))
    for side, n in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.where("words > 0").select("lang", F.col("phrase").alias(side), F.col("n").alias(n)), ["lang", side])
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(all as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    # A language is one key of few; its phrases are dealt to PARTS tasks.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).cast("int")
    words = words.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    scored = cuts.withColumn("part", part).join(words, ["lang", "part"]).withColumn("score", score)
    scored = scored.groupBy("lang", "phrase", "a", F.col("all").alias("n")).agg(F.min(F.struct("score", "cut", "l", "r")).alias("least"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: _run(i, k))))
    longer = phrases.where("words >= 3").select("lang", F.col("a").alias("most"), F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    longer = longer.withColumnsRenamed({"lang": "in_lang", "phrase": "within"})
    stays = scored.join(longer, (F.col("lang") == F.col("in_lang")) & (F.col("phrase") == F.col("within")) & (F.col("most") * 100 >= F.col("a") * covered), "left_anti")
    stays = stays.select("lang", "phrase", "a", "least.l", "least.r", "n", "least.score")
    place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = stays.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
