"""Removal of repeated word windows by de Bruijn path compaction.

An edge of the graph is a window of ``k`` consecutive words; its two nodes are
the runs of ``k - 1`` words at its ends. Only repeated edges are built:

1. Exact copies step aside: their first document stands for them.
2. Every window is assigned to the least hash of its ``ANCHOR``-word runs, so
   equal windows share that anchor. Anchors that occur in one document only
   settle their windows; about one row per five words is shuffled for this.
3. The windows of shared anchors become edges. An edge is named by its source
   coordinate, the first (document, place) where it occurs.
4. Occurrences of an edge in later documents join their source coordinates.
   Consecutive occurrences on consecutive coordinates follow one nonbranching
   path and compact to one span (document, start, edges, source, source start);
   a path ends where the source changes, that is at a branch.

Windows are told apart by 96 bits of hash; copies by the SHA-256 of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeframe.llm.shared import discard, written
from gradeframe.llm.words import grams, hashes, slices, whole_runs, words_of

#: Words of an anchor run. Shorter ones are shared by chance, longer ones are sparser picks.
ANCHOR = 4


def _anchor_of_windows(h: np.ndarray, k: int) -> np.ndarray:
    """The least anchor hash within each window of ``k`` words."""
    g = grams(h, ANCHOR)
    least, width, span = g, 1, k - ANCHOR + 1
    while 2 * width <= span:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = span - width
    return (np.minimum(least[:-rest], least[rest:]) if rest else least).view(np.int64)


def _anchors(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = words_of(batch.column("text"))
            at, row = whole_runs(found.bounds, k)
            key = np.zeros(0, np.int64)
            if len(at):
                key = _anchor_of_windows(hashes(found.vocab)[found.codes], k)[at]
                new = np.append(True, (key[1:] != key[:-1]) | (row[1:] != row[:-1]))
                key, row = key[new], row[new]
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sha"), pa.ListArray.from_arrays(ends, pa.array(key))], ["doc_id", "sha", "anchors"])

    return run


def _edges(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = words_of(batch.column("text"))
            at, row = whole_runs(found.bounds, k)
            if not len(at):
                continue
            h = hashes(found.vocab)[found.codes]
            key = _anchor_of_windows(h, k)[at]
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            mine = np.zeros(len(at), bool)
            for i, shared in enumerate(batch.column("anchors")):
                part = slice(ends[i], ends[i + 1])
                mine[part] = np.isin(key[part], shared.values.to_numpy(zero_copy_only=False))
            at, row = at[mine], row[mine]
            ids, variants = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "variant"))
            second = (grams(hashes(found.vocab, 1)[found.codes], k)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[row]), pa.array(at - found.bounds[row] + (variants[row] << 32)), pa.array(grams(h, k)[at].view(np.int64)), pa.array(second)],
                ["doc_id", "pos", "h1", "h2"],
            )

    return run


def _kept(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, digests = [], [], []
            for text, copy, spans in zip(*(batch.column(c) for c in ("text", "is_copy", "spans")), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = np.zeros(len(words), bool)
                if copy.as_py() and len(words) >= k:
                    gone[:] = True
                elif spans.is_valid:
                    for start, edges in zip(*(f.to_numpy(zero_copy_only=False) for f in spans.values.flatten()), strict=True):
                        gone[start : start + edges + k - 1] = True
                left = [w for w, out in zip(words, gone.tolist(), strict=True) if not out] if gone.any() else words
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _base(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))


def _seen(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Written tables of documents with an id: (doc_id, sha, anchors) by row, and (doc_id, sha, variant, is_copy).

    ``is_copy`` says whether a smaller doc_id has the same text. ``variant``
    numbers the texts of one doc_id, from 0; it stands in the upper half of a
    place, so that texts under one doc_id are told apart.
    """
    rows = _base(docs.where("doc_id is not null")).mapInArrow(_anchors(k), "doc_id long, sha string, anchors array<long>")
    rows = written(rows, "anchors")
    seen = rows.select("doc_id", "sha").distinct()
    seen = seen.withColumn("variant", (F.row_number().over(Window.partitionBy("doc_id").orderBy("sha")) - 1).cast("long"))
    first = seen.groupBy("sha").agg(F.min("doc_id").alias("first_id"))
    copies = seen.join(first, "sha").select("doc_id", "sha", "variant", (F.col("doc_id") > F.col("first_id")).alias("is_copy"))
    return rows, written(copies, "copies")


def repeated_spans(docs: DataFrame, k: int = 13) -> DataFrame:
    """Spans of documents that are no exact copies: (doc_id, variant, start, edges, source_id, source_start).

    A span covers the words start to start + edges + k - 2; each of its windows
    also starts in document source_id < doc_id, from word source_start on.
    Texts of fewer than k words, null and empty texts and null ids have none.
    """
    return _spans(docs, k, *_seen(docs, k))


def _spans(docs: DataFrame, k: int, rows: DataFrame, copies: DataFrame) -> DataFrame:
    """The spans, from the tables of ``_seen``; ``rows`` is deleted."""
    originals = copies.where("not is_copy").select("doc_id", "sha", "variant")
    anchors = rows.join(originals, ["doc_id", "sha"]).select("doc_id", F.explode("anchors").alias("anchor"))
    ends = anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    mine = written(anchors.join(ends.select("anchor"), "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "shared-anchors")
    discard(rows)
    texts = _base(docs).join(originals.join(mine, "doc_id"), ["doc_id", "sha"]).select("doc_id", "text", "variant", "anchors")
    edges = written(texts.mapInArrow(_edges(k), "doc_id long, pos long, h1 long, h2 int"), "edges")
    discard(mine)
    source = edges.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("s"), F.max("doc_id").alias("hi")).where("s.doc_id < hi")
    # Written, so that the edges shuffled to find sources are gone before they are shuffled to meet them.
    source = written(source.select("h1", "h2", F.col("s.doc_id").alias("source_id"), F.col("s.pos").alias("source_pos")), "sources")
    later = edges.join(source, ["h1", "h2"]).where("source_id < doc_id").select("doc_id", "pos", "source_id", "source_pos").repartition("doc_id").distinct()
    # Runs of consecutive places on consecutive coordinates: gaps and islands within a document.
    path = Window.partitionBy("doc_id").orderBy("pos", "source_id", "source_pos")
    same = (F.lag("source_id").over(path) == F.col("source_id")) & (F.lag("pos").over(path) == F.col("pos") - 1) & (F.lag("source_pos").over(path) == F.col("source_pos") - 1)
    steps = later.withColumn("begins", F.when(same, 0).otherwise(1)).withColumn("span", F.sum("begins").over(path))
    spans = steps.groupBy("doc_id", "span").agg(
        F.min("pos").alias("pos"), F.count("*").cast("int").alias("edges"), F.min(F.struct("source_id", "source_pos")).alias("s"),
    )
    place = (2**32) - 1
    spans = written(spans.select(
        "doc_id", F.shiftright("pos", 32).alias("variant"), F.col("pos").bitwiseAND(place).alias("start"), "edges",
        F.col("s.source_id").alias("source_id"), F.col("s.source_pos").bitwiseAND(place).alias("source_start"),
    ), "spans")
    discard(edges, source)
    return spans


def remove_repeats(docs: DataFrame, k: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs`` (doc_id, text).

    A word goes when a window of ``k`` words that covers it also starts in a
    document with a smaller doc_id. Null text has no words; a row with a null
    doc_id keeps all its words and is no source; rows that share a doc_id each
    give a row, judged against smaller ids only. Other columns are not read.
    """
    rows, copies = _seen(docs, k)
    spans = _spans(docs, k, rows, copies).groupBy("doc_id", "variant").agg(F.collect_list(F.struct("start", "edges")).alias("spans"))
    told = copies.join(spans, ["doc_id", "variant"], "left")
    return _base(docs).join(told, ["doc_id", "sha"], "left").select("doc_id", "text", "is_copy", "spans").mapInArrow(
        _kept(k), "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )
