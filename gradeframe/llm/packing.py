"""Packing of documents into fixed windows by Karmarkar-Karp multiway differencing.

Documents are tokenised and cut into full windows, which stand alone, and a
rest, which is cut into even grains. Grains are dealt to blocks of bounded size by
hash; within a block the differencing method merges partial partitions, the
largest sums of one with the smallest of the other, always the two with the
largest difference between windows. The result is a set of near-equal windows;
if one exceeds the capacity, the number of windows rises.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.llm.shared import written
from gradeframe.llm.words import Remembered, encoded, slices, text_bytes

#: Longest piece of a document's rest; smaller grains balance better, larger ones cut less.
GRAIN = 256
#: Mean number of grains in a block.
BLOCK = 4096
#: The number of windows rises by one part in so many.
RISE = 200

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder(NamedTuple):
    """Ids of a text without added tokens, and the added tokens by their bytes."""

    encode: Callable[[str], list[int]]
    added: dict[bytes, int]


def _added_cuts(data: np.ndarray, at: np.ndarray, added: dict[bytes, int], cut: np.ndarray) -> None:
    """Cut texts around added tokens; a space before one ends the text before it, so it begins no chunk."""
    if not added:
        return
    whole = re.compile(b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)))
    raw = data.tobytes()
    if not whole.search(raw):
        return
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        last = a
        for found in whole.finditer(raw, a, b):
            start, end = found.span()
            if start > last and raw[start - 1] == 32:
                cut[start - 1] = start - 1 == last
            cut[start + 1 : end] = False
            cut[[start, end]] = True
            last = end


def chunks_of(column: pa.Array, added: dict[bytes, int]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Cut texts before each single space that a non-space follows, and around added tokens.

    The tokeniser's pattern ends a match there in any text, so encoding the
    chunks one by one gives the ids of the whole text. The next byte must be
    printable ASCII or begin a letter from U+00C0 to U+07FF; elsewhere the text
    is not cut, which is always safe.
    """
    data, at = text_bytes(column)
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        after = np.append(data[1:], np.uint8(0))
        cut[:-1] = (data == 32) & (((after > 32) & (after < 127)) | ((after > 0xC2) & (after < 0xE0)))
    cut[at] = True
    _added_cuts(data, at, added, cut)
    begins = np.flatnonzero(cut)
    if len(begins) < 2:
        return np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(len(column) + 1, np.int64)
    codes, vocab = encoded(data, begins)
    return codes, vocab, np.searchsorted(begins[:-1], at)


def token_ids(encoder: Encoder, column: pa.Array, known: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and their bounds; ``known`` is a memory of chunks."""
    codes, vocab, bounds = chunks_of(column, encoder.added)

    def ids_of(chunk: bytes) -> bytes:
        return array("I", [encoder.added[chunk]] if chunk in encoder.added else encoder.encode(chunk.decode())).tobytes()

    each = known.all_of(vocab.to_pylist(), ids_of)
    sizes = np.fromiter(map(len, each), np.int64, len(each)) // 4
    flat, starts = np.frombuffer(b"".join(each), np.uint32), np.cumsum(sizes) - sizes
    lengths = sizes[codes]
    ends = np.cumsum(lengths)
    ids = flat[np.repeat(starts[codes] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
    return ids, np.append(0, ends)[bounds]


def encoder(path: str) -> Encoder:
    """Ids of a text by the byte-level BPE of a tokenizer file.

    The file's vocabulary and pattern run in the faster of two libraries; its
    ids number the merges in order, so they serve as ranks. Tests hold the ids
    against the file's own library. Added tokens are taken as they stand in the
    text; files whose added tokens strip spaces or match whole words only are
    refused.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as file:
        tokenizer = json.load(file)
    added = {x["content"]: x["id"] for x in tokenizer.get("added_tokens", [])}
    if tokenizer.get("normalizer") or any(x.get(k) for x in tokenizer.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
        raise ValueError("a normalizer or added tokens that take more than themselves are not supported")
    # The byte alphabet: printable bytes stand for themselves, the others for letters from U+0100 on.
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = (b for b in range(256) if b not in printable)
    of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    if set(of) != set(ByteLevel.alphabet()):
        raise ValueError("the byte alphabet differs")
    ranks = {bytes(of[c] for c in token): rank for token, rank in tokenizer["model"]["vocab"].items() if token not in added}
    encode = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return Encoder(encode, {t.encode(): i for t, i in added.items()})


def _cut(path: str, capacity: int, grain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = encoder(path), Remembered()
        for batch in slices(batches):
            ids, bounds = token_ids(encode, batch.column("text"), known)
            ids = ids.astype("<u4")
            out = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(0)).astype("<u4")
                n = len(own)
                full, rest = n - n % capacity, n % capacity
                parts = -(-rest // grain)
                ends = [*range(capacity, full + 1, capacity), *(full + rest * (i + 1) // parts for i in range(parts))]
                for start, end in zip([0, *ends], ends):
                    out.append((doc, start, end - start, zlib.crc32(own[start:end].tobytes()), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def differenced(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: at most ``k`` near-equal groups of places in ``sizes``.

    A partial partition holds its sums in falling order, zeros left out, and a
    node for each; merging two groups makes a node with two children. Ties are
    broken by the order in which partial partitions were made.
    """
    n = len(sizes)
    heap = [(-s if k > 1 else 0, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made, left, right = n, [], []
    while len(heap) > 1:
        _, _, sums, nodes = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        # Zeros, the smallest of the one, meet the largest of the other; then the next smallest meet the next largest.
        free = k - len(sums)
        over = max(0, len(more) - free)
        stay = len(sums) - over
        if over:
            merged = np.arange(n + len(left), n + len(left) + over)
            left += nodes[stay:][::-1].tolist()
            right += others[free:].tolist()
            sums = np.concatenate([sums[:stay], more[:free], sums[stay:][::-1] + more[free:]])
            nodes = np.concatenate([nodes[:stay], others[:free], merged])
        else:
            sums, nodes = np.append(sums, more), np.append(nodes, others)
        if over or more[0] > sums[stay - 1]:
            order = np.argsort(-sums, kind="stable")
            sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), made, sums, nodes))
        made += 1
    groups = []
    for node in heap[0][3].tolist() if heap else []:
        stack, group = [node], []
        while stack:
            at = stack.pop()
            if at < n:
                group.append(at)
            else:
                stack += [left[at - n], right[at - n]]
        groups.append(group)
    return groups


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of places whose sizes sum to at most ``capacity``, as few as differencing allows.

    Every size must fit the capacity, so at the latest one window per piece does.
    """
    k = -(-sum(sizes) // capacity)
    while True:
        found = differenced(sizes, k)
        if all(sum(sizes[i] for i in g) <= capacity for g in found):
            return found
        k = min(max(k + 1, len(sizes)), k + max(1, k // RISE))


def _pack(capacity: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("uid", ignore_index=True)
        sizes = block["length"].tolist()
        sequence, offset = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
        for w, places in enumerate(windows(sizes, capacity)):
            at = 0
            for i in sorted(places):
                sequence[i], offset[i] = (int(block["block"][0]) << 20) + w, at
                at += sizes[i]
        return block.assign(sequence_id=sequence, offset=offset)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, grain: int = GRAIN) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece of a document.

    A document is the ids of its text by the tokenizer file at path
    ``tokenizer``, then id 0; null and empty texts are that id alone. Each id is
    in one piece; the pieces of a sequence fill it without gaps from offset 0,
    up to ``capacity``. Rows that repeat a document, or have a null doc_id, are
    packed like any other. Other columns are not read; no rows give no rows.
    """
    cut = docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, capacity, grain), PIECES)
    pieces = written(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    rest = pieces.where(F.col("length") < capacity)
    blocks = max(1, round(rest.count() / BLOCK))
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks))).groupBy("block")
    packed = dealt.applyInPandas(_pack(capacity), PIECES + ", sequence_id long, offset long")
    alone = pieces.where(F.col("length") == capacity).withColumn("sequence_id", F.lit(2**62) + F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone.drop("uid"))
