"""Token counts of a unigram vocabulary without making the tokens.

Aho-Corasick finds every vocabulary piece in a text; dynamic programming keeps
the best score up to each character and the number of pieces on that path.
Nothing else is kept, so neither lattice nor pieces are built.

Tie rules are those of the usual unigram tokenizer: candidates for an end are
met in order of their start, and only a higher score replaces one, so of equal
scores the longest last piece wins; a character that is no piece costs 10 more
than the worst piece and falls back to its UTF-8 bytes.

Texts are cut where every path has a boundary (before a space mark, if no piece
holds one after another character), and each distinct chunk is counted once.
With whole-numbered scores sums are exact, so the cut cannot change a tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gradeframe.llm.words import Remembered, encoded, slices, text_bytes

MARK = "▁"
UNKNOWN_COST = 10.0


class Vocabulary(NamedTuple):
    pieces: ahocorasick.Automaton
    unknown: float
    #: Whether a mark begins every piece it stands in (or follows marks only).
    cuts: bool
    #: The piece that stands for unknown text; its places join runs of unknown characters.
    unknown_piece: str


def pieces_of(model_file: str) -> list[tuple[str, float]]:
    """The pieces and scores of a SentencePiece model file, by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def unknown_of(model_file: str) -> str:
    """The piece of a SentencePiece model file that stands for unknown text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return model.id_to_piece(model.unk_id())


def vocabulary(pieces: list[tuple[str, float]], unknown: str = "") -> Vocabulary:
    """The automaton of ``pieces``; ``unknown`` is the one that stands for unknown text, if any does."""
    automaton = ahocorasick.Automaton()
    for piece, score in pieces:
        if piece:
            automaton.add_word(piece, (len(piece), float(score)))
    automaton.make_automaton()
    whole = all(float(s).is_integer() for _, s in pieces)
    cuts = whole and all(MARK not in p.lstrip(MARK) for p, _ in pieces)
    return Vocabulary(automaton, min(s for _, s in pieces) - UNKNOWN_COST, cuts, unknown)


def count_pieces(text: str, vocabulary: Vocabulary) -> int:
    """Pieces on the best path through ``text``, whose spaces are marks already.

    A run of unknown characters and unknown pieces becomes the bytes of its
    text, unless it is the unknown piece alone, which is one piece.
    """
    n, special = len(text), vocabulary.unknown_piece
    # Score and count up to each character, and how the path ends: 0 known, 1 the unknown piece alone, 2 a longer run.
    best, counts, ends = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    found: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for end, (length, score) in vocabulary.pieces.iter(text):
        found[end].append((length, score))
    for end in range(n):
        top, chosen, single = None, 0, False
        # Longest first, which is the earliest start first.
        for length, score in sorted(found[end], reverse=True):
            value = best[end + 1 - length] + score
            if top is None or value > top:
                top, chosen = value, length
            single = single or length == 1
        unknown = not single and (top is None or best[end] + vocabulary.unknown > top)
        if unknown:
            top, chosen = best[end] + vocabulary.unknown, 1
        start = end + 1 - chosen
        before, count = ends[start], counts[start]
        if not unknown and not (chosen == len(special) and text.startswith(special, start)):
            count, state = count + 1, 0
        elif before == 0 and not unknown:
            count, state = count + 1, 1
        else:
            count += (len(special.encode()) - 1 if before == 1 else 0) + len(text[start : end + 1].encode())
            state = 2
        best[end + 1], counts[end + 1], ends[end + 1] = top, count, state
    return counts[n]


def _chunks(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Texts cut before each mark that follows another character."""
    data, at = text_bytes(column)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
    cut[at] = True
    begins = np.flatnonzero(cut)
    if len(begins) < 2:
        return np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(len(column) + 1, np.int64)
    codes, vocab = encoded(data, begins)
    return codes, vocab, np.searchsorted(begins[:-1], at)


def _count(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = vocabulary(pieces_of(model_file), unknown_of(model_file)), Remembered()
        for batch in slices(batches):
            text = pc.replace_substring(pc.fill_null(batch.column("text"), ""), MARK, " ")
            empty = pc.equal(pc.binary_length(text), 0)
            text = pc.if_else(pc.or_(empty, pc.starts_with(text, " ")), text, pc.binary_join_element_wise(" ", text, ""))
            if words.cuts:
                codes, vocab, bounds = _chunks(text)
            else:
                codes, vocab = np.arange(len(text)), text.cast(pa.binary())
                bounds = np.arange(len(text) + 1)
            each = np.array(known.all_of(vocab.to_pylist(), lambda c: count_pieces(c.decode().replace(" ", MARK), words)), np.int64)
            totals = np.append(0, np.cumsum(each[codes]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(totals[bounds]))], ["doc_id", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs`` (doc_id, text).

    ``model_file`` is a SentencePiece model whose pieces and scores are taken as
    a unigram vocabulary; spaces are marks and a mark is put before a text that
    does not begin with one. Null and empty texts have 0 tokens. Each row gives
    one row, also with a null or repeated doc_id; other columns are not read.
    """
    return docs.select("doc_id", "text").mapInArrow(_count(model_file), "doc_id long, n_tokens long")
