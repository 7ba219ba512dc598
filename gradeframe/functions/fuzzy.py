"""Token-set ratio.

Set algebra, lengths and bounds are Catalyst expressions. Only the longest
common subsequence of the two *differing* token strings needs a kernel, and
only rows whose result the bounds leave open are sent to it (as Arrow batches);
decided rows pass NULL, because a Python UDF inside ``when`` runs on every row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeframe.functions.text import col, sealed, spaced_words, words


#: Machine words of the longer texts, and rows, from which on pairs are stepped together.
VECTOR_WORDS, VECTOR_ROWS = 64, 64
#: Machine words of the masks of a block; a larger block is halved.
MASKS = 4 << 20


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence (one machine word per 64 characters)."""
    start, end_a, end_b = 0, len(a), len(b)
    while start < end_a and start < end_b and a[start] == b[start]:
        start += 1
    while end_a > start and end_b > start and a[end_a - 1] == b[end_b - 1]:
        end_a -= 1
        end_b -= 1
    affix = start + len(a) - end_a
    a, b = a[start:end_a], b[start:end_b]
    if not a or not b:
        return affix
    reverse = a[::-1]
    where = {ch: int("".join("1" if x == ch else "0" for x in reverse), 2) for ch in set(a) & set(b)}
    full = (1 << len(a)) - 1
    open_rows = full
    for ch in b:
        hit = where.get(ch)
        if hit:
            met = open_rows & hit
            open_rows = ((open_rows + met) | (open_rows - met)) & full
    return affix + len(a) - open_rows.bit_count()


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and the lengths."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), sizes


def _lcs_block(a: list[str], b: list[str], n_words: int) -> np.ndarray:
    """LCS lengths of many pairs stepped together; every ``a`` fits ``n_words`` machine words.

    Rows stand in falling order of ``b``'s length, so the rows that still have
    a character at a step are the first ones.
    """
    chars_a, sizes_a = _code_points(a)
    chars_b, sizes_b = _code_points(b)
    order = np.argsort(-sizes_b, kind="stable")
    # Characters of the first texts are numbered from 1; all others are 0, whose places are none.
    number = np.zeros(int(max(chars_a.max(initial=0), chars_b.max(initial=0))) + 1, np.int64)
    number[chars_a] = 1
    n_chars = int(number.sum()) + 1
    if len(a) > 1 and len(a) * n_chars * n_words > MASKS:
        half = len(a) // 2
        return np.concatenate([_lcs_block(a[:half], b[:half], n_words), _lcs_block(a[half:], b[half:], n_words)])
    number[number > 0] = np.arange(1, n_chars)
    # A mask of the places of each character in each row.
    place = np.arange(len(chars_a)) - np.repeat(np.cumsum(sizes_a) - sizes_a, sizes_a)
    slots = np.repeat(np.arange(len(a)) * n_chars, sizes_a) + number[chars_a]
    masks = np.zeros(len(a) * n_chars * n_words, np.uint64)
    # Every bit is set once, so the sum is the union.
    np.add.at(masks, slots * n_words + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    masks = masks.reshape(-1, n_words)
    found = np.repeat(np.arange(len(a)) * n_chars, sizes_b) + number[chars_b]

    starts = (np.cumsum(sizes_b) - sizes_b)[order]
    left = np.full((n_words, len(a)), ~np.uint64(0))
    active = len(a) - np.searchsorted(np.sort(sizes_b), np.arange(int(sizes_b.max(initial=0))), "right")
    for step, k in enumerate(active.tolist()):
        hits = masks[found[starts[:k] + step]]
        carry = np.uint64(0)
        for w in range(n_words):
            now = left[w, :k]
            hit = now & hits[:, w]
            total = now + hit
            over = total < now
            total += carry
            if w + 1 < n_words:
                carry = (over | (total < carry)).astype(np.uint64)
            left[w, :k] = total | (now ^ hit)
    # Cleared bits are matched characters; bits beyond a's end never clear.
    out = np.zeros(len(a), np.int64)
    out[order] = 64 * n_words - np.bitwise_count(left).sum(0, dtype=np.int64)
    return out


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """LCS lengths of pairs of texts.

    Pairs whose shorter side has up to VECTOR_WORDS * 64 characters are stepped
    together, by the number of machine words; beyond that one pair fills a
    vector by itself, and big integers do the same steps pair by pair.
    """
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b)]
    n_words = -(-np.fromiter(map(len, short), np.int64, len(short)) // 64)
    out = np.zeros(len(short), np.int64)
    for w in np.unique(n_words):
        at = np.flatnonzero(n_words == w)
        if w == 0:
            continue
        pairs = [short[i] for i in at], [long[i] for i in at]
        if w <= VECTOR_WORDS and len(at) >= VECTOR_ROWS:
            out[at] = _lcs_block(*pairs, int(w))
        else:
            out[at] = [lcs_length(x, y) for x, y in zip(*pairs)]
    return out


@F.pandas_udf(T.LongType())
def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    asked = (a.notna() & b.notna()).to_numpy()
    out = pd.Series(pd.array([None] * len(a), "Int64"))
    out[asked] = lcs_lengths(a[asked].tolist(), b[asked].tolist())
    return out


def common_subsequence(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common subsequence of two texts; NULL if one is NULL."""
    return _lcs(col(a), col(b))


def with_token_set_ratio(
    df: DataFrame,
    a: str,
    b: str,
    out: str,
    needed: Column | None = None,
    cutoff: float | tuple[float, float] | None = None,
    spaced: bool = False,
) -> DataFrame:
    """Add ``out``, the token-set ratio (0-100) of text columns ``a`` and ``b``.

    ``needed`` limits the kernel to rows that want the ratio (others get NULL).
    With ``cutoff`` the value is only guaranteed to lie on the right side of it,
    which lets the length bounds settle most rows without the kernel. Of two
    cutoffs, values are exact between them, and on the right side beyond.
    ``spaced`` says that single spaces alone stand between words, as ``normalise``
    leaves them, which spares the search for other white space.
    """
    split = spaced_words if spaced else words
    t = "_tsr_"
    wanted = F.lit(True) if needed is None else F.coalesce(needed, F.lit(False))
    df = df.withColumns({
        f"{t}a": F.when(wanted, F.array_distinct(split(a))),
        f"{t}b": F.when(wanted, F.array_distinct(split(b))),
    })
    ta, tb = F.col(f"{t}a"), F.col(f"{t}b")
    df = df.withColumns({
        f"{t}s": F.length(F.array_join(F.array_intersect(ta, tb), " ")),
        f"{t}x": F.array_join(F.sort_array(F.array_except(ta, tb)), " "),
        f"{t}y": F.array_join(F.sort_array(F.array_except(tb, ta)), " "),
        f"{t}e": (F.size(ta) == 0) | (F.size(tb) == 0),
    })
    shared, x, y, empty = (F.col(t + k) for k in "sxye")
    lx, ly = F.length(x), F.length(y)
    gap = F.when(shared > 0, 1).otherwise(0)
    total = 2 * (shared + gap) + lx + ly

    def similarity(distance: Column, length: Column) -> Column:
        return F.when(length > 0, 100.0 - 100.0 * distance / length).otherwise(100.0)

    by_shared = F.when(
        shared > 0,
        F.greatest(
            similarity(gap + lx, 2 * shared + gap + lx),
            similarity(gap + ly, 2 * shared + gap + ly),
        ),
    ).otherwise(0.0)
    subset = (shared > 0) & ((lx == 0) | (ly == 0))
    df = df.withColumns({
        f"{t}known": F.when(empty, 0.0).when(subset, 100.0),
        f"{t}low": by_shared,
        f"{t}high": F.greatest(similarity(F.abs(lx - ly), total), by_shared),
    })
    known, low, high = F.col(f"{t}known"), F.col(f"{t}low"), F.col(f"{t}high")
    is_open = known.isNull() & (high > low)
    if cutoff is not None:
        least, most = cutoff if isinstance(cutoff, tuple) else (cutoff, cutoff)
        is_open = is_open & (low / 100.0 < most) & (high / 100.0 >= least)
    df = df.withColumn(f"{t}l", _lcs(F.when(is_open, x), F.when(is_open, y)))
    lcs = F.col(f"{t}l")
    by_text = similarity(lx + ly - 2 * lcs, total)
    # Without the kernel: below the least cutoff (high < least) or from the highest on (low >= most);
    # `low` is on the right side in both cases.
    value = F.when(wanted, F.coalesce(known, F.when(lcs.isNotNull(), F.greatest(by_text, low)), low))
    helper = [f"{t}{k}" for k in ("a", "b", "s", "x", "y", "e", "known", "low", "high", "l")]
    return df.withColumn(out, value).drop(*helper)


def token_set_ratio(df: DataFrame, a: str, b: str, out: str = "ratio", spaced: bool = False) -> DataFrame:
    """Exact token-set ratio of two (already normalised) text columns."""
    return sealed(with_token_set_ratio(df, a, b, out, spaced=spaced), **{out: F.col(out)})


__all__ = ["col", "common_subsequence", "lcs_length", "lcs_lengths", "token_set_ratio", "with_token_set_ratio"]
