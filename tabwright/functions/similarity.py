"""Similarity of two texts, 0 to 100, for the candidate pairs a join has found.

All scores rest on the longest common subsequence (the "Indel" ratio 200 * LCS / (n + m)). Spark has no
built-in for it, so it is counted in Arrow batches, all pairs of a batch at once; the functions for one pair say what
the batches compute.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

# ship the scorers with the UDF, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence length by the bit-vector recurrence (Hyyro 2004)."""
    if a == b:
        return len(a)
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _share(distance: int, total: int) -> float:
    return 100.0 if total == 0 else 100.0 * (1 - distance / total)


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return _share(total - 2 * lcs_length(a, b), total)


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    sa, sb = set(a.split()), set(b.split())
    if not sa or not sb:
        return 0.0
    common, left, right = sa & sb, sa - sb, sb - sa
    if common and not (left and right):
        return 100.0
    da, db = " ".join(sorted(left)), " ".join(sorted(right))
    base = len(" ".join(common))
    gap = 1 if base else 0
    full_a, full_b = base + gap + len(da), base + gap + len(db)
    best = _share(len(da) + len(db) - 2 * lcs_length(da, db), full_a + full_b)
    if base:
        best = max(best, _share(gap + len(da), base + full_a), _share(gap + len(db), base + full_b))
    return best


def _best_window(short: str, long: str) -> float:
    """Best ratio of ``short`` against the windows of ``long`` up to its length (cut off at both ends)."""
    n, letters, best = len(short), set(short), 0.0
    for end in range(1, len(long) + n):
        window = long[max(0, end - n):min(end, len(long))]
        # the best window starts or ends on a letter of the short text
        if window and (window[-1] in letters or (end >= len(long) and window[0] in letters)):
            best = max(best, ratio(short, window))
            if best == 100.0:
                break
    return best


def partial(a: str, b: str) -> float:
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = _best_window(short, long)
    if best < 100.0 and len(a) == len(b):
        best = max(best, _best_window(long, short))
    return best


SCORERS = {"token_sort": token_sort, "token_set": token_set, "simple": ratio, "partial": partial}


def score_pair(a: str, b: str, method: str) -> int:
    """The better of the method's score and the plain ratio without spaces, as a whole number."""
    best = SCORERS[method](a, b)
    if best < 100.0:
        best = max(best, ratio(a.replace(" ", ""), b.replace(" ", "")))
    return int(best + 0.5)


#: Numbers that one step of a batch holds at most.
STEP = 1 << 23


def _codes(texts: list[str], fill: int, width: int | None = None) -> np.ndarray:
    """Code points as a matrix, a row per text, short rows filled up."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    made = np.full((len(texts), width or int(sizes.max(initial=0))), fill, dtype=np.int32)
    made[np.arange(made.shape[1])[None, :] < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<i4")
    return made


def _lcs_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common subsequence lengths of the rows of two matrices of codes: the bit-vector recurrence for all rows at
    once, each row's vector in as many 64-bit words as ``a`` needs. Fillers of the two never agree."""
    rows, octets = len(a), -(-a.shape[1] // 8)
    words = -(-octets // 8)
    state = np.full((words, rows), ~np.uint64(0))
    if max(a.max(initial=0), b.max(initial=0)) < 254:          # fillers become 255 and 254
        a, b = a.astype(np.uint8), b.astype(np.uint8)
    full = np.full((rows, 8 * octets), -1).astype(a.dtype)
    full[:, :a.shape[1]] = a
    hits = np.zeros((rows, b.shape[1], words * 8), dtype=np.uint8)
    hits[:, :, :octets] = np.packbits(full[:, None, :] == b[:, :, None], bitorder="little").reshape(rows, b.shape[1], octets)
    masks = np.ascontiguousarray(hits.view("<u8").transpose(1, 2, 0))
    for mask in masks:
        carry = np.zeros(rows, dtype=bool)
        for w in range(words):
            row = state[w]
            hit = row & mask[w]
            added = row + hit
            over = added < row
            if words > 1:
                added += carry
                over |= carry & (added == 0)
            state[w] = added | (row ^ hit)
            carry = over
    return 64 * words - np.bitwise_count(state).sum(axis=0, dtype=np.int64)


def lcs_lengths(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Longest common subsequence lengths of many pairs; pairs of like lengths are worked on together."""
    short = [x if len(x) <= len(y) else y for x, y in zip(left, right)]
    long = [y if len(x) <= len(y) else x for x, y in zip(left, right)]
    n, m = (np.fromiter(map(len, some), np.int64, len(some)) for some in (short, long))
    found = np.zeros(len(n), dtype=np.int64)
    order = np.lexsort((m, -(-n // 8)))
    order = order[n[order] > 0]
    at = 0
    while at < len(order):
        # as many pairs as fit into a step, none more than half as long again as the first
        size = max(1, STEP // int(n[order[at]] * m[order[at]] + 1))
        some = order[at:at + size]
        alike = np.flatnonzero((-(-n[some] // 8) != -(-n[some[0]] // 8)) | (m[some] > m[some[0]] + m[some[0]] // 2 + 4))
        some = some[:alike[0]] if len(alike) else some
        found[some] = _lcs_rows(_codes([short[i] for i in some], -1), _codes([long[i] for i in some], -2))
        at += len(some)
    return found


def window_ratios(short: Sequence[str], long: Sequence[str]) -> np.ndarray:
    """Best ratio of each short text against all windows of its length over the long one, cut off at both ends.

    Texts of one length go together: the long ones are laid end to end with fillers between them, and every window of that strip
    that touches a text is a row of a batch."""
    n = np.fromiter(map(len, short), np.int64, len(short))
    best = np.zeros(len(n))
    for width in np.unique(n[n > 0]).tolist():
        some = np.flatnonzero(n == width)
        sizes = np.fromiter((len(long[i]) for i in some), np.int64, len(some))
        at_once = max(1, STEP // (width * width * int(sizes.max() + width)))
        for these in np.split(some, range(at_once, len(some), at_once)):
            m = np.fromiter((len(long[i]) for i in these), np.int64, len(these))
            padded = [("\0" * (width - 1)) + long[i] + ("\0" * (width - 1)) for i in these]
            strip = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<i4").copy()
            begins = np.cumsum(m + 2 * (width - 1)) - (m + 2 * (width - 1))
            counts = m + width - 1
            pair = np.repeat(np.arange(len(these)), counts)
            start = np.arange(len(pair)) - np.repeat(np.cumsum(counts) - counts, counts)
            place = np.arange(len(strip)) - np.repeat(begins, m + 2 * (width - 1))
            strip[(place < width - 1) | (place >= np.repeat(m, m + 2 * (width - 1)) + width - 1)] = -2
            windows = np.lib.stride_tricks.sliding_window_view(strip, width)
            texts = _codes([short[i] for i in these], -1)
            common = np.zeros(len(pair), dtype=np.int64)
            step = max(1, STEP // (width * width))
            for at in range(0, len(pair), step):
                rows = slice(at, at + step)
                common[rows] = _lcs_rows(texts[pair[rows]], windows[begins[pair[rows]] + start[rows]])
            length = np.minimum(start + 1, m[pair]) - np.maximum(0, start + 1 - width)
            total = width + length
            np.maximum.at(best, these[pair], 100.0 * (1 - (total - 2 * common) / total))
    return best


def ratios(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """The ratio of each pair."""
    total = np.fromiter((len(x) + len(y) for x, y in zip(left, right)), np.int64, len(left))
    return np.where(total > 0, 100.0 * (1 - (total - 2 * lcs_lengths(left, right)) / np.maximum(total, 1)), 100.0)


def set_ratios(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """The word-set score of each pair: what the words leave over is compared in one batch."""
    sets = [(set(x.split()), set(y.split())) for x, y in zip(left, right)]
    rest = [(" ".join(sorted(x - y)), " ".join(sorted(y - x))) for x, y in sets]
    base, na, nb = (np.array(n, dtype=np.int64) for n in (
        [len(" ".join(x & y)) for x, y in sets], [len(x) for x, _ in rest], [len(y) for _, y in rest]))
    gap = (base > 0).astype(np.int64)
    full = 2 * (base + gap) + na + nb
    best = 100.0 * (1 - (na + nb - 2 * lcs_lengths([x for x, _ in rest], [y for _, y in rest])) / np.maximum(full, 1))
    for n in (na, nb):
        best = np.where(base > 0, np.maximum(best, 100.0 * (1 - (gap + n) / np.maximum(2 * base + gap + n, 1))), best)
    best[(base > 0) & ((na == 0) | (nb == 0))] = 100.0
    best[[i for i, (x, y) in enumerate(sets) if not x or not y]] = 0.0
    return best


def partial_ratios(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    short = [x if len(x) <= len(y) else y for x, y in zip(left, right)]
    long = [y if len(x) <= len(y) else x for x, y in zip(left, right)]
    best = window_ratios(short, long)
    twice = [i for i, (x, y) in enumerate(zip(short, long)) if len(x) == len(y) and best[i] < 100]
    best[twice] = np.maximum(best[twice], window_ratios([long[i] for i in twice], [short[i] for i in twice]))
    best[[i for i, (x, y) in enumerate(zip(short, long)) if x == y]] = 100.0
    return best


def _lcs(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(lcs_lengths(left.tolist(), right.tolist()).astype("int32"))
    return of(a, b)


def _partial(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(partial_ratios(left.tolist(), right.tolist()))
    return of(a, b)


def _share_of(distance: Column, total: Column) -> Column:
    return F.when(total == 0, 100.0).otherwise(100.0 * (1 - distance / total))


def _ratio_of(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(a == b, 100.0).otherwise(_share_of(total - 2 * _lcs(a, b), total))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def _token_set_of(a: Column, b: Column) -> Column:
    sa, sb = F.array_distinct(_words(a)), F.array_distinct(_words(b))
    common, left, right = F.array_intersect(sa, sb), F.array_except(sa, sb), F.array_except(sb, sa)
    da, db = F.array_join(F.sort_array(left), " "), F.array_join(F.sort_array(right), " ")
    base, na, nb = F.length(F.array_join(common, " ")), F.length(da), F.length(db)
    gap = (base > 0).cast("int")
    rest = _share_of(na + nb - 2 * _lcs(da, db), 2 * (base + gap) + na + nb)
    parts = F.greatest(rest, _share_of(gap + na, 2 * base + gap + na), _share_of(gap + nb, 2 * base + gap + nb))
    return (F.when((F.size(sa) == 0) | (F.size(sb) == 0), 0.0)
            .when((F.size(common) > 0) & ((F.size(left) == 0) | (F.size(right) == 0)), 100.0)
            .when(base > 0, parts).otherwise(rest))


def similarity(a: Column, b: Column, method: str = "token_sort", compact: bool = True) -> Column:
    """Similarity of two cleaned texts. ``compact`` also tries both texts without their spaces.

    Words are sorted and compared by built-in functions; only the subsequence lengths come from Python, a
    whole Arrow batch at a time.
    """
    if method == "token_sort":
        best = _ratio_of(*[F.array_join(F.sort_array(_words(c)), " ") for c in (a, b)])
    elif method == "token_set":
        best = _token_set_of(a, b)
    elif method == "simple":
        best = _ratio_of(a, b)
    elif method == "partial":
        best = _partial(a, b)
    else:
        raise ValueError(f"method must be one of {C.METHODS}, not {method!r}")
    if compact:
        best = F.greatest(best, _ratio_of(*[F.replace(c, F.lit(" "), F.lit("")) for c in (a, b)]))
    return F.floor(best + 0.5).cast("int")
