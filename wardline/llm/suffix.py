"""Suffix arrays by induced sorting, and permuted common prefixes, over the text of one shard; NumPy only.

Suffixes are classified (S: smaller than the next one, L: larger), the leftmost smaller ones (LMS) are sorted by sorting
the substrings between them and then, recursively, the string of those substrings' names, and all others are induced
from them in one pass up (L) and one down (S). Each pass goes bucket by bucket: what a bucket holds is read at
once and its left neighbours are dealt to their buckets in order, so the work is linear and done on arrays. Buckets of a string with
many symbols, such as the names of substrings, are too small for that; its passes go suffix by suffix.
"""

from __future__ import annotations

import numpy as np

#: Suffixes for each bucket, on average, from which a pass goes bucket by bucket.
FULL = 32


def _types(t: np.ndarray) -> np.ndarray:
    """True for S-type suffixes; t ends in a unique least symbol."""
    n = len(t)
    step = np.flatnonzero(t[1:] != t[:-1])
    rises = t[step + 1] > t[step]
    s = np.empty(n, bool)
    s[-1] = True
    s[: n - 1] = rises[np.searchsorted(step, np.arange(n - 1))] if len(step) else False
    return s


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array that follows from the order of the LMS suffixes; with unsorted ones, the order of LMS substrings."""
    n = len(t)
    size = np.bincount(t, minlength=sigma)
    stop = np.cumsum(size)
    start = stop - size
    sa = np.zeros(n, np.int32)
    by = t[lms]
    order = np.argsort(by, kind="stable")
    sorted_lms, ends = lms[order], np.cumsum(np.bincount(by, minlength=sigma))

    head, dealt = start.copy(), np.zeros(sigma, np.int64)

    def deal(j: np.ndarray, fronts: np.ndarray, sign: int) -> None:
        c = t[j]
        order = np.argsort(c, kind="stable")
        j, c = j[order], c[order]
        count = np.bincount(c, minlength=sigma)
        rank = np.arange(len(j)) - (np.cumsum(count) - count)[c]
        sa[fronts[c] + sign * rank] = j
        fronts += sign * count

    used = np.flatnonzero(size)
    for c in used:
        low = start[c]
        while low < head[c]:
            batch = sa[low : head[c]]
            low = head[c]
            j = batch[batch > 0] - 1
            j = j[~s[j]]
            if len(j):
                deal(j, head, 1)
        batch = sorted_lms[(ends[c - 1] if c else 0) : ends[c]]
        j = batch[batch > 0] - 1
        j = j[~s[j]]
        if len(j):
            deal(j, head, 1)
    tail = stop - 1
    dealt = head  # L-type suffixes of a bucket end here
    for c in used[::-1]:
        high = stop[c] - 1
        while high > tail[c]:
            batch = sa[tail[c] + 1 : high + 1][::-1]
            high = tail[c]
            j = batch[batch > 0] - 1
            j = j[s[j]]
            if len(j):
                deal(j, tail, -1)
        batch = sa[start[c] : dealt[c]][::-1]
        j = batch[batch > 0] - 1
        j = j[s[j]]
        if len(j):
            deal(j, tail, -1)
    sa[0] = n - 1
    return sa


def _induce_singly(t: np.ndarray, s: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """_induce for a string of many symbols."""
    size = np.bincount(t, minlength=sigma)
    stop = np.cumsum(size)
    head, by = (stop - size).tolist(), t[lms]
    order = np.argsort(by, kind="stable")
    count = np.bincount(by, minlength=sigma)
    n = len(t)
    sa = np.full(n, n, np.int64)
    # the LMS suffixes of a bucket stand at its end, in the order given
    sa[(stop - np.cumsum(count))[by[order]] + np.arange(len(lms))] = lms[order]
    # the symbol to the left of each suffix if that is of one type, else -1; n stands for a place not filled yet
    left = np.concatenate([[-1], t[:-1], [-1]]).astype(np.int64)
    small = np.concatenate([[False], s[:-1], [False]])
    out, large = sa.tolist(), np.where(small, -1, left).tolist()
    for j in out:  # the list is filled while it is read
        c = large[j]
        if c >= 0:
            h = head[c]
            out[h] = j - 1
            head[c] = h + 1
    tail, lesser = stop.tolist(), np.where(small, left, -1).tolist()
    for i in range(n - 1, -1, -1):
        j = out[i]
        c = lesser[j]
        if c >= 0:
            tail[c] = h = tail[c] - 1
            out[h] = j - 1
    out[0] = n - 1
    return np.array(out, np.int32)


def _name(t: np.ndarray, lms_sorted: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in the order given: equal for equal substrings."""
    n = len(t)
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = lms_sorted[:-1].astype(np.int64), lms_sorted[1:].astype(np.int64)
    differ = length[a] != length[b]
    live = np.flatnonzero(~differ)
    k = 0
    while len(live):
        x, y = a[live], b[live]
        ends = length[x]
        unequal = t[np.minimum(x + k, n - 1)] != t[np.minimum(y + k, n - 1)]
        differ[live[unequal]] = True
        k += 1
        live = live[~unequal & (ends > k)]
    return np.concatenate([[0], np.cumsum(differ)])


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers ending in 0, a symbol that is nowhere else."""
    n = len(t)
    if n <= 2:
        return np.arange(n)[::-1].astype(np.int32)
    sigma = int(t.max()) + 1
    induce = _induce if sigma * FULL <= n else _induce_singly
    s = _types(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    sa = induce(t, s, lms, sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    lms_sorted = sa[is_lms[sa]]
    names = _name(t, lms_sorted, lms)
    if names[-1] + 1 < len(lms):
        at = np.empty(n, np.int64)
        at[lms_sorted] = names
        lms_sorted = lms[suffix_array(at[lms])]  # ends in the name of the last symbol, 0 and unique
    return induce(t, s, np.asarray(lms_sorted), sigma)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, fresh: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(plcp, phi): phi[i] is the suffix before i in the suffix array and plcp[i] the length they share, up to `limit`.

    Where the symbols before i and phi[i] are equal, plcp[i] is plcp[i - 1] - 1; only the others, and the positions in
    fresh, are compared, eight symbols at a time. Values that follow from one that reached `limit` are low by as much as
    they lie behind it, so `limit` must exceed twice the span over which they count.
    """
    n = len(t)
    phi = np.zeros(n, np.int64)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(1, n)
    follows = np.zeros(n, bool)
    follows[1:] = (t[i - 1] == t[phi[1:] - 1]) & (phi[1:] > 0) & (phi[:-1] + 1 == phi[1:])
    follows[fresh] = False
    follows[sa[0]] = False
    at = np.flatnonzero(~follows)
    padded = np.concatenate([t.astype(np.uint8), np.zeros(limit + 16, np.uint8)])
    words = np.ndarray((len(padded) - 8,), "<u8", buffer=padded.data, strides=(1,))
    shared = np.zeros(len(at), np.int64)
    live, k = np.arange(len(at)), 0
    while len(live) and k < limit:
        x = words[at[live] + k] ^ words[phi[at[live]] + k]
        end = x != 0
        low = x[end] & (~x[end] + np.uint64(1))
        shared[live[end]] = k + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        live = live[~end]
        k += 8
    shared[live] = limit
    shared[at == sa[0]] = 0
    base = np.maximum.accumulate(np.where(follows, -1, np.arange(n)))
    values = np.zeros(n, np.int64)
    values[at] = shared
    return np.maximum(values[base] - (np.arange(n) - base), 0), phi


def repeated_windows(segments: list[bytes], width: int) -> list[np.ndarray]:
    """For each segment of UTF-8 text, which windows of `width` bytes occur more than once in all segments."""
    lengths = np.array([len(x) for x in segments], np.int64)
    joined = b"\xff".join(segments) + b"\xff"
    raw = np.frombuffer(joined, np.uint8)
    # 0 ends the text, 1 is between segments, bytes of UTF-8 go up to 0xF7
    t = np.concatenate([np.where(raw == 0xFF, 1, raw + np.uint8(2)).astype(np.uint8), np.zeros(1, np.uint8)])
    starts = np.cumsum(lengths + 1) - lengths - 1
    sa = suffix_array(t)
    plcp, phi = permuted_common_prefixes(t, sa, starts, 2 * int(lengths.max(initial=0)) + 8)
    at = np.flatnonzero(plcp >= width)
    twice = np.zeros(len(t), bool)
    twice[at] = True
    twice[phi[at]] = True
    return [twice[a : a + max(0, m - width + 1)].copy() for a, m in zip(starts.tolist(), lengths.tolist(), strict=True)]
