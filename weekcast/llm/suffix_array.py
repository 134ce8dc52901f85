"""Suffix arrays by induced sorting, in numpy.

Suffixes are classed S or L, the leftmost S ones (LMS) are sorted by their substrings, recursively where
substrings repeat, and all others are induced from them in two linear scans. A scan goes over runs of
whole buckets at a time: what a run induces beyond itself is placed once, what it induces within itself is
settled by repeating the run until nothing moves.
"""

from __future__ import annotations

import numpy as np

#: Suffixes in a run of buckets, about.
RUN = 1 << 13


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last counts as S."""
    n = len(text)
    step = np.sign(np.diff(text))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    ahead = np.minimum.accumulate(at[::-1])[::-1]  # the next position whose symbol changes
    return np.append(np.append(step, 1)[ahead] > 0, True)


def _ranks(sorted_buckets: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal values."""
    if not len(sorted_buckets):
        return np.empty(0, np.int64)
    head = np.flatnonzero(np.r_[True, sorted_buckets[1:] != sorted_buckets[:-1]])
    return np.arange(len(sorted_buckets)) - np.repeat(head, np.diff(np.r_[head, len(sorted_buckets)]))


def _scan(text: np.ndarray, wanted: np.ndarray, sa: np.ndarray, starts: np.ndarray, used: np.ndarray, forward: bool) -> None:
    """Induce all suffixes of the `wanted` type into `sa`; `used` counts the places taken in each bucket."""
    sigma = len(starts) - 1
    bounds = np.unique(np.searchsorted(starts, np.arange(0, starts[-1] + RUN, RUN), side="left").clip(0, sigma))
    bounds = np.unique(np.r_[0, bounds, sigma])
    turns = range(len(bounds) - 1) if forward else range(len(bounds) - 2, -1, -1)
    sign = 1 if forward else -1

    def slots(bucket: np.ndarray) -> np.ndarray:
        return starts[bucket] + used[bucket] if forward else starts[bucket + 1] - 1 - used[bucket]

    for turn in turns:
        low, high = bounds[turn], bounds[turn + 1]
        here = slice(starts[low], starts[high])
        outer = sa[here].copy()
        inner_before = None
        while True:
            seen = sa[here][::sign]
            before = seen[seen > 0] - 1
            before = before[wanted[before]]
            bucket = text[before]
            inside = (bucket >= low) & (bucket < high)
            inner = before[inside]
            if inner_before is not None and np.array_equal(inner, inner_before):
                break
            if not len(inner):
                break
            inner_before = inner
            order = np.argsort(bucket[inside], kind="stable")
            inner, into = inner[order], bucket[inside][order]
            sa[here] = outer
            sa[slots(into) + sign * _ranks(into)] = inner
        far, into = before[~inside], bucket[~inside]
        order = np.argsort(into, kind="stable")
        far, into = far[order], into[order]
        sa[slots(into) + sign * _ranks(into)] = far
        np.add.at(used, into, 1)


def _induce(text: np.ndarray, s_type: np.ndarray, starts: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the LMS ones in (some) order."""
    sa = np.full(len(text), -1, np.int64)
    order = np.argsort(text[lms], kind="stable")
    sorted_lms = lms[order]
    bucket = text[sorted_lms]
    counts = np.bincount(bucket, minlength=len(starts) - 1)
    sa[starts[bucket + 1] - counts[bucket] + _ranks(bucket)] = sorted_lms
    _scan(text, ~s_type, sa, starts, np.zeros(len(starts) - 1, np.int64), True)
    # S suffixes are placed anew, from the ends of their buckets
    sa[(sa >= 0) & s_type[np.maximum(sa, 0)]] = -1
    used = np.zeros(len(starts) - 1, np.int64)
    sa[0], used[text[-1]] = len(text) - 1, 1  # the last suffix is the smallest and nothing induces it
    _scan(text, s_type, sa, starts, used, False)
    return sa


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of `text`: integers from 0, the last one 0 and smaller than all others."""
    text = text.astype(np.int64)
    n = len(text)
    if n <= 1:
        return np.arange(n)
    s_type = _types(text)
    starts = np.concatenate([[0], np.cumsum(np.bincount(text))])
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    by_substring = _induce(text, s_type, starts, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ranked = by_substring[is_lms[by_substring]]
    names = _names(text, lms, ranked)
    if names[-1] + 1 < len(lms):
        reduced = np.empty(n, np.int64)
        reduced[ranked] = names
        ranked = lms[suffix_array(reduced[lms])]
    return _induce(text, s_type, starts, ranked)


def _names(text: np.ndarray, lms: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Equal numbers for equal LMS substrings, ascending in sorted order."""
    length = np.zeros(len(text), np.int64)
    length[lms] = np.diff(np.append(lms, len(text) - 1)) + 1  # up to the next LMS symbol, that included
    left, right = ranked[:-1], ranked[1:]
    differ = length[left] != length[right]
    open_pairs = np.flatnonzero(~differ)
    step = 0
    while len(open_pairs):
        open_pairs = open_pairs[length[left[open_pairs]] > step]
        unequal = text[left[open_pairs] + step] != text[right[open_pairs] + step]
        differ[open_pairs[unequal]] = True
        open_pairs = open_pairs[~unequal]
        step += 1
    return np.concatenate([[0], np.cumsum(differ)])


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one little-endian number; zeros past the end."""
    n = len(data)
    out = np.empty(n, np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    for r in range(8):
        out[r::8] = padded[r : r + (n + 8) // 8 * 8].view("<u8")[: len(out[r::8])]
    return out


def permuted_lcp(data: np.ndarray, sa: np.ndarray, limit: int) -> np.ndarray:
    """For each text position, the bytes its suffix shares with the one before it in suffix order, up to `limit`.

    Kept in text order: the suffix at i + 1 shares at least one byte less than the one at i."""
    before = np.full(len(data), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    eight = lanes(data)
    common = np.zeros(len(data), np.int64)
    at = np.flatnonzero(before >= 0)
    other = before[at]
    done = 0
    while len(at) and done < limit:
        ok = (at + done < len(data)) & (other + done < len(data))
        at, other = at[ok], other[ok]
        x = eight[at + done] ^ eight[other + done]
        low = x & (~x + np.uint64(1))  # the lowest set bit tells how many bytes are equal
        equal = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        common[at] = done + equal
        at, other = at[x == 0], other[x == 0]
        done += 8
    # the padding behind the last byte is no text
    common = np.minimum(common, np.where(before >= 0, len(data) - np.maximum(np.arange(len(data)), before), 0))
    return np.minimum(common, limit)
