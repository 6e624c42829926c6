"""Suffix arrays of byte strings by induced sorting, in NumPy, and permuted common prefixes.

Suffixes are classified; the leftmost smaller (LMS) substrings are sorted by induction and named; runs of
names of doubling length are sorted recursively until all differ or span ``depth`` characters; the
order of the LMS suffixes then induces that of all suffixes, bucket by bucket. Suffixes are in order
of their first ``depth`` characters; what comes after may break ties either way.
"""

from __future__ import annotations

import numpy as np

from .hashing import mix, span_hashes


def classify(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a string that ends in its one smallest character: which suffixes are smaller than the next one, and
    the LMS positions."""
    n = len(s)
    less = np.zeros(n, bool)
    less[-1] = True
    differ = np.flatnonzero(s[:-1] != s[1:])
    up = s[differ] < s[differ + 1]
    less[:-1] = np.repeat(up, np.diff(np.concatenate(([-1], differ))))
    lms = np.flatnonzero(less[1:] & ~less[:-1]) + 1
    return less, lms


def induce(s: np.ndarray, less: np.ndarray, lms: np.ndarray, width: int) -> np.ndarray:
    """The suffixes in the order that LMS suffixes in the given order induce."""
    n = len(s)
    sizes = np.bincount(s, minlength=width)
    heads = np.cumsum(sizes) - sizes
    tails = np.cumsum(sizes)
    sa = np.full(n, -1, np.int32)
    # LMS suffixes at the ends of their buckets
    chars = s[lms]
    order = np.argsort(chars, kind="stable")
    count = np.bincount(chars, minlength=width)
    lms_start = tails - count
    sa[np.repeat(lms_start, count) + np.arange(len(lms)) - np.repeat(np.cumsum(count) - count, count)] = lms[order]

    def send(rows: np.ndarray, at: np.ndarray, step: int) -> int | None:
        """Put suffixes, in order, at the open ends of their buckets."""
        c = s[rows]
        order = np.argsort(c, kind="stable")
        c = c[order]
        count = np.bincount(c, minlength=width)
        nth = np.arange(len(c)) - np.repeat(np.cumsum(count) - count, count)
        if step > 0:
            sa[at[c] + nth] = rows[order]
            at += count
        else:
            sa[at[c] - 1 - nth] = rows[order]
            at -= count
        return None

    present = np.flatnonzero(sizes)
    ends = heads.copy()
    for c in present.tolist():  # larger suffixes, left to right
        done = heads[c]
        while done < ends[c]:
            i = sa[done : ends[c]]
            done = ends[c]
            j = i[i > 0] - 1
            send(j[~less[j]], ends, 1)
        i = sa[lms_start[c] : tails[c]]
        j = i[i > 0] - 1
        send(j[~less[j]], ends, 1)
    last = tails.copy()
    for c in present[::-1].tolist():  # smaller suffixes, right to left
        done = tails[c]
        while done > last[c]:
            i = sa[last[c] : done][::-1]
            done = last[c]
            j = i[i > 0] - 1
            send(j[less[j]], last, -1)
        i = sa[heads[c] : ends[c]][::-1]
        j = i[i > 0] - 1
        send(j[less[j]], last, -1)
    return sa


def _ranks(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, bool]:
    """Ranks of pairs of ranks, and whether all differ."""
    key = first * (int(second.max(initial=0)) + 2) + second + 1
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate(([0], np.cumsum(k[1:] != k[:-1])))
    out = np.empty(len(key), np.int64)
    out[order] = new
    return out, bool(len(new) == 0 or new[-1] == len(new) - 1)


def _sort_runs(rank: np.ndarray, position: np.ndarray, run: int, depth: int) -> np.ndarray:
    """Ranks of the LMS suffixes from the ranks of runs of ``run`` LMS substrings: runs of twice the length are
    sorted recursively."""
    nxt = np.concatenate((rank[run:], np.full(min(run, len(rank)), -1, np.int64)))
    rank, distinct = _ranks(rank, nxt)
    span = position[2 * run :] - position[: -2 * run] if 2 * run < len(position) else position[:0]
    if distinct or len(span) == 0 or int(span.min()) >= depth:
        return rank
    return _sort_runs(rank, position, 2 * run, depth)


def suffix_array(data: np.ndarray, depth: int = 50) -> np.ndarray:
    """The suffix array of bytes, in order of the first ``depth``. Suffixes that begin with ``depth`` equal bytes or more don't differ
    in these, so a longer run is sorted as one of that length, and its other suffixes follow the first that is left:
    runs take as many steps as the depth at most, whatever their length."""
    if not len(data):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], data[1:] != data[:-1])))
    over = np.maximum(np.diff(np.append(first, len(data))) - depth, 0)
    if not over.any():
        return _sorted(data, depth)
    kept = np.ones(len(data), bool)
    kept[np.repeat(first - (np.cumsum(over) - over), over) + np.arange(over.sum())] = False
    place = np.flatnonzero(kept)
    size = np.ones(len(data), np.int64)
    size[(first + over)[over > 0]] += over[over > 0]
    sa = place[_sorted(data[place], depth)]
    size = size[sa]
    return np.repeat(sa, size) - (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))


def _sorted(data: np.ndarray, depth: int) -> np.ndarray:
    s = np.concatenate((data.astype(np.int16) + 1, np.zeros(1, np.int16)))
    width = 257
    less, lms = classify(s)
    if len(lms) == 0:
        return np.zeros(0, np.int64)
    sa = induce(s, less, lms, width)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    # equal substrings get equal names: told by hash and length, in the order found
    end = np.append(lms[1:] + 1, len(s))
    code = mix(span_hashes(s, lms, end) + (end - lms).astype(np.uint64))
    number = np.empty(len(s), np.int64)
    number[lms] = np.arange(len(lms))
    o = number[ordered]
    rank = np.empty(len(lms), np.int64)
    rank[o] = np.concatenate(([0], np.cumsum(code[o[1:]] != code[o[:-1]])))
    if rank.max() < len(lms) - 1:
        rank = _sort_runs(rank, lms, 1, depth)
    sa = induce(s, less, lms[np.argsort(rank, kind="stable")], width)
    return sa[1:].astype(np.int64)


def permuted_common_prefixes(data: np.ndarray, sa: np.ndarray, depth: int = 50) -> np.ndarray:
    """For each position in text order: whether its suffix and the one before it in the array have ``depth``
    characters in common, compared eight at a time."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    pad = np.concatenate((data, np.zeros(depth + 8, np.uint8)))
    words = np.zeros(n + depth, np.uint64)
    for k in range(8):
        words |= pad[k : k + n + depth].astype(np.uint64) << np.uint64(8 * k)
    i = np.flatnonzero((before >= 0) & (np.arange(n) + depth <= n) & (before + depth <= n))
    for at in [*range(0, depth - 7, 8), depth - 8]:
        i = i[words[i + at] == words[before[i] + at]]
    out = np.zeros(n, bool)
    out[i] = True
    return out
