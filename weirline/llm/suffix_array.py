"""Suffix arrays by induced sorting, and permuted common prefixes, for one shard in numpy.

Suffixes are S (smaller than the next) or L. Leftmost S suffixes (LMS) are sorted
by their substrings, which get names in that order; substrings with equal names
are sorted recursively by the names that follow, twice as many each time. The
order of all other suffixes is induced from them. Induction goes bucket by
bucket, and inside a bucket in batches: all suffixes known so far induce their
neighbours at once, so numpy does the work and each suffix is handled once.

The recursion renames only what is still equal. It induces no second time over
the names: their alphabet is nearly as large as their number, and induction over
it, one by one, took five times as long as all the rest.
"""

from __future__ import annotations

import numpy as np


def kinds(s: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S; s ends in a unique smallest sign."""
    n = len(s)
    out = np.ones(n, dtype=bool)
    if n > 1:
        differs = np.flatnonzero(s[:-1] != s[1:])
        nxt = differs[np.searchsorted(differs, np.arange(n - 1))]
        out[:-1] = s[nxt] < s[nxt + 1]
    return out


def induced(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in the order that follows from the order of the LMS suffixes given."""
    n = len(s)
    counts = np.bincount(s, minlength=size)
    tail = np.cumsum(counts)
    head = tail - counts
    sa = np.full(n, -1, dtype=np.int64)
    narrow = s.astype(np.uint16) if size <= 1 << 16 else s
    by_sign = lms[np.argsort(narrow[lms], kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(s[lms], minlength=size))])

    def spread(batch: np.ndarray, want: bool, at: np.ndarray, step: int) -> None:
        p = batch[batch > 0] - 1
        p = p[small[p] == want]
        if not len(p):
            return
        order = np.argsort(narrow[p], kind="stable")
        p = p[order]
        sign = s[p]
        new = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]]))
        many = np.diff(np.append(new, len(p)))
        rank = np.arange(len(p)) - np.repeat(new, many)
        if step > 0:
            sa[at[sign] + rank] = p
            at[sign[new]] += many
        else:
            sa[at[sign] - 1 - rank] = p
            at[sign[new]] -= many

    used = np.flatnonzero(counts)
    front = head.copy()
    for c in used.tolist():
        done = head[c]
        while done < front[c]:
            batch = sa[done : front[c]]
            done = front[c]
            spread(batch, False, front, 1)
        if first[c + 1] > first[c]:
            spread(by_sign[first[c] : first[c + 1]], False, front, 1)
    back = tail.copy()
    sa[0] = n - 1
    back[0] -= 1
    for c in used[::-1].tolist():
        done = tail[c]
        while done > back[c]:
            batch = sa[back[c] : done][::-1]
            done = back[c]
            spread(batch, True, back, -1)
        if front[c] > head[c]:
            spread(sa[head[c] : front[c]][::-1], True, back, -1)
    return sa


def recursively(name: np.ndarray) -> np.ndarray:
    """Places in order of suffixes of a row of names; names count up from 0 and the last is the only 0.

    A place's name is the number of smaller ones, so that a group of equals can
    be renamed without touching the others.
    """
    size = np.bincount(name)
    name = (np.cumsum(size) - size)[name]
    live, step = np.flatnonzero(np.bincount(name, minlength=len(name))[name] > 1), 1
    while len(live):
        nxt = live + step
        after = np.where(nxt < len(name), name[np.minimum(nxt, len(name) - 1)], 0)
        order = np.argsort(name[live] * np.int64(len(name)) + after, kind="stable")
        live, after = live[order], after[order]
        old = name[live]
        group = np.concatenate([[True], old[1:] != old[:-1]])
        new = group | np.concatenate([[True], after[1:] != after[:-1]])
        at = np.arange(len(live))
        first = np.maximum.accumulate(np.where(group, at, 0))
        name[live] = old + np.maximum.accumulate(np.where(new, at, 0)) - first
        single = new & np.append(new[1:], True)
        live, step = live[~single], 2 * step
    return np.argsort(name, kind="stable")


def _sorted(s: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of s, which ends in its only 0."""
    n = len(s)
    small = kinds(s)
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms)
    if len(lms) > 1:
        rough = induced(s, small, lms, size)
        order = rough[is_lms[rough]]
        # Equal neighbours get one name: same length (up to the next LMS suffix) and same signs.
        nxt = np.full(n, n, dtype=np.int64)
        nxt[lms[:-1]] = lms[1:]
        length = nxt[order] - order + 1
        a, b = order[:-1], order[1:]
        same = (length[:-1] == length[1:]) & (b != n - 1) & (a != n - 1)
        live, k = np.flatnonzero(same), 0
        while len(live):
            equal = s[a[live] + k] == s[b[live] + k]
            same[live[~equal]] = False
            live, k = live[equal], k + 1
            live = live[length[live] > k]
        name = np.concatenate([[0], np.cumsum(~same)])
        if name[-1] + 1 < len(lms):
            of = np.empty(n, dtype=np.int64)
            of[order] = name
            lms = lms[recursively(of[lms])]
        else:
            lms = order
    return induced(s, small, lms, size)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of a row of bytes in order."""
    if not len(text):
        return np.empty(0, dtype=np.int64)
    s = np.append(text.astype(np.int64) + 1, 0)
    used = np.flatnonzero(np.bincount(s))
    rank = np.zeros(int(used[-1]) + 1, dtype=np.int64)
    rank[used] = np.arange(len(used))
    return _sorted(rank[s], len(used))[1:]


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int, separator: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """For each position in text order: the suffix before it in order (-1: none), and their common prefix, up to most.

    Up to most is right within a piece: the first position after each separator is
    compared anew, and most must reach over the longest piece.

    Only positions whose left neighbours differ are compared; along the others
    the prefix shrinks by one from position to position, so prefix plus position
    never falls and a running maximum fills them in.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    has = before >= 0
    start = has & ((at == 0) | (before == 0) | (text[at - 1] != text[before - 1]) | (text[at - 1] == separator))
    padded = np.concatenate([text, np.zeros(most + 16, dtype=np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[: len(padded) - 8].view(np.uint8), (len(padded) - 8, 8), (1, 1))
    prefix = np.zeros(n, dtype=np.int64)
    live = np.flatnonzero(start)
    other, k = before[live], 0
    while len(live) and k < most:
        differ = words[live + k] != words[other + k]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
        room = np.minimum(n - np.maximum(live, other) - k, most - k)
        first = np.minimum(first, np.maximum(room, 0))
        prefix[live] += first
        go = first == 8
        live, other, k = live[go], other[go], k + 8
    total = np.maximum.accumulate(np.where(start, prefix + at, np.where(has, 0, at)))
    return before, np.where(has, np.maximum(total - at, 0), 0)
