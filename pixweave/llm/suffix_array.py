"""Suffix arrays by induced sorting, and permuted common prefixes.

Suffixes are of type S or L, as they are smaller or larger than their right neighbour. The leftmost S suffixes are
sorted by their substrings: induction from any order of them sorts these, equal substrings get equal names, and the
string of names is sorted in turn by the same function. Two linear passes, L from the left and S from the right, then
induce the order of all suffixes. Over few characters a pass goes by buckets of first characters, whose inductions are
array operations; over many (the strings of names) it goes suffix by suffix.
"""

from __future__ import annotations

import numpy as np

#: Places per character from which a pass works on whole buckets at once.
WIDE = 256


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of the suffixes of an array of integers from 1 up."""
    if len(text) == 0:
        return np.zeros(0, np.int64)
    t = np.append(text.astype(np.int64), 0)
    return _sorted(t, int(t.max()) + 1)[1:]


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the last, the end mark, is."""
    n = len(t)
    differs = np.append(t[:-1] != t[1:], True)
    at = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place whose neighbour differs
    return np.append(t[:-1] < t[1:], True)[at]


def _sorted(t: np.ndarray, sigma: int) -> np.ndarray:
    """The order of the suffixes of a string whose last character is its least and stands nowhere else."""
    small = _types(t)
    lms = np.flatnonzero(small & ~np.concatenate([[True], small[:-1]]))
    if len(t) == 1:
        return np.zeros(1, np.int64)
    names, count = _named(t, sigma, lms)
    order = np.argsort(names) if count == len(lms) else _sorted(names, count)
    return _induced(t, sigma, small, lms[order])


def _named(t: np.ndarray, sigma: int, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """The ranks of the leftmost S substrings, equal ones sharing one, and the number of ranks.

    Substrings are sorted by as many characters as fit a word, those that tie by the next ones, and so on. One that
    has ended counts as greater there: where it ends with an S, a longer one that ties has an L.
    """
    size = np.append(np.diff(lms), 0) + 1
    bits = sigma.bit_length()
    per = 62 // bits
    padded = np.append(t, np.full(per, sigma))
    rank, live, at = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while len(live):
        key = np.zeros(len(live), np.int64)
        for i in range(at, at + per):
            key = key << bits | np.where(i < size[live], padded[np.minimum(lms[live] + i, len(padded) - 1)], sigma)
        by = np.lexsort((key, rank[live])) if at else np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        old = rank[live]
        group = np.append(True, old[1:] != old[:-1])
        part = group | np.append(True, key[1:] != key[:-1])
        places = np.arange(len(live))
        first = np.maximum.accumulate(np.where(part, places, 0))
        rank[live] = old + first - np.maximum.accumulate(np.where(group, places, 0))
        tied = np.append(~part[1:], False) | ~part
        at += per
        live = live[tied & (size[live] >= at)]
    held = np.zeros(len(lms), bool)
    held[rank] = True
    return (np.cumsum(held) - 1)[rank], int(held.sum())


def _induced(t: np.ndarray, sigma: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes in the order that the given order of the leftmost S suffixes induces."""
    return (_by_bucket if len(t) >= WIDE * sigma else _by_suffix)(t, sigma, small, lms)


def _by_suffix(t: np.ndarray, sigma: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    size = np.bincount(t, minlength=sigma)
    end = np.cumsum(size)
    first = np.zeros(len(t), np.int64)
    by = np.argsort(t[lms], kind="stable")
    first[_places(end - np.bincount(t[lms], minlength=sigma), t[lms][by])] = lms[by]
    sa, head, tail = first.tolist(), (end - size).tolist(), end.tolist()
    before = np.append(-1, t[:-1])
    to_l, to_s = (np.where(np.append(False, kind), before, -1).tolist() for kind in (~small[:-1], small[:-1]))
    for at in sa:  # reads what has been put ahead of it
        c = to_l[at]
        if c >= 0:
            place = head[c]
            sa[place] = at - 1
            head[c] = place + 1
    for at in reversed(sa):
        c = to_s[at]
        if c >= 0:
            tail[c] = place = tail[c] - 1
            sa[place] = at - 1
    return np.array(sa, np.int64)


def _by_bucket(t: np.ndarray, sigma: int, small: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n = len(t)
    size = np.bincount(t, minlength=sigma)
    end = np.cumsum(size)
    start = end - size
    sa = np.full(n, -1, np.int64)
    chars = t[lms]
    marks = np.bincount(chars, minlength=sigma)
    by = np.argsort(chars, kind="stable")
    sa[_places(end - marks, chars[by])] = lms[by]
    kind = np.uint16 if sigma <= 1 << 16 else np.int64
    short = t.astype(kind)
    used = [c for c in range(sigma) if size[c]]
    head = start.copy()

    def deal(found: np.ndarray) -> None:
        c = short[found]
        by = np.argsort(c, kind="stable")
        c = t[found[by]]
        sa[_places(head, c)] = found[by]
        np.add.at(head, c, 1) if len(c) < 64 else head.__iadd__(np.bincount(c, minlength=sigma))

    for c in used:
        at = start[c]
        while at < head[c]:  # L suffixes; a run of one character goes on filling its own bucket
            block, at = sa[at : head[c]], head[c]
            before = block[block > 0] - 1
            before = before[t[before] >= c]
            if len(before):
                deal(before)
        block = sa[end[c] - marks[c] : end[c]]
        if len(block) and len(block := block[block > 0]):
            deal(block - 1)
    tail = end.copy()

    def deal_back(found: np.ndarray) -> None:
        c = short[found]
        by = np.argsort(c, kind="stable")
        c = t[found[by]]
        sa[2 * tail[c] - 1 - _places(tail, c)] = found[by]
        np.subtract.at(tail, c, 1) if len(c) < 64 else tail.__isub__(np.bincount(c, minlength=sigma))

    for c in reversed(used):
        at = end[c]
        if c == 0:
            continue
        while at > tail[c]:
            block, at = sa[tail[c] : at][::-1], tail[c]
            before = block[block > 0] - 1
            before = before[(t[before] < c) | (t[before] == c)]
            if len(before):
                deal_back(before)
        block = sa[start[c] : head[c]][::-1]
        before = block[block > 0] - 1
        before = before[t[before] < c]
        if len(before):
            deal_back(before)
    return sa


def _places(first: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """For sorted characters the places first[c], first[c] + 1, ... of each."""
    if not len(chars):
        return np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
    within = np.arange(len(chars)) - np.repeat(new, np.diff(np.append(new, len(chars))))
    return first[chars] + within


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, left: np.ndarray, wide: int = 16) -> np.ndarray:
    """For every place the common prefix with the suffix before it in ``sa``, at most ``left`` (which falls by 1 each place
    up to a mark and starts anew after it).

    Only irreducible places (where the preceding characters differ) are compared; from each the values fall by 1.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    known = before >= 0
    a, b = np.flatnonzero(known), before[known]
    irreducible = np.ones(n, bool)
    chained = (a > 0) & (b > 0)
    irreducible[a[chained]] = (t[a[chained] - 1] != t[b[chained] - 1]) | (left[a[chained] - 1] == 0)
    value = np.zeros(n, np.int64)
    live = np.flatnonzero(irreducible & known & (left > 0))
    padded = np.concatenate([t, np.full(wide, -1, t.dtype), np.full(int(left.max(initial=0)), -2, t.dtype)])
    view = np.lib.stride_tricks.sliding_window_view(padded, wide)
    while len(live):
        at = value[live]
        differ = view[live + at] != view[before[live] + at]
        hit = differ.any(1)
        value[live] = np.minimum(at + np.where(hit, differ.argmax(1), wide), left[live])
        live = live[~hit & (value[live] < left[live])]
    at = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    return np.minimum(np.maximum(value[at] - (np.arange(n) - at), 0), left)
