"""Suffix arrays by induced sorting, a bucket at a time, and permuted common prefixes.

Induced sorting orders the suffixes of a text in linear time once its leftmost
smaller (LMS) suffixes are ordered: each bucket of suffixes with the same first
byte is read in order, and the suffixes one byte longer are appended to their
buckets.  Here a whole bucket is read at once, and again for what it appends to
itself, so the work is a few array operations for each bucket and each step of
its longest run of equal bytes.

The LMS suffixes are ordered the same way at first, by their substrings up to the
next LMS position; substrings get names in that order, and the string of names, which
is at most half as long, is sorted in turn, and so on until all names differ.  Strings of
names have about as many letters as places, so their buckets hold a suffix or two.  There
the suffixes of one type are induced all at once: a suffix is ordered by its first
letter and the next suffix, down to one of the other type, whose order is known.  These
chains are short; where they tie, the next suffix of the next suffix decides, twice as
far each time.
"""

from __future__ import annotations

import numpy as np


def _push(lists: list[list[np.ndarray]], at: np.ndarray, first: np.ndarray) -> None:
    """Append positions to the lists of their first bytes, in the order given."""
    if len(at):
        order = np.argsort(first, kind="stable")
        at, first = at[order], first[order]
        cut = [0, *(np.flatnonzero(first[1:] != first[:-1]) + 1).tolist(), len(at)]
        for a, b in zip(cut, cut[1:], strict=False):
            lists[first[a]].append(at[a:b])


def _scan(s: np.ndarray, lists: list[list[np.ndarray]], c: int, wave: np.ndarray, wanted: np.ndarray) -> None:
    """Read positions of bucket ``c`` in order and append the wanted ones before them to
    their buckets; those of the same bucket are the next wave."""
    while len(wave):
        before = wave[wave > 0] - 1
        before = before[wanted[before]]
        first = s[before]
        same = first == c
        if not same.any():
            _push(lists, before, first)
            return
        _push(lists, before[~same], first[~same])
        wave = before[same]
        lists[c].append(wave)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array, given types and the LMS positions in order."""
    size = int(s.max()) + 1
    mine: list[list[np.ndarray]] = [[] for _ in range(size)]
    _push(mine, lms, s[lms])
    larger: list[list[np.ndarray]] = [[] for _ in range(size)]
    not_smaller = ~smaller
    for c in range(size):
        _scan(s, larger, c, _joined(larger[c]), not_smaller)
        _scan(s, larger, c, _joined(mine[c]), not_smaller)
    falling: list[list[np.ndarray]] = [[] for _ in range(size)]
    for c in range(size - 1, -1, -1):
        _scan(s, falling, c, _joined(falling[c]), smaller)
        _scan(s, falling, c, _joined(larger[c])[::-1], smaller)
    falling[0] = [np.array([len(s) - 1], np.int32)]
    return np.concatenate([x for c in range(size) for x in (*larger[c], _joined(falling[c])[::-1])])


def types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last counts as smaller."""
    n = len(s)
    change = np.where(s[:-1] != s[1:], np.arange(n - 1, dtype=np.int32), np.int32(n))
    following = np.minimum.accumulate(change[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = s[following] < s[following + 1]
    return out


def words(s: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one integer; zeros follow the end."""
    padded = np.concatenate([s, np.zeros(8, np.uint8)])
    return np.ndarray((len(s),), "<u8", padded, strides=(1,))


def common(w: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """Common bytes from positions a and b on, up to ``most``."""
    out = np.zeros(len(a), np.int64)
    live, n = np.arange(len(a)), len(w)
    most = np.broadcast_to(most, len(a))
    at = 0
    while len(live):
        p, q = np.minimum(a[live] + at, n - 1), np.minimum(b[live] + at, n - 1)
        differ = w[p] ^ w[q]
        same = np.where(differ == 0, 8, 0)
        some = differ != 0
        low = differ[some] & (~differ[some] + np.uint64(1))
        same[some] = np.floor(np.log2(low.astype(np.float64))).astype(np.int64) // 8
        out[live] += same
        at += 8
        live = live[(same == 8) & (most[live] > at)]
    return np.minimum(out, most)


def _group(key: np.ndarray) -> np.ndarray:
    """For each value, how many are smaller."""
    order = np.argsort(key)
    new = np.append(True, key[order[1:]] != key[order[:-1]])
    out = np.empty(len(key), np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return out


def _follow(rank: np.ndarray, members: np.ndarray, after: np.ndarray) -> None:
    """Break ties of ``members`` (positions) in ``rank`` by the rank of what comes ``after``
    them; positions that come after themselves are in their final order."""
    n = len(rank) + 1
    live = members
    while len(live):
        far = after[live]
        last = bool((after[far] == far).all())
        key = rank[live] * n + rank[far]
        order = np.argsort(key)
        live, key = live[order], key[order]
        group = rank[live]
        at = np.arange(len(live))
        new = np.append(True, key[1:] != key[:-1])
        starts = np.maximum.accumulate(np.where(new, at, 0))
        firsts = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), at, 0))
        rank[live] = group + starts - firsts
        sizes = np.diff(np.flatnonzero(new), append=len(live))
        live = live[np.repeat(sizes > 1, sizes)]
        if last:
            return
        after[members] = after[after[members]]


def induced_ranks(t: np.ndarray, smaller: np.ndarray, lms: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes, induced from the order ``key`` of the LMS suffixes; ties in
    it stay ties."""
    n = len(t)
    letter = t * 2 + smaller
    places = np.arange(n)
    falling = np.flatnonzero(~smaller)
    # Those that are larger than the next one, by what follows them down to an LMS suffix.
    rank = np.zeros(n, np.int64)
    both = np.concatenate([falling, lms])
    rank[both] = _group(letter[both] * (n + 1) + np.concatenate([np.zeros(len(falling), np.int64), key]))
    after = places.copy()
    after[falling] += 1
    _follow(rank, falling, after)
    # The others, by what follows them up to one of these; the last one stays first.
    rising = np.flatnonzero(smaller)[:-1]
    second = np.where(smaller, 0, rank)
    rank = _group(letter * (n + 1) + second)
    after = places.copy()
    after[rising] += 1
    _follow(rank, rising, after)
    return rank


def sort_names(t: np.ndarray) -> np.ndarray:
    """The suffix array of a string of numbers 0, 1, ..., the last of which is 0 and no other."""
    if int(t.max()) + 1 == len(t):
        order = np.empty(len(t), np.int64)
        order[t] = np.arange(len(t))
        return order
    smaller = types(t)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    rough = induced_ranks(t, smaller, lms, np.zeros(len(lms), np.int64))[lms]
    names = np.unique(rough, return_inverse=True)[1].astype(np.int64)
    key = np.empty(len(lms), np.int64)
    key[sort_names(names)] = np.arange(len(lms))
    return np.argsort(induced_ranks(t, smaller, lms, key))


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of ``s`` (bytes, the last one 0 and no other) in order."""
    if len(s) == 1:
        return np.zeros(1, np.int32)
    smaller = types(s)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    rough = induce(s, smaller, lms)
    number = np.full(len(s), -1, np.int32)
    number[lms] = np.arange(len(lms), dtype=np.int32)
    ranked = number[rough]
    ranked = ranked[ranked >= 0]
    length = np.diff(lms, append=lms[-1]) + 1
    a, b = ranked[:-1], ranked[1:]
    equal = length[a] == length[b]
    equal[equal] = common(words(s), lms[a[equal]], lms[b[equal]], length[a[equal]]) == length[a[equal]]
    names = np.empty(len(lms), np.int64)
    names[ranked] = np.concatenate([[0], np.cumsum(~equal)])
    return induce(s, smaller, lms[sort_names(names)])


def permuted_common(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each position, the bytes that its suffix has in common with the one before it
    in ``order``, up to ``most`` (0 for the first).

    In the order of the text, that number falls by one a place at most.  So what a place
    has tells what the places after it have at least: every 64th place is compared from
    its first byte on, and those halfway between known ones from there on, again and again.
    """
    w, n = words(s), len(s)
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], n - 1
    out, step = np.zeros(n, np.int64), 64
    at = np.arange(0, n, step)
    out[at] = common(w, at, before[at], most)
    out[order[0]] = 0
    while step > 1:
        step //= 2
        at = np.arange(step, n, 2 * step)
        known = np.maximum(out[at - step] - step, 0)
        out[at] = known + common(w, at + known, before[at] + known, most - known)
        out[order[0]] = 0
    return out
