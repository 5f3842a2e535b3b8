"""Suffix arrays by induced sorting, with whole stretches of the array at a time in numpy.

Suffixes are classed as smaller (S) or larger (L) than the one behind them. The
leftmost S-suffixes (LMS) of each run are sorted first: their substrings are sorted by
induction and named, and the string of names is sorted recursively, whatever its
alphabet. A second induction then gives all suffixes from the sorted LMS ones in linear
time. A sweep of induction takes as long a stretch of the array as does not itself
receive suffixes from the stretch, so that its suffixes are final.
"""

from __future__ import annotations

import numpy as np

from tallyship.llm.blocks import numbered, prefix

#: Strings of fewer characters are sorted by doubling, as the end of the recursion: a sweep's stretches are short there.
FEW = 1 << 16

#: The byte between strings.
END = 254

#: Suffixes of a stretch at first; it grows and shrinks with what a sweep meets.
STRETCH = 1 << 12


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next; the last is larger than the empty one."""
    rises = np.zeros(len(text), bool)
    rises[:-1] = text[1:] > text[:-1]
    differs = np.ones(len(text), bool)
    differs[:-1] = text[1:] != text[:-1]
    level = np.flatnonzero(~differs)  # before an equal character: as the next that differs
    if len(level):
        at = np.flatnonzero(differs)
        rises[level] = rises[at[np.searchsorted(at, level)]]
    return rises


def _sweep(order: np.ndarray, free: np.ndarray, char_before: np.ndarray) -> None:
    """Goes through ``order`` (-1: not yet known) and puts the suffix before each into the next free place of its character, unless that is the type's greatest number.

    All that a stretch induces is placed at once. A place inside the stretch ends it
    there, since the suffix that comes to it induces in its turn. ``char_before`` has the
    character before each place, and one more for what is not known.
    """
    at, width, n, none = 0, STRETCH, len(order), np.iinfo(char_before.dtype).max
    while at < n:
        stop = min(at + width, n)
        source = order[at:stop]
        char = char_before[source]
        giving = (char != none).nonzero()[0]
        k = len(giving)
        if k:
            char = char[giving]
            by = char.argsort(kind="stable")
            in_order, giving = char[by], giving[by]
            begin = np.empty(k, bool)
            begin[0] = True
            np.not_equal(in_order[1:], in_order[:-1], out=begin[1:])
            begin = begin.nonzero()[0]
            kinds = in_order[begin]
            count = np.empty(len(begin), np.int64)
            np.subtract(begin[1:], begin[:-1], out=count[:-1])
            count[-1] = k - begin[-1]
            first = free[kinds]
            place = (first - begin).repeat(count)
            place += np.arange(k)
            nearest = int(first.min())
            if nearest < stop:
                stop = nearest
                ready = giving < stop - at
                count = np.add.reduceat(ready, begin, dtype=np.int64)
                giving, place = giving[ready], place[ready]
            free[kinds] = first + count
            order[place] = source[giving] - 1
        width = max(64, min(2 * (stop - at), 1 << 17))
        at = stop


class _Buckets:
    """Where the suffixes of each character stand in the array, the larger ones before the smaller."""

    def __init__(self, text: np.ndarray, small: np.ndarray):
        self.text, self.small = text, small
        most = int(text.max())
        self.char = text.astype(np.uint8 if most < 0xFF else np.uint16 if most < 0xFFFF else np.uint32 if most < 0xFFFFFFFF else np.int64)
        self.none = np.iinfo(self.char.dtype).max
        count = np.bincount(text)
        n_small = np.bincount(text[small], minlength=len(count))
        self.ends = np.cumsum(count)
        self.starts = self.ends - count
        self.holds_small = np.repeat(np.tile([False, True], len(count)), np.stack([count - n_small, n_small], 1).ravel())

    def induce(self, lms: np.ndarray) -> np.ndarray:
        """All suffixes in order, from the LMS ones in order (or, for their substrings' sake, in any order within a bucket)."""
        text, n = self.text, len(self.text)
        order = np.full(n, -1, np.int32 if n < 2**31 else np.int64)
        char = text[lms]
        by = np.argsort(char, kind="stable")
        before = prefix(np.bincount(char, minlength=len(self.ends)))
        in_order = char[by]
        order[self.ends[in_order] - (before[1:][in_order] - np.arange(len(lms)))] = lms[by]
        free = self.starts.copy()
        order[free[text[-1]]] = n - 1  # larger than the empty suffix behind it
        free[text[-1]] += 1
        _sweep(order, free, self._before(~self.small))
        order[self.holds_small] = -1
        _sweep(order[::-1], n - self.ends, self._before(self.small))  # from the largest suffix down
        return order

    def _before(self, wanted: np.ndarray) -> np.ndarray:
        """The character before each place, if that one is wanted; none before the first and (for -1) behind the last."""
        none = self.char.dtype.type(self.none)
        return np.concatenate([[none], np.where(wanted[:-1], self.char[:-1], none), [none]])


def _doubled(text: np.ndarray) -> np.ndarray:
    """The suffix array of a short string, by doubling the length that is sorted."""
    n = len(text)
    rank, width = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        behind = np.zeros(n, np.int64)
        if width < n:
            behind[:-width] = rank[width:] + 1
        key = rank * (n + 1) + behind
        order = np.argsort(key)
        ordered = key[order]
        new = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


def suffix_array(text: np.ndarray, end: int = -1) -> np.ndarray:
    """Places of all suffixes of an array of non-negative integers, in ascending order.

    ``end``, if given, is the greatest character; how suffixes compare behind their first
    one does not matter then, and they may stand in any order that the rest of them allows.
    """
    n = len(text)
    if n < FEW:
        return _doubled(text) if n else np.zeros(0, np.int64)
    small = _types(text)
    buckets = _Buckets(text, small)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32 if n < 2**31 else np.int64) + 1
    if len(lms) > 1:
        order = buckets.induce(lms)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = order[is_lms[order]]
        # two LMS substrings are equal if the stretches to the next LMS place are, and the character there
        most = int(text.max())
        wide = text.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")
        bounds = np.append(lms, n).astype(np.int64)
        own = numbered(wide[lms[0] :].view(np.uint8), wide.itemsize * (bounds - bounds[0]))
        ends = np.append(text[lms[1:]].astype(np.int64), -1)
        rank_of = np.empty(n, np.int32 if n < 2**31 else np.int64)
        rank_of[lms] = np.arange(len(lms))
        which = rank_of[order]
        own, ends = own[which], ends[which]
        fresh = np.append(True, (own[1:] != own[:-1]) | (ends[1:] != ends[:-1]))
        if end >= 0:  # equal up to an end is enough; such substrings get names of their own
            over = np.zeros(len(lms) + 1, bool)
            over[np.searchsorted(lms, np.flatnonzero(text == end))] = True  # by the LMS place behind the end
            fresh |= over[1:][which]
        lms = order if fresh.all() else _by_names(order, which, fresh)
    return buckets.induce(lms)


def _by_names(order: np.ndarray, which: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """LMS places in the order of their suffixes, from their order by substrings, the number of each in the text, and where a new name begins.

    Nothing is compared past a name that stands once, so of several such names in a row
    only the first is in the string of names that is sorted; all of them have their place.
    """
    once = fresh & np.append(fresh[1:], True)
    names, several = np.empty(len(order), np.int32), np.empty(len(order), bool)
    names[which], several[which] = np.cumsum(fresh) - 1, ~once
    kept = np.flatnonzero(several | np.append(False, several[:-1]))
    used = np.zeros(len(order), bool)
    used[names[kept]] = True
    ranked = kept[suffix_array((np.cumsum(used, dtype=np.int32) - 1)[names[kept]])]
    place = np.empty(len(order), order.dtype)
    place[which] = order
    out = order.copy()
    out[~once] = place[ranked[several[ranked]]]
    return out


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray, places: np.ndarray, cap: int) -> np.ndarray:
    """For each of ``places``, how many characters (``cap`` at most) its suffix shares with the one before it in order.

    Eight bytes are compared at once, and only suffixes that agree so far go on.
    """
    before = np.full(len(text), -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text.astype(np.uint8), np.zeros(cap + 8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    shared = np.zeros(len(places), np.int64)
    going = np.flatnonzero(before[places] >= 0)
    for k in range(0, cap, 8):
        a, b = places[going], before[places[going]]
        differ = eight[a + k] ^ eight[b + k]
        same = differ == 0
        end, differ = going[~same], differ[~same]
        low = differ & (~differ + np.uint64(1))
        shared[end] = k + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        going = going[same]
    shared[going] = cap
    room = len(text) - np.maximum(places, before[places])
    return np.minimum(np.minimum(shared, cap), room)


def repeated_windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows of ``width`` bytes inside consecutive byte strings, and a number for each, equal for equal windows.

    The strings must not have the bytes 254 and 255, which no UTF-8 text has; 254 is put between them.
    """
    sizes = np.diff(offsets)
    text = np.insert(data, offsets[1:], END)
    starts = prefix(sizes + 1)[:-1]
    counts = np.maximum(sizes - width + 1, 0)
    at = prefix(counts)
    places = np.repeat(starts - at[:-1], counts) + np.arange(at[-1])  # in order of strings and offsets
    if not len(places):
        return places, places
    order = suffix_array(text, END)
    shared = permuted_common_prefixes(text, order, places, width)
    number = np.full(len(text), -1, np.int64)
    number[places] = shared < width
    in_order = order[number[order] >= 0]
    group = np.cumsum(number[in_order]) - 1
    number[in_order] = group
    return places - np.repeat(starts, counts), number[places]
