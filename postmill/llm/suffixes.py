"""Suffix arrays by linear grouping (Baier, 2016), of many texts at a time.

The texts are steps ahead of one another in nothing: every step takes one group of each text that has groups left,
so that NumPy works on as many groups as there are texts.
"""

from __future__ import annotations

import numpy as np


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its count."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class _Groups:
    """Suffixes in line by group: line and place are inverse, group[i] is where the group of suffix i starts."""

    def __init__(self, symbols: np.ndarray, begin: np.ndarray):
        n = len(symbols)
        keys = np.repeat(np.arange(len(begin) - 1), np.diff(begin)) * (int(symbols.max()) + 1) + symbols
        self.line = np.argsort(keys, kind="stable")
        self.place = np.empty(n, dtype=np.int64)
        self.place[self.line] = np.arange(n)
        starts = np.flatnonzero(np.append(True, np.diff(keys[self.line]) != 0))
        sizes = np.diff(np.append(starts, n))
        # One entry more than suffixes: what -1 stands for, below all groups.
        self.group = np.full(n + 1, -1, dtype=np.int64)
        self.group[self.line] = np.repeat(starts, sizes)
        self.size = np.zeros(n, dtype=np.int64)
        self.size[starts] = sizes
        self.moved = np.zeros(n, dtype=bool)

    def _swap(self, at: np.ndarray, to: np.ndarray) -> None:
        one, other = self.line[at], self.line[to]
        self.line[at], self.place[other] = other, at
        self.line[to], self.place[one] = one, to

    def lift_each(self, items: np.ndarray) -> None:
        """Moves items, of groups that differ, to groups of their own right above."""
        own = self.group[items]
        sizes = self.size[own]
        some = sizes > 1
        items, own, sizes = items[some], own[some], sizes[some]
        new = own + sizes - 1
        self._swap(self.place[items], new)
        self.size[own], self.size[new], self.group[items] = sizes - 1, 1, new

    def lift(self, items: np.ndarray) -> None:
        """Moves items to new groups right above their own, those of one group together."""
        own = self.group[items]
        order = np.argsort(own, kind="stable")
        items, own = items[order], own[order]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        counts = np.diff(np.append(start, len(own)))
        sizes = self.size[own[start]]
        some = sizes > counts
        kept = np.repeat(some, counts)
        items, first, counts, sizes = items[kept], own[start][some], counts[some], sizes[some]
        new = first + sizes - counts
        self.moved[items] = True
        low = self.place[items] < np.repeat(new, counts)
        high = spread(new, counts)
        self._swap(self.place[items[low]], high[~self.moved[self.line[high]]])
        self.moved[items] = False
        self.group[items] = np.repeat(new, counts)
        self.size[first], self.size[new] = sizes - counts, counts


def suffix_arrays(symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The starts of all suffixes, each text's in lexicographic order; text t is symbols[begin[t]:begin[t + 1]].

    Symbols are not negative and a text's last one is its only smallest. First the suffixes are grouped by their
    Lyndon prefixes: groups are taken in descending order, each member finds the nearest position before it in a
    smaller group, and those positions, which now continue with the group's prefix, move to new groups right above
    their own. Then one ascending pass emits the order within the groups; no ranks are named again.
    """
    if not len(symbols):
        return np.zeros(0, dtype=np.int64)
    groups, first = _Groups(symbols, begin), begin[:-1]
    before = np.arange(-1, len(symbols))
    before[first], before[-1] = -1, -1
    previous = before.copy()
    floor, end = first, begin[1:] - 1
    while len(end):
        low = groups.group[groups.line[end]]
        many = low < end
        ones, stop = groups.line[end[~many]], low[~many]
        members = groups.line[spread(low[many], (end - low + 1)[many])]
        found = np.concatenate([ones, members])
        low_of = np.concatenate([stop, np.repeat(low[many], (end - low + 1)[many])])
        j = previous[found]
        going = np.flatnonzero(groups.group[j] >= low_of)
        while len(going):
            j[going] = before[j[going]]
            going = going[groups.group[j[going]] >= low_of[going]]
        before[found] = j
        single, rest = j[: len(ones)], j[len(ones) :]
        groups.lift_each(single[single >= 0])
        rest = rest[rest >= 0]
        if len(rest):
            rest, times = np.unique(rest, return_counts=True)
            for t in np.unique(times)[::-1].tolist():
                groups.lift(rest[times == t])
        end = low - 1
        live = end >= floor
        floor, end = floor[live], end[live]

    n = len(symbols)
    out, free, done = np.zeros(n, dtype=np.int64), np.arange(n), np.zeros(n + 1, dtype=bool)
    done[-1] = True
    last = begin[1:] - 1
    out[first], done[last] = last, True
    r, stop, j = first.copy(), begin[1:], previous[last]
    while len(r):
        over = done[j]
        go = ~over
        at = j[go]
        done[at] = True
        slot = groups.group[at]
        out[free[slot]] = at
        free[slot] += 1
        j[go] = before[at]
        r[over] += 1
        live = r < stop
        r, stop, j, over = r[live], stop[live], j[live], over[live]
        j[over] = previous[out[r[over]]]
    return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of one text in lexicographic order; its last symbol is the only smallest."""
    return suffix_arrays(np.asarray(symbols, dtype=np.int64), np.array([0, len(symbols)]))
