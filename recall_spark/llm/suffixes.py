"""Suffix arrays by linear grouping, for many strings side by side.

Suffixes are grouped by their longest Lyndon prefix. Groups are processed in descending order: every member points to the
last suffix before it of a smaller group, and suffixes pointed at move into a group right behind their own, the further
the more often they are pointed at. In the final groups a suffix is its Lyndon prefix and a later suffix, so
one pass over the emerging order emits each group's order; nothing is renamed or sorted again.

A pointer is found by following the pointers of what lies between, which no later search meets again, and a suffix moves
by an exchange with one that stays, so the work of a string is in proportion to its length. numpy does a step for
all strings at once.
"""

from __future__ import annotations

import numpy as np


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... for size[k] numbers each."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def group_suffixes(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase one, over rows laid end to end with a sentinel before each: (place of each suffix's final group, previous-smaller pointer).

    A suffix is known by its place behind the sentinels; pointers to a sentinel mean that there is none.
    """
    m, n = sym.shape
    wide = n + 1
    base = np.arange(m, dtype=np.int64)[:, None] * wide + 1
    order = np.argsort(sym, axis=1, kind="stable")
    laid = np.take_along_axis(sym, order, 1)
    new = np.ones((m, n), bool)
    new[:, 1:] = laid[:, 1:] != laid[:, :-1]
    at = np.full((m, wide), -1, np.int64)  # suffix at each place of the order
    at[:, 1:] = order + base
    at = at.ravel()
    group = np.full((m, wide), -1, np.int64)  # place where a suffix's group starts; sentinels are smaller than all
    starts = np.maximum.accumulate(np.where(new, np.arange(n), 0), axis=1) + base
    np.put_along_axis(group[:, 1:], order, starts, 1)
    group = group.ravel()
    place = np.empty(m * wide, np.int64)  # of a suffix in the order
    place[at[at >= 0]] = np.flatnonzero(at >= 0)
    size = np.bincount(starts.ravel(), minlength=m * wide + 1)
    prev = np.full(m * wide, -1, np.int64)
    moving = np.zeros(m * wide, bool)
    first, end = base.ravel(), base.ravel() + n - 1
    while len(end):
        start = group[at[end]]
        count = end - start + 1
        own = at[_ranges(start, count)]
        least = np.repeat(start, count)
        p = own - 1
        prev[own] = p
        going = np.flatnonzero(group[p] >= least)
        while len(going):
            p[going] = far = prev[p[going]]
            prev[own[going]] = far
            going = going[group[far] >= least[going]]
        hit = np.sort(p[group[p] >= 0])
        if len(hit):
            heads = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1]])
            to, times = hit[heads], np.diff(np.r_[heads, len(hit)])
            old = group[to]
            by = np.lexsort((times, old))
            to, times, old = to[by], times[by], old[by]
            head = np.r_[True, old[1:] != old[:-1]]
            heads = np.flatnonzero(head)
            k = np.diff(np.r_[heads, len(to)])
            left = old[heads]
            tail = left + size[left] - k  # the movers' places are the last k of their group
            dest = _ranges(tail, k)
            # who stays but stands in the tail goes where a mover stood before it
            moving[to] = True
            was = place[to]
            stand = at[dest]
            stay = stand[~moving[stand]]
            hole = was[was < np.repeat(tail, k)]
            at[hole], place[stay] = stay, hole
            at[dest], place[to] = to, dest
            moving[to] = False
            size[left] -= k
            fresh = np.flatnonzero(head | np.r_[True, times[1:] != times[:-1]])
            begin, many = dest[fresh], np.diff(np.r_[fresh, len(to)])
            size[begin] = many
            group[to] = np.repeat(begin, many)
        end = start - 1
        on = end >= first
        end, first = end[on], first[on]
    return group, prev


def suffix_arrays(sym: np.ndarray) -> np.ndarray:
    """Suffix array of each row; a row's last symbol must be its least (padding with it is fine)."""
    m, n = sym.shape
    group, prev = group_suffixes(sym)
    wide = n + 1
    out = np.full(m * wide, -1, np.int64)
    free = np.arange(m * wide, dtype=np.int64)
    done = np.zeros(m * wide, bool)
    first = np.arange(m, dtype=np.int64) * wide
    done[first] = True  # sentinels
    for i in range(n):
        s = first + n if i == 0 else out[first + i] - 1
        while True:
            s = s[~done[s]]
            if not len(s):
                break
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = True
            s = prev[s]
    return (out.reshape(m, wide)[:, 1:] - first[:, None] - 1).astype(np.int32)
