"""Suffix sorting by linear grouping.

Suffixes start in groups by first symbol. Groups are taken from the largest down; every
member finds the nearest earlier suffix of a smaller group (its previous-smaller
pointer), and those that are pointed at leave their group for one just above it, the further
up the more members point at them. Then each group holds the suffixes with one
longest Lyndon prefix, and the groups are in order. A last pass emits the order inside the groups
by walking the pointers back from each suffix in turn; nothing is renamed or solved again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``symbols`` in order; a suffix's end is below every symbol."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    by_symbol = np.argsort(symbols, kind="stable")
    first = np.ones(n, bool)
    first[1:] = symbols[by_symbol[1:]] != symbols[by_symbol[:-1]]
    heads = np.flatnonzero(first)
    place = np.empty(n, np.int64)
    place[by_symbol] = np.arange(n)
    member = np.empty(n, np.int64)
    member[by_symbol] = np.repeat(heads, np.diff(np.append(heads, n)))

    line = by_symbol.tolist()  # suffixes, group by group
    place = place.tolist()  # of each suffix in the line
    group = member.tolist()  # of each suffix: where its group begins
    end = [0] * n  # of the group that begins there
    for a, b in zip(heads.tolist(), np.append(heads[1:], n).tolist()):
        end[a] = b - 1
    before = [-1] * n  # previous-smaller pointers

    high = n - 1
    while high >= 0:
        low = group[line[high]]
        pointed: dict[int, int] = {}
        if low == high:
            s = line[low]
            j = s - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[s] = j
            if j >= 0:
                pointed[j] = 1
        else:
            for s in sorted(line[low : high + 1]):
                j = s - 1
                while j >= 0 and group[j] >= low:
                    j = before[j]
                before[s] = j
                if j >= 0:
                    pointed[j] = pointed.get(j, 0) + 1
        split: dict[int, list[tuple[int, int]]] = {}
        for j, times in pointed.items():
            split.setdefault(group[j], []).append((times, j))
        for g, leaving in split.items():
            at = end[g]
            leaving.sort(reverse=True)
            i = 0
            while i < len(leaving):
                times, top = leaving[i][0], at
                new = []
                while i < len(leaving) and leaving[i][0] == times:
                    j = leaving[i][1]
                    other, p = line[at], place[j]
                    line[at], line[p] = j, other
                    place[j], place[other] = at, p
                    new.append(j)
                    at -= 1
                    i += 1
                start = at + 1
                for j in new:
                    group[j] = start
                end[start] = top
            if at >= g:
                end[g] = at
        high = low - 1

    free = list(range(n))  # next free place of the group that begins there
    out = [-1] * n
    done = bytearray(n)
    s, i = n, 0
    while True:
        j = s - 1
        while j >= 0 and not done[j]:
            done[j] = 1
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = before[j]
        if i == n:
            return np.array(out, np.int64)
        s = out[i]
        i += 1
