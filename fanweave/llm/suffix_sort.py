"""Suffix sorting by linear grouping.

Suffixes are grouped by a common prefix that is a Lyndon word. Groups are taken in descending order;
for each suffix of a group the nearest suffix to its left that is in a lower group is found with
the previous-smaller pointers of the suffixes between. Those that many pointers of the group meet
move to the end of their own group as new, higher groups, the most often met ones highest: their
prefix has grown by that many copies of the group's. When all groups are done, one ascending pass
places every suffix: the predecessor of a placed suffix, and the predecessors along its pointers,
come next in their groups. No names are assigned and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``symbols``, whose last symbol must be its only smallest one."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    ends = np.append(starts[1:], n)
    first = np.empty(n, np.int64)
    first[order] = np.repeat(starts, ends - starts)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)

    members = order.tolist()          # suffixes by group
    group = first.tolist()            # where a suffix's group begins in members
    where = place.tolist()            # where a suffix stands in members
    stop = [0] * (n + 1)              # where the group that begins here ends
    for s, e in zip(starts.tolist(), ends.tolist()):
        stop[s] = e
    lower = [-1] * n                  # previous-smaller pointers

    def regroup(moved: list[int], old: int) -> None:
        """Move suffixes of a group into a new group right after what is left of it."""
        end = stop[old]
        new = end - len(moved)
        if new == old:
            return
        at = end
        for j in moved:
            at -= 1
            other, hole = members[at], where[j]
            members[hole], where[other] = other, hole
            members[at], where[j] = j, at
            group[j] = new
        stop[new], stop[old] = end, new

    end = n
    while end:
        begin = group[members[end - 1]]
        if end - begin == 1:
            i = members[begin]
            j = i - 1
            while j >= 0 and group[j] >= begin:
                j = lower[j]
            lower[i] = j
            if j >= 0 and stop[group[j]] - group[j] > 1:
                regroup([j], group[j])
        else:
            met: dict[int, int] = {}
            for i in sorted(members[begin:end]):
                j = i - 1
                while j >= 0 and group[j] >= begin:
                    j = lower[j]
                lower[i] = j
                if j >= 0:
                    met[j] = met.get(j, 0) + 1
            alike: dict[tuple[int, int], list[int]] = {}
            for j, times in met.items():
                alike.setdefault((-times, group[j]), []).append(j)
            for times, old in sorted(alike):
                regroup(alike[times, old], old)
        end = begin

    result = [0] * n
    following = list(range(n))        # next free place of each group
    placed = bytearray(n)
    result[0] = n - 1
    placed[n - 1] = 1
    for r in range(n):
        j = result[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            result[following[g]] = j
            following[g] += 1
            placed[j] = 1
            j = lower[j]
    return np.array(result, np.int64)
