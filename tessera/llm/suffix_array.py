"""Linear suffix sorting by grouping (Baier, "Linear-time suffix sorting", 2016).

First suffixes are grouped by their longest Lyndon prefix: groups are taken in descending order, and each suffix of a
group points to the nearest earlier one of a smaller group; the suffixes pointed at leave their groups for new ones
just above, those with more pointers higher. Then one pass over the array, from its start, puts the suffixes of each
group in order: a suffix that is put down lets those follow whose Lyndon prefix ends where it begins. Nothing is renamed
and nothing recurs.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> list[int]:
    """The start of each suffix in order. The last symbol must be smaller than all others."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    symbols, first = np.unique(text[order], return_index=True)
    members: list = [part.tolist() for part in np.split(order, first[1:])]
    group = np.searchsorted(symbols, text).tolist()
    size = [len(m) for m in members]
    k = len(members)
    below, above = [*range(-1, k - 1)], [*range(1, k), -1]
    smaller = [*range(-1, n - 1)]  # towards the nearest earlier suffix of a smaller group; shortened as groups end
    done = bytearray(n)
    at = k - 1
    while at >= 0:
        if size[at] == 1:
            for i in members[at]:
                if group[i] == at:
                    break
            done[i] = 1
            p = smaller[i]
            while p >= 0 and done[p]:
                p = smaller[p]
            smaller[i] = p
            if p >= 0 and size[old := group[p]] > 1:
                size[old] -= 1
                group[p] = k
                members.append((p,))
                size.append(1)
                over = above[old]
                above[old] = below[over] = k
                below.append(old)
                above.append(over)
                k += 1
        elif size[at]:
            own = members[at] if size[at] == len(members[at]) else [i for i in members[at] if group[i] == at]
            for i in own:
                done[i] = 1
            pointers: dict[int, int] = {}
            for i in own:
                p = smaller[i]
                while p >= 0 and done[p]:
                    p = smaller[p]
                smaller[i] = p
                pointers[p] = pointers.get(p, 0) + 1
            pointers.pop(-1, None)
            moved: dict[tuple[int, int], list[int]] = {}
            for p, count in pointers.items():
                moved.setdefault((count, group[p]), []).append(p)
            for count, old in sorted(moved, reverse=True):
                part = moved[count, old]
                if size[old] > len(part):  # a group that moves as a whole keeps its place
                    size[old] -= len(part)
                    for p in part:
                        group[p] = k
                    members.append(part)
                    size.append(len(part))
                    over = above[old]
                    above[old] = below[over] = k
                    below.append(old)
                    above.append(over)
                    k += 1
        at = below[at]
    front, at, total = [0] * k, 0, 0
    while at >= 0:
        front[at] = total
        total += size[at]
        at = above[at]
    out, placed = [0] * n, bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            placed[s] = 1
            s = smaller[s]
    return out
