"""Suffix array by linear grouping (no recursion, no renaming).

Suffixes are grouped by their longest Lyndon prefix.  Groups start as the
first characters and are processed in descending order: each member points to
the nearest suffix before it in a smaller group, and the suffixes pointed at
leave their groups for a new one just above, those met more often highest.
When all groups are done, one ascending sweep emits the order inside them: a
suffix that is emitted fixes the next place of the suffix before it and of
the chain of previous smaller ones.
"""

from __future__ import annotations


def suffix_array(values: list[int]) -> list[int]:
    """Start positions in suffix order; the last value must be the only
    smallest one."""
    n = len(values)
    order = sorted(range(n), key=values.__getitem__)
    place = [0] * n  # of a suffix in ``order``
    group = [0] * n  # of a suffix: the first place of its group
    size = [0] * n  # of a group, by first place
    first = 0
    for i, s in enumerate(order):
        if values[s] != values[order[first]]:
            first = i
        place[s], group[s] = i, first
        size[first] += 1
    before = [-1] * n
    group.append(-1)  # of the place before the text, reached as index -1

    top = n - 1
    while top >= 0:
        start = group[order[top]]
        if start == top:
            s = order[top]
            p = s - 1
            while group[p] > start:
                p = before[p]
            before[s] = p
            met = None
        else:
            met = {}
            for s in sorted(order[start : top + 1]):
                p = s - 1
                while group[p] >= start:
                    p = before[p]
                before[s] = p
                met[p] = met.get(p, 0) + 1
            met.pop(-1, None)
            if len(met) == 1:
                (p,) = met
            elif met:
                often = max(met.values())
                if often == 1:
                    _raise(met, order, place, group, size)
                else:
                    levels: dict[int, list[int]] = {}
                    for p, times in met.items():
                        levels.setdefault(times, []).append(p)
                    for times in sorted(levels, reverse=True):
                        _raise(levels[times], order, place, group, size)
                p = -1
            else:
                p = -1
        if p >= 0:  # a single suffix to move: a group of its own
            first = group[p]
            size[first] -= 1
            last = first + size[first]
            other = order[last]
            if other != p:
                at = place[p]
                order[at], place[other] = other, at
                order[last], place[p] = p, last
            group[p] = last
            size[last] = 1
        top = start - 1

    free = list(range(n))  # next place of a group, by first place
    found = [-1] * n
    done = bytearray(n)
    found[0] = n - 1
    done[n - 1] = 1
    for i in range(n):
        s = found[i] - 1
        while s >= 0 and not done[s]:
            first = group[s]
            at = free[first]
            found[at] = s
            free[first] = at + 1
            done[s] = 1
            s = before[s]
    return found


def _raise(members, order, place, group, size) -> None:
    """Move the members, each to a new group just above what stays of its
    own; members of one group stay together."""
    moved: dict[int, int] = {}
    for p in members:
        first = group[p]
        gone = moved[first] = moved.get(first, 0) + 1
        last = first + size[first] - gone
        other = order[last]
        if other != p:
            at = place[p]
            order[at], place[other] = other, at
            order[last], place[p] = p, last
    for first, gone in moved.items():
        size[first] -= gone
        new = first + size[first]
        size[new] = gone
        for i in range(new, new + gone):
            group[order[i]] = new
