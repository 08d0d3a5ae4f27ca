"""A suffix array built from Lyndon-prefix groups, in linear space and without renaming rounds.

All suffixes that share their Lyndon prefix (their longest prefix that is a Lyndon word)
form one group.  Groups start as suffixes with one first symbol and are processed from the
highest down.  A processed suffix points to the nearest suffix before it that stands in a
lower group, its previous smaller suffix, and makes that one's Lyndon prefix longer: the
target leaves its group for a new one just above, higher the more members of the processed
group follow it.  When all are processed the groups stand in their final order, and one
ascending pass places each suffix at the head of its group as soon as the suffix behind
its Lyndon prefix has its place.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of text in ascending order; a suffix precedes its extensions.

    An empty text has none.  Symbols are any integers.
    """
    n = len(text)
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        if c in first:
            first[c].append(i)
        else:
            first[c] = [i]
    symbols = sorted(first)
    members = [first[c] for c in symbols]
    down = list(range(-1, len(symbols) - 1))
    up = list(range(1, len(symbols) + 1))
    group = [0] * n
    for g, found in enumerate(members):
        for s in found:
            group[s] = g
    previous = [-1] * n
    done = bytearray(n)
    order = []
    current = len(symbols) - 1
    while current >= 0:
        mine = members[current]
        if len(mine) == 1:
            s = mine[0]
            if group[s] == current:
                p = s - 1
                while p >= 0 and done[p]:
                    p = previous[p]
                previous[s] = p
                done[s] = 1
                order.append(current)
                if p >= 0:
                    h, new = group[p], len(members)
                    above = up[h]
                    members.append([p])
                    down.append(h)
                    up.append(above)
                    up[h] = new
                    down[above] = new
                    group[p] = new
            current = down[current]
            continue
        mine = [s for s in mine if group[s] == current]  # the others have moved up
        if mine:
            mine.sort()
            members[current] = mine
            order.append(current)
            follow: dict[int, int] = {}
            for s in mine:
                p = s - 1
                while p >= 0 and done[p]:
                    p = previous[p]
                previous[s] = p
                done[s] = 1
                if p >= 0:
                    follow[p] = follow.get(p, 0) + 1
            moves: dict[tuple[int, int], list[int]] = {}
            for p, times in follow.items():
                key = (times, group[p])
                if key in moves:
                    moves[key].append(p)
                else:
                    moves[key] = [p]
            last: dict[int, int] = {}
            for times, h in sorted(moves) if len(moves) > 1 else moves:
                below, new = last.get(h, h), len(members)
                above = up[below]
                found = moves[times, h]
                members.append(found)
                down.append(below)
                up.append(above)
                up[below] = new
                down[above] = new
                last[h] = new
                for p in found:
                    group[p] = new
        current = down[current]

    head, at = [0] * len(members), 0
    for g in reversed(order):
        head[g] = at
        at += len(members[g])
    out = [0] * n
    placed = bytearray(n)
    for i in range(-1, n):
        p = (out[i] if i >= 0 else n) - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            out[head[g]] = p
            head[g] += 1
            placed[p] = 1
            p = previous[p]
    return out
