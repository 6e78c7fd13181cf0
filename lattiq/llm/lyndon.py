"""Suffix sorting by Lyndon-prefix groups (linear, no recursive renaming).

Phase 1 handles groups of suffixes from the largest context to the smallest.  A
suffix's previous-smaller pointer is the nearest position to its left that no
handled group holds, so handled positions are unlinked from a list and the
pointer is read off.  Each position pointed at gets its context extended by the
handled context once per pointer, which splits its group.  Phase 2 reads the
sorted order from the left and places every suffix on the pointer chain at the
front of its group.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of all suffixes of ``symbols`` in ascending order (a prefix sorts before what extends it)."""
    n = len(symbols)
    if n < 2:
        return list(range(n))
    by_symbol: dict[int, list[int]] = {}
    for i, s in enumerate(symbols):
        if s in by_symbol:
            by_symbol[s].append(i)
        else:
            by_symbol[s] = [i]
    members = [by_symbol[s] for s in sorted(by_symbol)]
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    size = [len(own) for own in members]
    count = len(members)
    above = list(range(1, count)) + [-1]
    below = list(range(-1, count - 1))
    left = list(range(-1, n - 1))
    right = list(range(1, n + 1))
    left.append(n - 1)
    pointer = left[:-1]
    g = count - 1
    lowest = 0
    while g != -1:
        hit: list[int] = []
        times: list[int] = []
        last = -2
        for i in members[g]:
            if group[i] != g:
                continue
            at, to = left[i], right[i]
            left[to] = at
            pointer[i] = at
            if at >= 0:
                right[at] = to
                if at == last:
                    times[-1] += 1
                else:
                    hit.append(at)
                    times.append(1)
                    last = at
        if hit:
            most = max(times)
            for often in range(most, 0, -1) if most > 1 else (1,):
                split: dict[int, list[int]] = {}
                for k, p in enumerate(hit):
                    if times[k] == often:
                        old = group[p]
                        if old in split:
                            split[old].append(p)
                        else:
                            split[old] = [p]
                for old, moved in split.items():
                    if len(moved) == size[old]:
                        continue
                    size[old] -= len(moved)
                    up = above[old]
                    above[old] = count
                    above.append(up)
                    below.append(old)
                    if up != -1:
                        below[up] = count
                    for p in moved:
                        group[p] = count
                    members.append(moved)
                    size.append(len(moved))
                    count += 1
        if below[g] == -1:
            lowest = g
        g = below[g]
    front = [0] * count
    g, at = lowest, 0
    while g != -1:
        front[g] = at
        at += size[g]
        g = above[g]
    out = [-1] * n
    placed = bytearray(n)
    j = n - 1
    while j != -1 and not placed[j]:
        placed[j] = 1
        out[front[group[j]]] = j
        front[group[j]] += 1
        j = pointer[j]
    for k in range(n):
        j = out[k] - 1
        while j != -1 and not placed[j]:
            placed[j] = 1
            out[front[group[j]]] = j
            front[group[j]] += 1
            j = pointer[j]
    return out
