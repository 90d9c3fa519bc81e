"""Suffix array in linear time by grouping, without recursive renaming.

Phase 1 groups suffixes by their Lyndon prefix. Groups are taken in descending order; every suffix of a group finds its previous smaller
suffix, and those smaller suffixes move behind the rest of their own group, in as many steps as suffixes of the taken group point to them.
Phase 2 goes through the suffix array from its least suffix and places, by the same pointers, the suffixes that come next in each group.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """The starts of the suffixes of ``text`` in order. Symbols are integers from 1 on; the end of the text sorts before them."""
    order, group, before = _grouped([*text, 0])
    return _emitted(order, group, before)[1:]


def _grouped(text: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffixes by group, each suffix's group (the place where it begins), and each suffix's previous smaller suffix."""
    n = len(text)
    starts = [0] * (max(text) + 2)
    for c in text:
        starts[c + 1] += 1
    for c in range(1, len(starts)):
        starts[c] += starts[c - 1]
    first, fill = starts[:], starts[:]
    order, place, group = [0] * n, [0] * n, [0] * n
    end = [0] * n
    for i, c in enumerate(text):
        at = fill[c]
        fill[c] = at + 1
        order[at], place[i], group[i] = i, at, first[c]
    for i in range(n - 1, -1, -1):
        if not end[group[order[i]]]:
            end[group[order[i]]] = i
    before, known = [-1] * n, [False] * n
    at = n - 1
    while at > 0:
        mine = group[order[at]]
        hits: dict[int, int] = {}
        if mine == at:
            i = order[at]
            p = i - 1
            while p >= 0 and group[p] >= mine:
                p = before[p]
            before[i], known[i] = p, True
            if p >= 0:
                # A single pointer: the suffix moves behind the rest of its group.
                old = group[p]
                last = end[old]
                if last > old:
                    other, spot = order[last], place[p]
                    order[spot], place[other] = other, spot
                    order[last], place[p] = p, last
                    group[p], end[last], end[old] = last, last, last - 1
            at -= 1
            continue
        for i in order[mine : at + 1]:
            if known[i]:
                continue
            # Members that are met on the way have the same previous smaller suffix, so each pointer is followed once, whatever the order of the members.
            met, p = [i], i - 1
            while p >= 0 and group[p] >= mine:
                if group[p] == mine and not known[p]:
                    met.append(p)
                    p -= 1
                else:
                    p = before[p]
            for j in met:
                before[j], known[j] = p, True
            if p >= 0:
                hits[p] = hits.get(p, 0) + len(met)
        if hits:
            levels: list[list[int]] = [[] for _ in range(max(hits.values()))]
            for p, count in hits.items():
                levels[count - 1].append(p)
            for level in reversed(levels):
                split: dict[int, list[int]] = {}
                for p in level:
                    split.setdefault(group[p], []).append(p)
                for old, moved in split.items():
                    last = end[old]
                    new = last - len(moved) + 1
                    if new == old:
                        continue
                    spot = last
                    for p in moved:
                        other, from_ = order[spot], place[p]
                        order[from_], place[other] = other, from_
                        order[spot], place[p] = p, spot
                        group[p] = new
                        spot -= 1
                    end[new], end[old] = last, new - 1
        at = mine - 1
    return order, group, before


def _emitted(order: list[int], group: list[int], before: list[int]) -> list[int]:
    n = len(order)
    out = [-1] * n
    free = list(range(n))
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            spot = free[g]
            free[g] = spot + 1
            out[spot] = j
            placed[j] = True
            j = before[j]
    return out
