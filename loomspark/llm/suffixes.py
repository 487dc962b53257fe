"""Suffix arrays by linear grouping construction.

Suffixes begin grouped by their first symbol. Groups are taken in descending order; each suffix of a group
finds the nearest suffix before it whose group is smaller (its previous-smaller pointer), and suffixes that
are pointed at move to new groups right behind their own, the more pointers the further back. At the end the
groups order suffixes by their longest Lyndon prefix, and one pass along the suffix array, following the
pointers, emits each group in order. No recursion and no renaming of substrings takes place.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """The starts of the suffixes of ``symbols`` (positive integers) in ascending order."""
    n = len(symbols) + 1
    text = [*symbols, 0]  # an end symbol below all others
    counts: dict[int, int] = {}
    for c in text:
        counts[c] = counts.get(c, 0) + 1
    first, at = {}, 0
    for c in sorted(counts):
        first[c] = at
        at += counts[c]
    group = [first[c] for c in text]  # a group is named by where its suffixes begin in the result
    size = [0] * n
    members: list[list[int] | None] = [None] * n
    for i, g in enumerate(group):
        if members[g] is None:
            members[g] = []
        members[g].append(i)
        size[g] += 1
    prev = [-1] * n
    for g in range(n - 1, -1, -1):
        own = members[g]
        if own is None:
            continue
        own = [i for i in own if group[i] == g]  # others have moved on
        pointed: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and group[p] >= g:
                q = prev[p]
                p = q if group[p] > g or q >= 0 else p - 1
            prev[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        members[g] = own
        if not pointed:
            continue
        moves: dict[tuple[int, int], list[int]] = {}
        for p, k in pointed.items():
            moves.setdefault((k, group[p]), []).append(p)
        for k, old in sorted(moves, reverse=True) if len(moves) > 1 else moves:
            some = moves[k, old]
            if len(some) == size[old]:
                continue  # the whole group moves: nothing changes
            size[old] -= len(some)
            new = old + size[old]
            members[new], size[new] = some, len(some)
            for p in some:
                group[p] = new
    result = [-1] * n
    free = list(range(n))  # by group: its next place
    placed = bytearray(n)
    result[0], placed[n - 1] = n - 1, 1
    for i in range(n):
        j = result[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            result[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = prev[j]
    return result[1:]
