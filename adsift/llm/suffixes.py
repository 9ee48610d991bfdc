"""Suffix arrays by grouping on Lyndon prefixes, in linear time and without renaming.

First all suffixes are grouped by their first symbol. The groups are taken from the highest down; each member points to
the nearest earlier suffix of a lower group (its previous smaller one), and the suffixes so pointed at move up into new
groups right behind their own: those with more pointers higher. Then every group holds the suffixes of one Lyndon prefix.
Second, the order is emitted from the lowest suffix on: whoever stands before a suffix just emitted comes next in its group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes in order; a suffix that is a beginning of another comes before it. Symbols are above 0."""
    text = [*symbols, 0]
    n = len(text)
    order = np.argsort(np.asarray(text), kind="stable").tolist()
    place = [0] * n  # of a suffix in order
    group = [0] * n  # of a suffix: where its group begins in order
    last = [0] * n  # of a group, by its beginning: where it ends
    begin = 0
    for at, s in enumerate(order):
        if at and text[s] != text[order[at - 1]]:
            begin = at
        place[s], group[s], last[begin] = at, begin, at
    before = [-1] * n

    end = n - 1
    while end >= 0:
        begin = group[order[end]]
        members = order[begin : end + 1]
        if len(members) > 1:
            members.sort()
        pointers: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] > begin:
                p = before[p]
            if p >= 0 and group[p] == begin:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointers[p] = pointers.get(p, 0) + 1
        if pointers:
            _move_up(pointers, order, place, group, last)
        end = begin - 1
    return _emitted(order, group, before)


def _move_up(pointers: dict[int, int], order: list[int], place: list[int], group: list[int], last: list[int]) -> None:
    """Move the suffixes into groups behind their own; more pointers first, so that they end up higher."""
    for count in sorted(set(pointers.values()), reverse=True):
        moved: dict[int, int] = {}
        chosen = [p for p, c in pointers.items() if c == count]
        for p in chosen:
            old = group[p]
            if old not in moved:
                moved[old] = last[old]
            top, at = last[old], place[p]
            other = order[top]
            order[top], order[at] = p, other
            place[p], place[other] = top, at
            last[old] = top - 1
        for p in chosen:
            old = group[p]
            new = last[old] + 1
            # A group that moved as a whole keeps its beginning.
            group[p] = new
        for old, top in moved.items():
            new = last[old] + 1
            last[new] = top


def _emitted(order: list[int], group: list[int], before: list[int]) -> list[int]:
    n = len(order)
    out, free, done = [-1] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    free[0] = 1
    for at in range(n):
        s = out[at] - 1
        while s >= 0 and not done[s]:
            slot = group[s]
            out[free[slot]] = s
            free[slot] += 1
            done[s] = 1
            s = before[s]
    return out[1:]
