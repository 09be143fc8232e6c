"""Linear suffix sorting by grouping: no recursion and no renaming of the text.

First suffixes are gathered into groups that share their Lyndon prefix. Groups are handled from the
highest down: each suffix of a group points to the previous suffix of a lower group; suffixes that
get more pointers from the group move to a higher new group just above their old one. Then the order
inside groups is emitted: the suffix just placed places the one before it at the front of its group,
and so on along the previous-smaller pointers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int]) -> list[int]:
    """Starts of the suffixes of a sequence of non-negative integers, in ascending order."""
    text = np.asarray(symbols, dtype=np.int64)
    n = len(text) + 1  # with an end smaller than all
    text = np.concatenate([text + 1, [0]])
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    begins = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.concatenate([begins, [n]]))
    group_size = np.zeros(n, np.int64)
    group_size[begins] = sizes
    link = np.empty(n, np.int64)
    link[order] = np.repeat(begins, sizes)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group, link, previous = _group(order.tolist(), place.tolist(), link.tolist(), group_size.tolist())
    return _emit(n, link, previous)[1:]


def _group(held: list[int], place: list[int], link: list[int], size: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Phase one. ``held``: suffixes by group; ``place``: its inverse; ``link``: a suffix's group start;
    ``size``: a group's size at its start. Returns these with the previous-smaller pointers (-1: none)."""
    n = len(held)
    previous = [-2] * n  # -2: its group is still to come
    end = n
    while end > 0:
        start = link[held[end - 1]]
        if end - start == 1:
            i = held[start]
            j = i - 1
            while j >= 0 and previous[j] != -2:
                j = previous[j]
            previous[i] = j
            if j >= 0:  # one pointer: the suffix moves alone
                g = link[j]
                k = size[g] - 1
                if k:
                    last = g + k
                    p = place[j]
                    if p != last:
                        other = held[last]
                        held[p], place[other] = other, p
                        held[last], place[j] = j, last
                    size[g] = k
                    size[last] = 1
                    link[j] = last
            end = start
            continue
        members = sorted(held[start:end])
        for i in members:
            previous[i] = -1
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and previous[j] != -2:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, count in pointed.items():
            by_count.setdefault(count, []).append(j)
        for count in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for j in by_count[count]:
                g = link[j]
                gone = moved.get(g, 0)
                moved[g] = gone + 1
                last = g + size[g] - 1 - gone
                p = place[j]
                if p != last:
                    other = held[last]
                    held[p], place[other] = other, p
                    held[last], place[j] = j, last
            for g, gone in moved.items():
                rest = size[g] - gone
                if not rest:
                    continue
                size[g], size[g + rest] = rest, gone
                at = g + rest
                for p in range(at, at + gone):
                    link[held[p]] = at
        end = start
    return held, link, previous


def _emit(n: int, link: list[int], previous: list[int]) -> list[int]:
    """Phase two: the order of all suffixes, from the groups' starts and the pointers."""
    out = [-1] * n
    out[0] = n - 1
    next_free = list(range(n))  # of a group, by its start
    placed = [False] * n
    placed[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = link[j]
            out[next_free[g]] = j
            next_free[g] += 1
            placed[j] = True
            j = previous[j]
    return out
