"""Suffix sorting by Lyndon-prefix groups, in linear time and without recursion.

Suffixes start in groups by their first byte. Groups are taken in descending order. For each suffix of a group the
previous-smaller pointer is found: the nearest earlier suffix of a lower group, by jumping over pointers that are known.
Suffixes that k members of the group point to have the group's string k more times behind their own, so they leave their
groups for a new one just above, those of larger k higher. When all groups are taken, suffixes stand in groups by their
longest Lyndon prefix; each group's order is then emitted in one ascending sweep along the pointers.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: bytes) -> list[int]:
    """The starts of all suffixes of text in ascending order; an empty suffix is not listed."""
    n = len(text) + 1  # with a sentinel below all bytes
    members: list = [None] * n  # by a group's start; those that have left it are passed over
    group, size, start_of = [0] * n, [0] * n, [0] * n
    by_byte: list[list[int]] = [[] for _ in range(256)]
    for i, c in enumerate(text):
        by_byte[c].append(i)
    at = size[0] = 1
    for own in by_byte:
        if own:
            for i in own:
                group[i] = at
            members[at], size[at] = own, len(own)
            start_of[at + len(own) - 1] = at
            at += len(own)

    previous = [-1] * n
    end = n - 1
    while end > 0:
        low = start_of[end]
        own = members[low]
        members[low] = None
        if low == end:  # a single suffix, as most groups are in the end
            for i in own:
                if group[i] == low:
                    break
            p = i - 1
            while p >= 0 and group[p] > low:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                g = group[p]
                rest = size[g] - 1
                if rest:
                    new = g + rest
                    size[g], size[new] = rest, 1
                    start_of[new - 1], start_of[new] = g, new
                    members[new] = (p,)
                    group[p] = new
            end = low - 1
            continue
        own = [i for i in own if group[i] == low]
        own.sort()
        times: dict[int, int] = {}
        once: list[int] = []  # most are pointed to by one member
        for i in own:
            p = i - 1
            while p >= 0 and group[p] > low:
                p = previous[p]
            if p >= 0:
                if group[p] == low:
                    p = previous[p]
                    if p >= 0:
                        times[p] = times.get(p, 1) + 1
                else:
                    once.append(p)
            previous[i] = p
        by_count: dict[int, list[int]] = {1: [p for p in once if p not in times] if times else once}
        for p, k in times.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True) if times else (1,):
            moved: dict[int, list[int]] = {}
            for p in by_count[k]:
                g = group[p]
                if g in moved:
                    moved[g].append(p)
                else:
                    moved[g] = [p]
            for g, ps in moved.items():
                rest = size[g] - len(ps)
                if rest:
                    new = g + rest
                    size[g], size[new] = rest, len(ps)
                    start_of[new - 1], start_of[new + len(ps) - 1] = g, new
                    members[new] = ps
                    for p in ps:
                        group[p] = new
        end = low - 1

    out = [0] * n
    out[0] = n - 1
    placed = bytearray(n)
    next_of = list(range(n))
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[next_of[g]] = s
            next_of[g] += 1
            placed[s] = 1
            s = previous[s]
    return out[1:]


def window_runs(text: bytes, wanted: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The wanted starts in ascending order of their suffixes, and the run of equal windows that each is in, numbered from 0."""
    order = np.array(suffix_array(text), np.int64)
    order = order[wanted[order]]
    if not len(order):
        return order, order
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), width)[order]
    return order, np.concatenate(([0], np.cumsum((windows[1:] != windows[:-1]).any(axis=1))))


def equal_windows(text: bytes, starts: list[int], width: int) -> list[list[int]]:
    """The classes of equal windows among those that begin at starts, in ascending order of their bytes."""
    wanted = np.zeros(len(text), bool)
    wanted[np.array(starts, np.int64)] = True
    order, run = window_runs(text, wanted, width)
    return [c.tolist() for c in np.split(order, np.flatnonzero(np.diff(run)) + 1)] if len(order) else []
