"""Suffix arrays by linear grouping.

Suffixes start in groups by first symbol. Groups are taken in descending order. For each suffix i of the group in hand, with
common prefix u, the pointer prev(i) leads to the nearest place before i whose suffix lies in a lower group; that suffix's
Lyndon prefix is longer by u than known so far, once for each i that points to it, so it moves to a new group
right above its old one, the higher the more pointers it has. When all groups have been taken, every suffix is grouped by
its Lyndon prefix and the groups are in order. The suffixes are then written in ascending order: each one written places
the unplaced suffixes on the chain of pointers before it at the front of their groups. Nothing is renamed or recursed into.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence


def grouped(text: Sequence[int]) -> tuple[list[list[int]], array]:
    """Groups of suffixes by Lyndon prefix, lowest first, and the pointers; text[i] >= 0, and -1 is the end's pointer."""
    n = len(text)
    first: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        if c in first:
            first[c].append(i)
        else:
            first[c] = [i]
    members = [first[c] for c in sorted(first)]
    group = array("q", bytes(8 * n))
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    below = array("q", range(-1, len(members) - 1))  # the group right below each, -1 for none
    above = array("q", range(1, len(members) + 1))
    size = array("q", map(len, members))
    top = len(members) - 1
    prev = array("q", [-1]) * n
    open_ = bytearray(b"\1") * n
    done: list[list[int]] = []

    def parted(own: list[int], h: int) -> None:
        """Moves some of a group's suffixes to a new group right above it; the group in hand is higher still."""
        new, up = len(members), above[h]
        members.append(own)
        for j in own:
            group[j] = new
        size[h] -= len(own)
        size.append(len(own))
        below.append(h)
        above.append(up)
        above[h] = below[up] = new

    while top >= 0:
        own = members[top]
        if size[top] < len(own):
            own = [i for i in own if group[i] == top]
        members[top] = []
        if len(own) == 1:
            i = own[0]
            done.append(own)
            open_[i] = 0
            j = i - 1
            while j >= 0 and not open_[j]:
                j = prev[j]
            prev[i] = j
            if j >= 0 and size[group[j]] > 1:
                parted([j], group[j])
        elif own:
            own.sort()
            done.append(own)
            for i in own:
                open_[i] = 0
            votes: dict[int, int] = {}
            for i in own:
                j = i - 1
                while j >= 0 and not open_[j]:
                    j = prev[j]
                prev[i] = j
                if j >= 0:
                    votes[j] = votes.get(j, 0) + 1
            # The new groups by votes and old group, the most votes first. What is left of a group alone stays in it.
            moved: dict[tuple[int, int], list[int]] = {}
            for j, k in votes.items():
                t = (k, group[j])
                if t in moved:
                    moved[t].append(j)
                else:
                    moved[t] = [j]
            for t in sorted(moved, reverse=True):
                if len(moved[t]) < size[t[1]]:
                    parted(moved[t], t[1])
        top = below[top]
        if top >= 0:
            above[top] = -1
    done.reverse()
    return done, prev


def suffix_array(text: Sequence[int]) -> array:
    """Starts of all suffixes of a text in ascending order; symbols are integers of at least 0."""
    n = len(text)
    if not n:
        return array("q")
    groups, prev = grouped(text)
    slot = array("q", bytes(8 * len(groups)))  # the next free place of each group
    number = array("q", bytes(8 * n))
    at = 0
    for g, own in enumerate(groups):
        slot[g] = at
        for i in own:
            number[i] = g
        at += len(own)
    del groups
    out = array("q", bytes(8 * n))
    j = n - 1  # the chain before the end of the text
    rank = 0
    while True:
        while j >= 0 and number[j] >= 0:
            g = number[j]
            out[slot[g]] = j
            slot[g] += 1
            number[j] = -1
            j = prev[j]
        if rank == n:
            return out
        j = out[rank] - 1
        rank += 1
