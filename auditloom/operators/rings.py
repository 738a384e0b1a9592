"""Longest paths in a graph with rings, for one bounded part of it: what a task does with the edges that it gets.

A path visits nodes once; an edge that leads back to a visited one counts once more
and ends it. Between rings (strongly connected nodes) that is one pass from the
ends upwards. Inside a ring, a path leaves a block (nodes that no single node
separates) at a separating node and never comes back, so blocks are searched one by
one: one that is a plain circle by going round it, others by their sets of visited nodes,
as many as ``STATES``. A ring beyond that has no depth: None, as has what depends on it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np

#: (node, visited nodes) that are searched for one ring.
STATES = 200_000


class TooMany(Exception):
    """A ring has more states than may be searched."""


def longest(edges: dict[str, set[str]], given: dict[str, int | None] | None = None) -> dict[str, int | None]:
    """The longest path from each node that has edges; ``given`` holds what is known of nodes beyond this part."""
    nodes = set(edges) | {d for own in edges.values() for d in own}
    order, ring_of = strong(nodes, edges)
    members: dict[int, list[str]] = {}
    for node in order:
        members.setdefault(ring_of[node], []).append(node)
    depth: dict[str, int | None] = dict(given or {})
    for ring in sorted(members):  # rings are numbered from the ends upwards
        own = members[ring]
        if own[0] in depth and len(own) == 1:
            continue
        inside = set(own)
        targets = {n: [depth[d] for d in edges.get(n, ()) if d not in inside] for n in own}
        if any(x is None for found in targets.values() for x in found):
            depth |= dict.fromkeys(own)
        else:
            leave = {n: max((1 + x for x in found), default=0) for n, found in targets.items()}
            depth |= round_ring(own, {n: edges.get(n, set()) & inside for n in own}, leave)
    return {n: depth[n] for n in edges}


def round_ring(own: list[str], edges: dict[str, set[str]], leave: dict[str, int]) -> dict[str, int | None]:
    """The longest path from each member of one ring; ``leave`` is the longest one that leaves the ring at once."""
    if len(own) == 1:
        return {own[0]: max(leave[own[0]], 1 if own[0] in edges[own[0]] else 0)}
    search = _Search(own, edges, leave)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 4 * len(own) + 1000))
    try:
        return {n: search.onward(n, -1) for n in own}
    except TooMany:
        return dict.fromkeys(own)
    finally:
        sys.setrecursionlimit(limit)


class _Search:
    """The blocks of one ring and the longest ways on from their nodes."""

    def __init__(self, own: list[str], edges: dict[str, set[str]], leave: dict[str, int]):
        self.leave, self.states = leave, 0
        self.blocks = [sorted(b) for b in blocks(own, edges)]
        self.of: dict[str, list[int]] = {n: [] for n in own}
        for k, block in enumerate(self.blocks):
            for n in block:
                self.of[n].append(k)
        self.inside = [{n: [d for d in sorted(edges[n]) if d in found] for n in block} for block in self.blocks for found in [set(block)]]
        self.known: dict[tuple[str, int], int] = {}
        self.round: dict[int, tuple[dict[str, int], dict[str, int]]] = {}

    def onward(self, node: str, last: int) -> int:
        """The longest way on from ``node`` outside the block ``last``."""
        if (node, last) not in self.known:
            self.known[node, last] = max(self.leave[node], *(self.through(node, k) for k in self.of[node] if k != last), 0)
        return self.known[node, last]

    def through(self, start: str, k: int) -> int:
        """The longest way on from ``start`` into block ``k``."""
        block, inside = self.blocks[k], self.inside[k]
        if all(len(x) == 1 for x in inside.values()):
            return self.circle(start, k)
        place = {n: i for i, n in enumerate(block)}
        end = {n: 0 if n == start else self.onward(n, k) for n in block}
        walked: dict[tuple[str, int], int] = {}

        def on(node: str, seen: int) -> int:
            if (node, seen) not in walked:
                self.states += 1
                if self.states > STATES:
                    raise TooMany
                best = end[node]
                for d in inside[node]:
                    best = max(best, 1 if seen >> place[d] & 1 else 1 + on(d, seen | 1 << place[d]))
                walked[node, seen] = best
            return walked[node, seen]

        return on(start, 1 << place[start])

    def circle(self, start: str, k: int) -> int:
        if k not in self.round:
            way = [self.blocks[k][0]]
            while (after := self.inside[k][way[-1]][0]) != way[0]:
                way.append(after)
            self.states += len(way)
            self.round[k] = {n: i for i, n in enumerate(way)}, {}
        place, ends = self.round[k]
        if len(ends) < len(place):  # the start's own way out does not count, so it need not be known
            for n in place:
                if n != start and n not in ends:
                    ends[n] = self.onward(n, k)
        values = np.array([ends.get(n, 0) for n in place])
        onward = np.roll(values, -place[start] - 1)[:-1] + np.arange(1, len(place))
        return max(len(place), int(onward.max()))


def blocks(own: list[str], edges: dict[str, set[str]]) -> Iterator[set[str]]:
    """The parts of a connected graph that no single node separates, whatever the edges' direction. No recursion."""
    near: dict[str, set[str]] = {n: set() for n in own}
    for a, found in edges.items():
        for b in found - {a}:
            near[a].add(b)
            near[b].add(a)
    number = {own[0]: 0}
    low = {own[0]: 0}
    path: list[tuple[str, str]] = []
    stack = [(own[0], "", iter(sorted(near[own[0]])))]
    while stack:
        node, parent, targets = stack[-1]
        for d in targets:
            if d not in number:
                number[d] = low[d] = len(number)
                path.append((node, d))
                stack.append((d, node, iter(sorted(near[d]))))
                break
            if d != parent and number[d] < number[node]:
                path.append((node, d))
                low[node] = min(low[node], number[d])
        else:
            stack.pop()
            if stack:
                low[parent] = min(low[parent], low[node])
                if low[node] >= number[parent]:
                    found: set[str] = set()
                    while True:
                        edge = path.pop()
                        found |= set(edge)
                        if edge == (parent, node):
                            break
                    yield found


def strong(nodes: set[str], edges: dict[str, set[str]]) -> tuple[list[str], dict[str, int]]:
    """Nodes in the order in which their ring is complete, and each one's ring; a ring's targets have smaller numbers. No recursion."""
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    ring_of: dict[str, int] = {}
    order: list[str] = []
    held: list[str] = []
    for start in sorted(nodes):
        if start in number:
            continue
        number[start] = low[start] = len(number)
        held.append(start)
        stack = [(start, iter(sorted(edges.get(start, ()))))]
        while stack:
            node, targets = stack[-1]
            for target in targets:
                if target not in number:
                    number[target] = low[target] = len(number)
                    held.append(target)
                    stack.append((target, iter(sorted(edges.get(target, ())))))
                    break
                if target not in ring_of:
                    low[node] = min(low[node], number[target])
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[node])
                if low[node] == number[node]:
                    ring = ring_of[order[-1]] + 1 if order else 0
                    while True:
                        member = held.pop()
                        ring_of[member] = ring
                        order.append(member)
                        if member == node:
                            break
    return order, ring_of
