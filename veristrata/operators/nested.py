"""Nested sets of whole hierarchies in one task: sizes upward, preorder ranges downward, and what ranges do not hold.

A block is any number of hierarchies over nodes 0..n-1. Records on cycles stand as tops, every other
record below its smallest parent; that forest has one range for each node. Links to further parents
and links of records on cycles are not in it: what they add to the records below a node is a list of
further ranges, handed upward from child to parent. All descendants of a node are its ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ROWS_AT_ONCE = 200_000


def _adjacent(n: int, of: np.ndarray, what: np.ndarray) -> list[list[int]]:
    """what[] gathered by of[], each list in order."""
    order = np.lexsort((what, of))
    ends = np.cumsum(np.bincount(of, minlength=n))
    flat = what[order].tolist()
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _peel(nodes: list[int], degree: list[int], onward: list[list[int]]) -> list[int]:
    """Nodes in the order in which their degree falls to 0, as each one taken lowers that of its ``onward`` nodes."""
    taken = [v for v in nodes if degree[v] == 0]
    for v in taken:
        for w in onward[v]:
            degree[w] -= 1
            if degree[w] == 0:
                taken.append(w)
    return taken


def _knots(core: list[int], onward: list[list[int]]) -> Iterator[list[int]]:
    """Strongly connected components of the core (Tarjan, without recursion)."""
    inside = set(core)
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    open_: list[int] = []
    held: set[int] = set()
    for first in core:
        if first in number:
            continue
        number[first] = low[first] = len(number)
        open_.append(first)
        held.add(first)
        walk = [(first, iter(onward[first]))]
        while walk:
            v, rest = walk[-1]
            for w in rest:
                if w not in inside:
                    continue
                if w not in number:
                    number[w] = low[w] = len(number)
                    open_.append(w)
                    held.add(w)
                    walk.append((w, iter(onward[w])))
                    break
                if w in held:
                    low[v] = min(low[v], number[w])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
                if low[v] == number[v]:
                    part = []
                    while True:
                        w = open_.pop()
                        held.discard(w)
                        part.append(w)
                        if w == v:
                            break
                    yield part


class NestedSets:
    """The nested sets of a block; ``child`` and ``parent`` are its distinct links, numbers follow the order of ids.

    cycle: smallest record of the node's cycle, or -1; up: the parent in the forest, or -1; pos,
    size: the range [pos, pos + size) of the node; order: node at each position; depth, top: of the
    forest; extra: node (or smallest record of a cycle) -> further ranges, which do not overlap.
    """

    def __init__(self, n: int, child: np.ndarray, parent: np.ndarray) -> None:
        self.n = n
        loops = np.unique(child[child == parent]).tolist()
        real = child != parent
        child, parent = child[real], parent[real]
        self.parents, self.children = _adjacent(n, child, parent), _adjacent(n, parent, child)
        self._find_cycles(loops)
        self._place()
        self._extend(child, parent)

    def _find_cycles(self, loops: list[int]) -> None:
        """Nodes that peeling from the tops and then from below leaves unprocessed hold all cycles."""
        n, cycle = self.n, [-1] * self.n
        done = set(_peel(list(range(n)), [len(p) for p in self.parents], self.children))
        left = [v for v in range(n) if v not in done]
        if left:
            below = _peel(left, [sum(1 for c in self.children[v] if c not in done) for v in range(n)], [[p for p in self.parents[v] if p not in done] if v not in done else [] for v in range(n)])
            gone = done.union(below)
            for part in _knots([v for v in left if v not in gone], self.children):
                if len(part) > 1:
                    name = min(part)
                    for v in part:
                        cycle[v] = name
        for v in loops:
            if cycle[v] < 0:
                cycle[v] = v
        self.cycle = cycle
        self.members: dict[int, list[int]] = {}
        for v in range(n):
            if cycle[v] >= 0:
                self.members.setdefault(cycle[v], []).append(v)

    def _place(self) -> None:
        """Subtree sizes are summed upward, then ranges given downward by prefix sums over siblings."""
        n = self.n
        self.up = up = [-1 if c >= 0 or not p else p[0] for c, p in zip(self.cycle, self.parents)]
        kids: list[list[int]] = [[] for _ in range(n)]
        for v, p in enumerate(up):
            if p >= 0:
                kids[p].append(v)
        level = [v for v in range(n) if up[v] < 0]
        for v in level:
            level.extend(kids[v])
        size = [1] * n
        for v in reversed(level):
            if up[v] >= 0:
                size[up[v]] += size[v]
        pos, free, depth, top = [0] * n, [0] * n, [0] * n, list(range(n))
        at = 0
        for v in level:
            p = up[v]
            if p < 0:
                pos[v], at = at, at + size[v]
            else:
                pos[v] = free[p]
                free[p] += size[v]
                depth[v], top[v] = depth[p] + 1, top[p]
            free[v] = pos[v] + 1
        self.pos, self.size, self.depth, self.top = pos, size, depth, top
        self.order = np.empty(n, dtype=np.int64)
        self.order[pos] = np.arange(n)

    def _extend(self, child: np.ndarray, parent: np.ndarray) -> None:
        """Further ranges of every node, from the lowest nodes upward; nested ones are dropped."""
        stands = np.array([c if c >= 0 else v for v, c in enumerate(self.cycle)], dtype=np.int64) if self.n else np.zeros(0, dtype=np.int64)
        above, below = stands[parent], stands[child]
        apart = above != below
        above, below = above[apart], below[apart]
        stand = stands.tolist()
        nodes = np.unique(stands).tolist()
        onward = _adjacent(self.n, below, above)
        degree = np.bincount(above, minlength=self.n).tolist()
        extra: dict[int, list[tuple[int, int]]] = {}
        pos, size, up, cycle = self.pos, self.size, self.up, self.cycle
        for v in _peel(nodes, degree, onward):  # children come before their parents
            found: set[tuple[int, int]] = set()
            for m in self.members.get(v, (v,)):
                for c in self.children[m]:
                    if stand[c] != v:
                        if up[c] != m:
                            found.add((pos[c], pos[c] + size[c]))
                        if (more := extra.get(stand[c])) is not None:
                            found.update(more)
                if cycle[m] >= 0:
                    found.add((pos[m], pos[m] + size[m]))
            if found:
                low, high = (pos[v], pos[v] + size[v]) if cycle[v] < 0 else (0, 0)
                kept: list[tuple[int, int]] = []
                for a, b in sorted(found, key=lambda r: (r[0], -r[1])):
                    if not (low <= a and b <= high) and (not kept or a >= kept[-1][1]):
                        kept.append((a, b))
                if kept:
                    extra[v] = kept
        self.extra = extra

    def ranges(self, nodes: list[int] | range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, low, high): positions of all descendants of ``nodes``; a record on a cycle is its own descendant."""
        who, low, high = [], [], []
        for v in nodes:
            c = self.cycle[v]
            if c < 0 and self.size[v] > 1:
                who.append(v)
                low.append(self.pos[v] + 1)
                high.append(self.pos[v] + self.size[v])
            for a, b in self.extra.get(c if c >= 0 else v, ()):
                who.append(v)
                low.append(a)
                high.append(b)
        return np.array(who, dtype=np.int64), np.array(low, dtype=np.int64), np.array(high, dtype=np.int64)

    def tops(self) -> list[int]:
        """Records without parents, and the smallest record of each cycle."""
        return [v for v in range(self.n) if self.cycle[v] == v or (self.cycle[v] < 0 and not self.parents[v])]

    def descendants(self, nodes: list[int] | range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ancestor, descendant) read off the ranges of ``nodes``, some rows at a time."""
        who, low, high = self.ranges(nodes)
        ends = np.cumsum(high - low)
        total, a = int(ends[-1]) if len(ends) else 0, 0
        for start in range(0, total, ROWS_AT_ONCE):
            at = np.arange(start, min(total, start + ROWS_AT_ONCE))
            r = np.searchsorted(ends, at, side="right")
            yield who[r], self.order[high[r] - (ends[r] - at)]

    def path(self, v: int) -> list[int]:
        """Nodes from the top to ``v``."""
        out = [v]
        while self.up[out[-1]] >= 0:
            out.append(self.up[out[-1]])
        return out[::-1]
