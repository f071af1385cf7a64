"""Burkhard-Keller trees over 64-bit fingerprints, one per shard, laid out as flat arrays.

A shard holds the fingerprints that agree on two blocks of their bits. Two fingerprints at most r bits apart leave
at least two of r + 2 blocks untouched, so every link shows in at least one shard. All trees of a task are built and walked together, level by level: a frontier of (query, node) pairs takes the place of the
recursion, and a child is followed only if its edge lies within the radius of the query's distance to the node.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: (query, node) pairs that one step of a walk holds at most, besides the children of a single step.
CHUNK = 1 << 19


def block_masks(radius: int) -> list[int]:
    """Bit masks of all pairs of ``radius`` + 2 blocks; a fingerprint belongs to one shard of each pair."""
    edges = [round(64 * k / (radius + 2)) for k in range(radius + 3)]
    block = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [a | b for a, b in combinations(block, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class _Union:
    """Union-find over positions; the smaller root wins."""

    def __init__(self, labels: np.ndarray):
        self.up = labels.copy()

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            nxt = up[up]
            if np.array_equal(nxt, up):
                return up
            up[:] = nxt


class Forest:
    """The trees of all shards of a task. ``group`` names the shard of each item; ``items`` are in level order."""

    def __init__(self, group: np.ndarray, fps: np.ndarray):
        order = np.argsort(group, kind="stable")
        g = np.unique(group[order], return_inverse=True)[1].astype(np.int64)
        self.n = len(fps)
        items, parent, edge, level_of = [], [], [], []
        up = np.full(self.n, -1, np.int64)
        dist = np.zeros(self.n, np.int64)
        placed = 0
        while len(order):
            first = np.r_[True, g[1:] != g[:-1]]
            heads = order[first]
            node = placed + np.cumsum(first) - 1
            items.append(heads), parent.append(up[first]), edge.append(dist[first])
            level_of.append((placed, placed + len(heads)))
            placed += len(heads)
            rest = ~first
            d = np.bitwise_count(fps[order[rest]] ^ fps[heads][np.cumsum(first)[rest] - 1]).astype(np.int64)
            by = np.lexsort((d, node[rest]))
            order, up, dist = order[rest][by], node[rest][by], d[by]
            g = up * 65 + dist
        self.items = np.concatenate(items) if items else np.zeros(0, np.int64)
        self.parent = np.concatenate(parent) if parent else np.zeros(0, np.int64)
        self.edge = np.concatenate(edge) if edge else np.zeros(0, np.int64)
        self.levels = level_of
        self.fps = fps[self.items]
        self.count = np.bincount(self.parent[self.parent >= 0], minlength=self.n)[: self.n]
        self.start = np.searchsorted(np.where(self.parent < 0, -1, self.parent), np.arange(self.n))
        self.root = np.arange(self.n)
        for lo, hi in self.levels[1:]:
            self.root[lo:hi] = self.root[self.parent[lo:hi]]

    def links(self, radius: int, labels: np.ndarray, refused=None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of items within ``radius`` that join all that can be joined: a spanning forest of the link graph.

        ``labels``: positions of equal label are joined already. ``refused(i, j)``: True where a pair must not be used;
        asked only of pairs that would join two classes.
        Subtrees that lie wholly in the query's own class are not walked: they can add no link between classes.
        """
        items, fps = self.items, self.fps
        first = np.unique(labels[items], return_index=True)
        union = _Union(first[1][np.searchsorted(first[0], labels[items])])
        out_i, out_j = [], []

        def take(a: np.ndarray, b: np.ndarray) -> None:
            while len(a):
                r = union.roots()
                ra, rb = r[a], r[b]
                apart = ra != rb
                a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
                if not len(a):
                    return
                pick = np.unique(np.minimum(ra, rb) * self.n + np.maximum(ra, rb), return_index=True)[1]
                no = np.zeros(len(pick), bool) if refused is None else refused(items[a[pick]], items[b[pick]])
                for x, y in zip(a[pick[~no]].tolist(), b[pick[~no]].tolist()):
                    if union.join(x, y):
                        out_i.append(x), out_j.append(y)
                left = np.ones(len(a), bool)
                left[pick] = False
                a, b = a[left], b[left]

        child = np.flatnonzero((self.parent >= 0) & (self.edge <= radius))
        take(child, self.parent[child])
        at, some, known = 0, 256, -1
        while at < self.n:
            if known != len(out_i):  # classes grew: more subtrees may be uniform
                known, own = len(out_i), union.roots().copy()
                low, high = own.copy(), own.copy()
                for lo, hi in reversed(self.levels[1:]):
                    np.minimum.at(low, self.parent[lo:hi], low[lo:hi])
                    np.maximum.at(high, self.parent[lo:hi], high[lo:hi])
            q = np.arange(at, min(at + some, self.n))
            at, some = at + some, min(2 * some, CHUNK)
            stack = [(q, self.root[q])]
            while stack:
                q, node = stack.pop()
                live = (low[node] != own[q]) | (high[node] != own[q])
                q, node = q[live], node[live]
                if not len(q):
                    continue
                d = np.bitwise_count(fps[q] ^ fps[node]).astype(np.int64)
                hit = (d <= radius) & (q != node)
                take(q[hit], node[hit])
                n = self.count[node]
                fan = np.repeat(np.arange(len(q)), n)
                kid = np.repeat(self.start[node] - np.cumsum(n) + n, n) + np.arange(len(fan))
                near = np.abs(self.edge[kid] - d[fan]) <= radius
                q, node = q[fan[near]], kid[near]
                stack += [(q[k : k + CHUNK], node[k : k + CHUNK]) for k in range(0, len(q), CHUNK)]
        return items[np.array(out_i, np.int64)], items[np.array(out_j, np.int64)]
