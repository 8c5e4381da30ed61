"""Exact Jaccard joins of the sets of a region, in memory.

Jaccard distance is a metric, so the distances to a pivot p bound those between two sets: no less than the
difference and no more than the sum. A region of many sets is divided into the Voronoi cells of some pivots: each
set is at home in the cell of its nearest pivot, and visits each cell of lower number whose pivot is no further from
it than its nearest one and twice the radius. Every linked pair then has a cell in which one is at home and the other
at home or visiting, and only one such cell. Cells are divided again; small ones are compared set by set, leaving
out the pairs that the bounds decide.
"""

from __future__ import annotations

import numpy as np

PERCENT = 70
PIVOTS = 16
SMALL = 160
EPS = 1e-9


def linked(i: np.ndarray, n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray:
    """Of the sizes of an intersection and of both sets."""
    return 100 * i >= PERCENT * (n + m - i)


class Region:
    """sets: sorted arrays of distinct numbers. weights: how many documents each stands for. Pairs are those of which one
    is at_home and, where sides are given, that are on different ones.

    counts[k] becomes the weight of the sets linked with set k, and label[k] the least number of a set that it reaches.
    """

    def __init__(self, sets: list[np.ndarray], weights: np.ndarray, at_home: np.ndarray, side: np.ndarray | None = None) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, bool)
        ids = np.empty(len(flat), np.int32)
        ids[order] = np.cumsum(new) - 1
        shared = np.bincount(ids)[ids] > 1 if len(ids) else np.zeros(0, bool)  # others never count
        del flat, order, ordered
        of = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)[shared]
        self.ids, ends = ids[shared], np.cumsum(np.bincount(of, minlength=len(sets)))
        self.starts, self.ends = np.r_[0, ends[:-1]], ends
        self.mark = np.zeros(int(new.sum()) + 1, bool)
        self.weights, self.home, self.side = weights.astype(np.int64), at_home, side
        self.counts = np.zeros(len(sets), np.int64)
        self.label = np.arange(len(sets))
        self.compared = 0

    def _link(self, k: int, others: np.ndarray) -> None:
        if len(others):
            self.counts[k] += self.weights[others].sum()
            self.counts[others] += self.weights[k]
            labels = self.label[others]
            if (labels != self.label[k]).any():
                labels = np.unique(np.append(labels, self.label[k]))
                self.label[np.isin(self.label, labels)] = labels[0]

    def _flat(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the members' sets one after another, and where each ends."""
        n = self.ends[members] - self.starts[members]
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[members] - np.r_[0, ends[:-1]], n)
        return self.ids[at], ends

    def _shared(self, k: int, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The sizes of set k's intersections with sets laid out by _flat."""
        own = self.ids[self.starts[k] : self.ends[k]]
        self.mark[own] = True
        sums = np.r_[0, np.cumsum(self.mark[flat], dtype=np.int32)][np.r_[0, ends]]
        self.mark[own] = False
        self.compared += len(ends)
        return np.diff(sums)

    def join(self) -> None:
        everyone = np.arange(len(self.sizes))
        self._divide(everyone[self.home], everyone[~self.home], 0)

    def _divide(self, home: np.ndarray, visiting: np.ndarray, depth: int) -> None:
        if len(home) == 0 or len(home) + len(visiting) < 2:
            return
        if len(home) <= SMALL or depth > 12:
            self._compare(home, visiting, None)
            return
        members = np.concatenate([home, visiting])
        flat, ends = self._flat(members)
        pivots = home[np.linspace(0, len(home) - 1, PIVOTS).astype(int)]
        distance = np.empty((len(members), PIVOTS))
        for j, p in enumerate(pivots.tolist()):
            i = self._shared(p, flat, ends)
            distance[:, j] = 1 - i / np.maximum(1, self.sizes[members] + self.sizes[p] - i)
        nearest = distance.argmin(axis=1)
        close = distance <= distance.min(axis=1)[:, None] + 2 * (1 - PERCENT / 100) + EPS
        resident = np.arange(len(members)) < len(home)
        cells, pairs = [], 0
        for j in range(PIVOTS):
            h, v = resident & (nearest == j), close[:, j] & (~resident | (nearest > j))
            n, m = int(h.sum()), int(v.sum())
            pairs += n * (n // 2 + m)
            cells.append((h, v))
        if pairs > 0.8 * len(home) * (len(home) / 2 + len(visiting)):  # these pivots don't divide the region
            best = int(np.bincount(nearest[resident], minlength=PIVOTS).argmax())
            self._compare(home, visiting, distance[:, best])
            return
        for j, (h, v) in enumerate(cells):
            n = int(h.sum())
            if n and n <= SMALL or n > 0.8 * len(home):
                self._compare(members[h], members[v], np.concatenate([distance[h, j], distance[v, j]]))
            elif n:
                self._divide(members[h], members[v], depth + 1)

    def _compare(self, home: np.ndarray, visiting: np.ndarray, distance: np.ndarray | None) -> None:
        """All pairs of home, and of home and visiting. distance: of each to one pivot, which decides some pairs."""
        members = np.concatenate([home, visiting])
        radius = 1 - PERCENT / 100
        order = np.argsort(self.sizes[members], kind="stable")
        members, is_home = members[order], (np.arange(len(members)) < len(home))[order]
        distance = None if distance is None else distance[order]
        sizes = self.sizes[members]
        flat, ends = self._flat(members)
        begins = np.r_[0, ends[:-1]]
        last = np.searchsorted(100 * sizes, 100 * (100 * sizes // PERCENT), side="right")  # no set beyond these sizes is linked
        for a in range(len(members) - 1):
            b = int(last[a])
            if b <= a + 1:
                continue
            ask = is_home[a + 1 : b] if not is_home[a] else np.ones(b - a - 1, bool)
            if self.side is not None:
                ask = ask & (self.side[members[a + 1 : b]] != self.side[members[a]])
            sure = np.zeros(b - a - 1, bool)
            if distance is not None:
                d = distance[a + 1 : b]
                sure = ask & (d + distance[a] <= radius - EPS)
                ask = ask & ~sure & (np.abs(d - distance[a]) <= radius + EPS)
            hit = sure
            if ask.any():
                k, lo, hi = int(members[a]), int(begins[a + 1]), int(ends[b - 1])
                if ask.mean() < 0.3:
                    some = np.flatnonzero(ask) + a + 1
                    i = self._shared(k, *self._flat(members[some]))
                    hit = sure.copy()
                    hit[some[linked(i, sizes[some], int(sizes[a]))] - a - 1] = True
                else:
                    i = self._shared(k, flat[lo:hi], ends[a + 1 : b] - lo)
                    hit = sure | (ask & linked(i, sizes[a + 1 : b], int(sizes[a])))
            self._link(int(members[a]), members[a + 1 : b][hit])
