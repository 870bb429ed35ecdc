"""Scans over numbers of clusters of one ensemble.

From k to the next number only one more starting centre comes in, and what it changes stays near it.
Labels and silhouettes are therefore carried from k to k, round by round: a point meets the centres that
moved, and all of them only where its own went away. Distances that decide are summed from the gaps, and
are those of a run from scratch; products of matrices only rule out what lies beyond their rounding.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)
FEW = 8                   # centres fewer than these meet all points at little cost


class _Points:
    """Points about a middle, near which squared distances by matrix products lose little."""

    def __init__(self, points: np.ndarray, room: int):
        self.x, self.room = points, room
        middle = points.mean(axis=0)
        spread = ((points - middle) ** 2).sum(axis=1)
        self.middle = middle if (middle * middle).sum() > spread.mean() else None
        self.about = self.centred(points)
        self.sq = (self.about * self.about).sum(axis=1)
        self.tol = 16 * (points.shape[1] + 4) * EPS
        self.left = np.hstack([self.about, np.ones((len(points), 1)), self.sq[:, None]])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return x if self.middle is None else x - self.middle

    def products(self, at: np.ndarray | None, centres: np.ndarray):
        """Blocks of (places, squared distances from all centres by matrix products, their rounding at most) of the
        points at ``at``, by default of all."""
        about = self.centred(centres)
        sq = np.einsum("ij,ij->i", about, about)
        n, most = len(self.x) if at is None else len(at), sq.max()
        step = max(1, self.room // (32 * len(centres)))
        for lo in range(0, n, step):
            here = np.arange(lo, min(n, lo + step)) if at is None else at[lo:lo + step]
            g = self.about[here] @ about.T
            g *= -2.0
            g += sq
            g += self.sq[here, None]
            yield here, g, self.tol * (self.sq[here] + most)

    def within(self, at: np.ndarray | None, centres: np.ndarray, limits: np.ndarray):
        """Pairs of points and centres that may lie within the points' limits, squared distances, by one matrix
        product. The pairs of a point come together. Points too far from all centres' middle are left out before."""
        about = self.centred(centres)
        sq = np.einsum("ij,ij->i", about, about)
        most, m = sq.max(), len(about)
        if at is None and m >= FEW:
            ball = about.mean(axis=0)
            own = float(ball @ ball)
            reach = np.sqrt(np.maximum(limits, 0.0))
            reach += np.sqrt(np.einsum("ij,ij->i", about - ball, about - ball).max())
            reach *= reach * (1 + 1e-9)
            away = self.about @ (-2.0 * ball)
            away += (1 - self.tol) * self.sq
            some = np.flatnonzero(away <= reach - (own - self.tol * (own + most)))
            at = some if 2 * len(some) < len(self.x) else None
        right = np.vstack([-2.0 * about.T, sq, np.ones(m)])
        n = len(self.x) if at is None else len(at)
        step = max(1, min(self.room, 1 << 20) // (8 * m))
        for lo in range(0, n, step):
            here = slice(lo, lo + step) if at is None else at[lo:lo + step]
            left = self.left[here]
            left[:, -1] = self.sq[here] * (1 - self.tol) - limits[here] - self.tol * most
            i, j = np.divmod(np.flatnonzero((left @ right).ravel() <= 0.0), m)
            yield (i + lo if at is None else here[i]), j

    def gaps(self, i: np.ndarray, others: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Squared distances of pairs."""
        out = np.empty(len(i))
        step = max(1, self.room // (16 * self.x.shape[1]))
        for lo in range(0, len(i), step):
            gap = self.x[i[lo:lo + step]] - others[j[lo:lo + step]]
            out[lo:lo + step] = (gap * gap).sum(-1)
        return out


def _least(i: np.ndarray, value: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of the least value of each i, of the lowest j on ties."""
    by = np.lexsort((j, value, i))
    return by[np.flatnonzero(np.diff(i[by], prepend=-1))]


def _touched(was: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Clusters that points left or joined."""
    changed = np.flatnonzero(was != labels)
    return np.unique(np.concatenate([was[changed], labels[changed]]))


class Labels:
    """Labels of Lloyd's k-means from the first k points in an order, for one k after the other, rising. An
    emptied cluster keeps its centre. Rounds of the last k are kept as far as they fit ``kept`` bytes."""

    def __init__(self, points: _Points, order: np.ndarray, most: int, max_iter: int, kept: int):
        self.p, self.max_iter, self.k = points, max_iter, 0
        self.first = np.argsort(order, kind="stable")[:most]
        n, d = points.x.shape
        self.most = (most, d)
        self.fits = kept // (12 * n + 8 * most * d)
        self.rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _nearest(self, at: np.ndarray | None, centres: np.ndarray):
        for here, g, slack in self.p.products(at, centres):
            i, j = np.divmod(np.flatnonzero((g <= (g.min(axis=1) + slack)[:, None]).ravel()), len(centres))
            i = here[i]
            value = self.p.gaps(i, centres, j)
            best = _least(i, value, j)
            yield i[best], j[best], value[best]

    def _assign(self, labels: np.ndarray, dist: np.ndarray, centres: np.ndarray, moved: np.ndarray) -> np.ndarray:
        """Nearest centres, in place, where they were nearest before ``moved`` ones moved or came in. Returns the
        clusters that points left or joined."""
        if not len(moved):
            return moved
        p, was, whole = self.p, labels.copy(), 2 * len(moved) > len(centres)
        far = None
        if not whole:
            went = np.zeros(len(centres), dtype=bool)
            went[moved] = True
            own = np.flatnonzero(went[labels])
            value = p.gaps(own, centres, labels[own])
            # centres that stayed are not nearer than before, nor is one as near and lower
            far = own[value > dist[own]]
            dist[own] = value
            limits = dist.copy()
            limits[far] = -np.inf
            for i, j in p.within(None, centres[moved], limits):
                c = moved[j]
                value = p.gaps(i, centres, c)
                nearer = np.flatnonzero((value < dist[i]) | ((value == dist[i]) & (c < labels[i])))
                best = nearer[_least(i[nearer], value[nearer], c[nearer])]
                labels[i[best]], dist[i[best]] = c[best], value[best]
        if whole or len(far):
            for i, j, value in self._nearest(far, centres):
                labels[i], dist[i] = j, value
        return _touched(was, labels)

    def advance(self, k: int) -> np.ndarray:
        """Labels for ``k`` clusters. They are to be read before the next call."""
        x, n = self.p.x, len(self.p.x)
        last = before = touched = None
        for r in range(self.max_iter):
            kept = r < len(self.rounds)
            if kept:
                labels, dist, centres = self.rounds[r]
            elif r:
                labels, dist, centres = (a.copy() for a in last)
            else:
                labels, dist = np.zeros(n, dtype=np.int32), np.full(n, np.inf)
                centres = np.full(self.most, np.nan)
            if r == 0:
                moved = np.arange(self.k if kept else 0, k)
                centres[moved] = x[self.first[moved]]
            else:
                if kept:                     # what differs from the k before
                    touched = np.union1d(touched, moved)
                elif r == 1:
                    touched = np.arange(k)
                else:                        # what differs from the round before
                    touched = _touched(before[0], last[0])
                now = last[2][touched]
                used, means, _ = means_of(x, last[0], touched, k)
                now[np.searchsorted(touched, used)] = means
                differs = (now != centres[touched]).any(axis=1)
                moved = touched[differs]
                centres[moved] = now[differs]
            if kept and r > 1 and len(moved) > FEW:
                # the round before may be nearer than the k before
                still = _touched(before[0], last[0])
                still = still[(centres[still] != last[2][still]).any(axis=1)]
                if 2 * len(still) < len(moved):
                    was, labels, dist = labels, last[0].copy(), last[1].copy()
                    self._assign(labels, dist, centres[:k], still)
                    touched = _touched(was, labels)
                    self.rounds[r] = labels, dist, centres
                else:
                    touched = self._assign(labels, dist, centres[:k], moved)
            else:
                touched = self._assign(labels, dist, centres[:k], moved)
            if not kept and r < self.fits:
                self.rounds.append((labels, dist, centres))
            if r and np.array_equal(labels, last[0]):
                break
            before, last = last, (labels, dist, centres)
        del self.rounds[r + 1:]
        self.k = k
        return labels


def means_of(x: np.ndarray, labels: np.ndarray, clusters: np.ndarray, k: int):
    """(those of ``clusters`` that have members, their means, their sizes). Members add up in their order."""
    asked = np.zeros(k, dtype=bool)
    asked[clusters] = True
    at = np.flatnonzero(asked[labels])
    by = at[np.argsort(labels[at], kind="stable")]
    used, starts, sizes = np.unique(labels[by], return_index=True, return_counts=True)
    if not len(used):
        return used, np.empty((0, x.shape[1])), sizes
    return used, np.add.reduceat(x[by], starts, axis=0) / sizes[:, None], sizes


class Silhouettes:
    """Mean silhouettes of one labelling after the other. A cluster's mean distance from a point is not less than
    its centre's, so few pairs of points and clusters are summed; sums follow the members' order and do not
    depend on the labelling before."""

    def __init__(self, points: _Points, most: int):
        self.p, self.labels = points, None
        n, d = points.x.shape
        self.centres = np.empty((most, d))
        self.a, self.b, self.nearest = np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int32)

    def _sums(self, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Summed distances of points from all members of clusters."""
        out = np.empty(len(i))
        upto = np.cumsum(self.sizes[c])
        room = max(1, self.p.room // (32 * self.p.x.shape[1]))
        lo = 0
        while lo < len(i):
            done = upto[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, done + room, side="right")))
            sizes = self.sizes[c[lo:hi]]
            starts = upto[lo:hi] - sizes - done
            member = np.arange(upto[hi - 1] - done) + np.repeat(self.starts[c[lo:hi]] - starts, sizes)
            square = self.p.gaps(np.repeat(i[lo:hi], sizes), self.p.x, self.members[member])
            out[lo:hi] = np.add.reduceat(np.sqrt(square), starts)
            lo = hi
        return out

    def _lower(self, at: np.ndarray | None, clusters: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Nearest other clusters, where one of ``clusters`` is not farther than ``bound``, one a point. Returns the
        points with one."""
        found = []
        for i, j in self.p.within(at, self.centres[clusters], bound * bound * (1 + 1e-9)):
            c = clusters[j]
            other = c != self.labels[i]
            i, c = i[other], c[other]
            value = self._sums(i, c) / self.sizes[c]
            near = np.flatnonzero(value <= bound[i])
            best = near[_least(i[near], value[near], c[near])]
            self.b[i[best]], self.nearest[i[best]] = value[best], c[best]
            found.append(i[best])
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)

    def score(self, labels: np.ndarray, k: int) -> float:
        """Mean silhouette of labels below ``k``, NaN for a single cluster."""
        x, n = self.p.x, len(labels)
        self.sizes = np.bincount(labels, minlength=k)
        used = np.flatnonzero(self.sizes)
        if len(used) < 2:
            self.labels = None
            return float("nan")
        self.members = np.argsort(labels, kind="stable")
        self.starts = np.cumsum(self.sizes) - self.sizes
        if self.labels is None:
            fresh, touched = True, used
        else:
            fresh, touched = False, _touched(self.labels, labels)
        self.labels = labels.copy()
        present, means, _ = means_of(x, labels, touched, k)
        self.centres[present] = means
        is_touched = np.zeros(k, dtype=bool)
        is_touched[touched] = True
        inside = np.flatnonzero(is_touched[labels])
        self.a[inside] = self._sums(inside, labels[inside]) / np.maximum(self.sizes[labels[inside]] - 1, 1)
        if fresh:
            anew = None
        else:
            lost = is_touched[self.nearest]
            if len(present):
                lost[self._lower(None, present, self.b.copy())] = False
            anew = np.flatnonzero(lost)
        if anew is None or len(anew):
            self._anew(anew, used)
        size, top = self.sizes[labels], np.maximum(self.a, self.b)
        return float(np.where((size > 1) & (top > 0), (self.b - self.a) / np.where(top > 0, top, 1.0), 0.0).mean())

    def _anew(self, at: np.ndarray | None, used: np.ndarray) -> None:
        """Nearest other clusters among all: the one with the nearest centre bounds the others."""
        slot = np.full(len(self.sizes), -1)
        slot[used] = np.arange(len(used))
        for here, g, _ in self.p.products(at, self.centres[used]):
            g[np.arange(len(here)), slot[self.labels[here]]] = np.inf
            self.nearest[here] = used[g.argmin(axis=1)]
        points = np.arange(len(self.labels)) if at is None else at
        c = self.nearest[points]
        self.b[points] = self._sums(points, c) / self.sizes[c]
        self._lower(at, used, self.b.copy())


def scores(points: np.ndarray, order: np.ndarray, ks: list[int], max_iter: int, kept: int, room: int) -> list[float]:
    """Mean silhouettes of k-means from the first points in ``order``, for rising numbers of clusters. ``kept`` bytes
    go to the rounds of the last number, ``room`` to intermediate values."""
    p, most = _Points(points, room), ks[-1]
    labels, silhouettes = Labels(p, order, most, max_iter, kept), Silhouettes(p, most)
    return [silhouettes.score(labels.advance(k), k) for k in ks]
