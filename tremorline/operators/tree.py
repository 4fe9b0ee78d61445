"""A static tree over a catalog in space, time and weight, for the least eta by branch and bound.

A parent is only good if it is near in space, near in time or large, so a node keeps the box of its
events' unit vectors, their first and last moment, the least weight and the largest radius.
``dt * r**d * w`` of these is a lower bound for all events of the node; nodes whose bound exceeds
the least eta that a child knows already are left out with all that is below them.

Arrays only: the tree is built once where the columns are gathered, is broadcast with them, and
a task searches it for many children at once, level by level.
"""

from __future__ import annotations

import numpy as np

from .. import model

#: Events of a leaf; earlier events that every child looks at first; children that are searched together; leaves that are looked at together.
LEAF, FIRST, TOGETHER, BLOCKS = 32, 16, 256, 512
#: Events whose weights lie within this factor share a part of the tree.
WEIGHTS = 10.0
YEAR_US = 1e6 * model.SECONDS_PER_YEAR
#: What rounding may take from a bound.
MARGIN = 1 - 1e-9
#: The whole span of time counts as so many times the widest extent in space when a node is cut, as measured.
SPAN = 2.0


class EventTree:
    """The nodes over a group's events, which are in catalog order: ``side`` has their arrays.

    All leaves but the last of a root are full, and their events' columns stand together, so a leaf is looked at as one row.
    """

    def __init__(self, side, leaf: int = LEAF):
        n = len(side.us)
        span = max(1.0, side.us[-1] - side.us[0]) if n else 1.0
        wide = np.ptp(side.unit, axis=1).max() if n else 0.0
        place = np.vstack([side.unit, (side.us - side.us[:1]) * (SPAN * max(wide, 1e-9) / span)])
        kind = np.floor(np.log(side.weight) / np.log(WEIGHTS)).astype(np.int64)
        order = np.argsort(kind, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(kind[order])) + 1), n] if n else []
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        self.roots, child, at = len(spans), [], 0
        while at < len(spans):  # a node's children stand behind it, next to each other
            a, b = spans[at]
            own = order[a:b]
            if b - a <= leaf:
                own.sort()
                child.append(-1)
            else:
                around = place[:, own]
                axis = int(np.argmax(around.max(axis=1) - around.min(axis=1)))
                middle = leaf * (-(-(b - a) // leaf) // 2)
                order[a:b] = own[np.argpartition(around[axis], middle)]
                child.append(len(spans))
                spans += [(a, a + middle), (a + middle, b)]
            at += 1
        self.child = np.array(child, dtype=np.int64)
        leaves = np.flatnonzero(self.child < 0)
        start, end = np.array(spans, dtype=np.int64).reshape(-1, 2)[leaves].T
        self.number = np.full(len(spans), -1, dtype=np.int64)
        self.number[leaves] = np.arange(len(leaves))
        slot = start[:, None] + np.arange(leaf)
        filled = slot < end[:, None]
        self.event = np.where(filled, order[np.minimum(slot, max(0, n - 1))], n) if n else np.zeros((0, leaf), np.int64)
        column = lambda values, none: np.append(values, none)[self.event]
        self.unit, self.us, self.weight_of = [column(x, 0.0) for x in side.unit], column(side.us, np.inf), column(side.weight, 1.0)
        self.reach_of = None if side.reach is None else column(side.reach, -1.0)
        self.step = n + 1
        self.key = (np.arange(len(leaves))[:, None] * self.step + self.event).ravel()  # ascending, as leaves are in order of time
        self._summarize(filled, leaves)

    def _summarize(self, filled: np.ndarray, leaves: np.ndarray) -> None:
        count = len(self.child)
        self.low, self.high = np.empty((3, count)), np.empty((3, count))
        self.first, self.last, self.weight = np.empty(count), np.empty(count), np.empty(count)
        self.reach = np.full(count, np.inf)
        least, most = (lambda x: np.where(filled, x, np.inf).min(axis=1, initial=np.inf)), (lambda x: np.where(filled, x, -np.inf).max(axis=1, initial=-np.inf))
        for axis in range(3):
            self.low[axis, leaves], self.high[axis, leaves] = least(self.unit[axis]), most(self.unit[axis])
        self.first[leaves], self.last[leaves], self.weight[leaves] = least(self.us), most(self.us), least(self.weight_of)
        if self.reach_of is not None:
            self.reach[leaves] = most(self.reach_of)
        for i in range(count - 1, -1, -1):
            if (k := self.child[i]) >= 0:
                two = slice(k, k + 2)
                self.low[:, i], self.high[:, i] = self.low[:, two].min(axis=1), self.high[:, two].max(axis=1)
                self.first[i], self.last[i], self.weight[i], self.reach[i] = self.first[two].min(), self.last[two].max(), self.weight[two].min(), self.reach[two].max()

    def near(self, side, j: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """A lower bound of the distance in km: a chord to the box, which is no longer than the arc."""
        out = np.zeros(len(j))
        for axis in range(3):
            x = side.unit[axis, j]
            off = np.maximum(np.maximum(self.low[axis, nodes] - x, x - self.high[axis, nodes]), 0)
            out += off * off
        return model.EARTH_RADIUS_KM * np.sqrt(out) * MARGIN


def power(r: np.ndarray, d: float) -> np.ndarray:
    return r * np.sqrt(r) if d == 1.5 else r**d


def search(tree: EventTree, side, at: np.ndarray, d: float, r_min: float, seen: list[int] | None = None, known: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(eta, parent's place, years, km) of the events at the places ``at``; infinite without a parent.

    With ``known``, an eta for each, only parents that reach it are found; the place is -1 where there is none.
    ``seen`` gets the number of distances computed for each batch.
    """
    eta, place = np.full(len(at), np.inf) if known is None else np.nextafter(known, np.inf), np.full(len(at), -1, dtype=np.int64)
    for lo in range(0, len(at), TOGETHER):
        batch = slice(lo, lo + TOGETHER)
        _search(tree, side, at[batch], d, r_min, eta[batch], place[batch], seen, None if known is None else known[batch])
    return eta, place, *side.exact(at, np.maximum(place, 0), d, r_min)[1:]


def _search(tree: EventTree, side, j: np.ndarray, d: float, r_min: float, eta: np.ndarray, place: np.ndarray, seen: list[int] | None, known: np.ndarray | None) -> None:
    """Fills the views eta and place of one batch."""
    earlier = np.searchsorted(side.us, side.us[j], side="left")  # events before this place are earlier

    def take(child: np.ndarray, event: np.ndarray) -> None:
        """The least eta of these pairs, in order of the children, of equal ones the first event, where it is better than what is known."""
        if not len(child):
            return
        found = side.exact(j[child], event, d, r_min)[0]
        head = np.flatnonzero(np.concatenate([[True], child[1:] != child[:-1]]))
        least = np.minimum.reduceat(found, head)
        equal = found == np.repeat(least, np.diff([*head, len(found)]))
        first = np.minimum.reduceat(np.where(equal, event, len(side.us)), head)
        own = child[head]
        better = (least < eta[own]) | ((least == eta[own]) & np.isfinite(least) & (first < place[own]))
        eta[own[better]], place[own[better]] = least[better], first[better]

    def visit(child: np.ndarray, leaf: np.ndarray) -> None:
        """Pairs in order of the children: a bound of all the leaf's events, and exactly what it allows."""
        if seen is not None:
            seen.append(leaf.size * tree.event.shape[1])
        for lo in range(0, len(child), BLOCKS):
            c, own = child[lo : lo + BLOCKS], leaf[lo : lo + BLOCKS]
            low = np.zeros((len(c), tree.event.shape[1]))
            for axis in range(3):
                off = tree.unit[axis][own]
                off -= side.unit[axis, j[c]][:, None]
                off *= off
                low += off
            np.sqrt(low, out=low)
            low *= model.EARTH_RADIUS_KM * MARGIN
            beyond = None if tree.reach_of is None else low > tree.reach_of[own]
            np.maximum(low, r_min, out=low)
            low = power(low, d)
            gap = side.us[j[c]][:, None] - tree.us[own]
            beyond = gap <= 0 if beyond is None else beyond | (gap <= 0)
            gap *= tree.weight_of[own]
            low *= gap
            low *= MARGIN / YEAR_US
            low[beyond] = np.inf
            best = low.argmin(axis=1)
            row = np.flatnonzero(low[np.arange(len(c)), best] <= eta[c])
            row = row[np.isfinite(low[row, best[row]])]
            take(c[row], tree.event[own[row], best[row]])
            row = row[low[row, best[row]] <= eta[c[row]]]
            some, column = np.nonzero((low[row] <= eta[c[row]][:, None]) & (low[row] < np.inf))
            take(c[row[some]], tree.event[own[row[some]], column])

    back = earlier[:, None] - 1 - np.arange(FIRST)
    child, column = np.nonzero(back >= 0)
    if seen is not None:
        seen.append(len(child))
    take(child, back[child, column])

    def bounds(child: np.ndarray, nodes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lower bound of each pair, and whether it may hold a better parent; the node's events are no later than ``last``."""
        us = side.us[j[child]]
        far = tree.near(side, j[child], nodes)
        low = np.maximum(us - last, 1.0) / YEAR_US * power(np.maximum(far, r_min), d) * tree.weight[nodes] * MARGIN
        return low, (low <= eta[child]) & (far <= tree.reach[nodes]) & (tree.first[nodes] < us)

    every, roots = np.repeat(np.arange(len(j)), tree.roots), np.tile(np.arange(tree.roots), len(j))
    # who knows no parent looks at the leaf of each root that is best on the way down: what it holds leaves little of the tree to be looked at
    blind = np.ones(len(every), dtype=bool) if known is None else np.isinf(known)[every]
    first, node = every[blind], roots[blind]
    while len(inner := np.flatnonzero(tree.child[node] >= 0)):
        two = tree.child[node[inner]]
        (left, l_may), (right, r_may) = (bounds(first[inner], n, tree.last[n]) for n in (two, two + 1))
        right_is_better = np.where(r_may, right, np.inf) < np.where(l_may, left, np.inf)
        node[inner] = two + (right_is_better | ~l_may & ~r_may)
    tried = tree.number[node]
    visit(first, tried)

    child, nodes = every, roots
    leaves = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    while len(child):
        low, some = bounds(child, nodes, tree.last[nodes])
        child, nodes, low = child[some], nodes[some], low[some]
        ends = tree.child[nodes] < 0
        leaves.append((child[ends], nodes[ends], low[ends]))
        child, nodes = np.repeat(child[~ends], 2), (tree.child[nodes[~ends]][:, None] + np.arange(2)).ravel()
    child, nodes, low = (np.concatenate(x) for x in zip(*leaves, strict=True))
    leaf = tree.number[nodes]
    new = low <= eta[child]
    new[new] = ~np.isin(child[new] * len(tree.event) + leaf[new], first * len(tree.event) + tried)
    child, nodes, leaf = child[new], nodes[new], leaf[new]
    # a leaf's events are in order of time: its last earlier one says how near in time it can be
    behind = np.searchsorted(tree.key, leaf * tree.step + earlier[child]) - leaf * tree.event.shape[1]
    some = behind > 0
    child, nodes, leaf, behind = child[some], nodes[some], leaf[some], behind[some]
    low, some = bounds(child, nodes, tree.us[leaf, behind - 1])
    child, leaf, low = child[some], leaf[some], low[some]
    rank = np.lexsort((low, child))
    number = np.arange(len(rank)) - np.searchsorted(child[rank], child[rank], side="left")
    # best first: every child's most promising leaf, then twice as many each time, as far as the bounds still allow
    done, more = 0, 1
    while len(rank):
        now = rank[number < done + more]
        visit(child[now], leaf[now])
        rest = number >= done + more
        rank, number = rank[rest], number[rest]
        allowed = low[rank] <= eta[child[rank]]
        rank, number = rank[allowed], number[allowed]
        done, more = done + more, 2 * more
