"""Search for the best inner products in intervals by two trees, one over anchors and one over candidates.

A node is a ball (centre, radius). The inner products of two balls' members lie in an interval, so a pair of nodes whose
interval misses what every anchor of the one still wants is left out with all its pairs. Pairs of leaves are scored exactly:
components are whole numbers, and floats hold their sums exactly up to 2^53; beyond, Python's integers are used.
"""

from __future__ import annotations

import numpy as np

LEAF = 128
LONG = (1 << 63) - 1


class Tree:
    """Balls over rows: `order` lists the rows so that every node is a slice of it."""

    def __init__(self, rows: np.ndarray) -> None:
        n = len(rows)
        self.order = np.arange(n)
        self.begin, self.end, self.left, self.right = [0], [n], [-1], [-1]
        stack = [0]
        with np.errstate(all="ignore"):
            while stack:
                node = stack.pop()
                a, b = self.begin[node], self.end[node]
                if b - a <= LEAF:
                    continue
                own = rows[self.order[a:b]]
                far = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
                across = ((own - far) ** 2).sum(axis=1)
                if not across.max() > 0:  # all alike
                    continue
                along = own @ (own[np.argmax(across)] - far)
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(along, middle)]
                for x, y, side in ((a, a + middle, self.left), (a + middle, b, self.right)):
                    side[node] = len(self.begin)
                    self.begin.append(x)
                    self.end.append(y)
                    self.left.append(-1)
                    self.right.append(-1)
                    stack.append(len(self.begin) - 1)
            self.centre = np.array([rows[self.order[a:b]].mean(axis=0) for a, b in zip(self.begin, self.end)])
            self.radius = np.array([np.sqrt(((rows[self.order[a:b]] - c) ** 2).sum(axis=1).max()) for a, b, c in zip(self.begin, self.end, self.centre)])
            self.norm = np.sqrt((self.centre**2).sum(axis=1))


def exact(rows: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sets of whole numbers in a form whose inner products are exact."""
    most = [np.abs(x).max(initial=0) for x in (rows, other)]
    if most[0] * most[1] * max(1, rows.shape[1]) < 2.0**53:
        return rows, other
    return tuple(np.array([[int(c) for c in r] for r in x], object).reshape(x.shape) for x in (rows, other))


class Side:
    """What the search knows of one side's rows: id and unique place of each row, its label, its components."""

    def __init__(self, place: np.ndarray, key: np.ndarray, label: np.ndarray, rows: np.ndarray) -> None:
        self.place, self.key, self.label, self.rows = place, key, label, rows


def search(anchors: Side, candidates: Side, low: np.ndarray, high: np.ndarray, top: int, same: bool) -> tuple[np.ndarray, ...]:
    """(anchor's place in anchors, which interval, candidate's place in candidates, score) of the best in each interval.

    low, high: for each anchor the intervals that it asks for (anchors x intervals); an interval with low > high is empty.
    same: candidates have the anchor's label and are other rows; else they have other labels. Best: higher score, then
    smaller id, then smaller place.
    """
    if not len(anchors.rows) or not len(candidates.rows) or not low.shape[1]:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, object),)
    trees = Tree(anchors.rows), Tree(candidates.rows)
    a_order, c_order = trees[0].order, trees[1].order
    mine, theirs = exact(anchors.rows[a_order], candidates.rows[c_order])
    low, high = low[a_order], high[a_order]
    floor, k = low.astype(object if mine.dtype == object else np.float64), low.shape[1]
    high = high.astype(floor.dtype)
    a_label, a_place = anchors.label[a_order], anchors.place[a_order]
    c_label, c_place, c_key = candidates.label[c_order], candidates.place[c_order], candidates.key[c_order]
    rank = np.empty(len(c_key), np.int64)  # breaks ties of scores
    rank[np.lexsort((c_place, c_key))] = np.arange(len(c_key))
    wanted = low <= high
    # Found so far, by anchor: interval, candidate, score.
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, floor.dtype))] * len(mine)

    def interval(x: int, y: int) -> tuple[float, float]:
        with np.errstate(all="ignore"):
            middle = float(trees[0].centre[x] @ trees[1].centre[y])
            r, s = trees[0].radius[x], trees[1].radius[y]
            spread = r * trees[1].norm[y] + s * trees[0].norm[x] + r * s
            spread += 0.5 + 1e-9 * (abs(middle) + spread)
            return middle - spread, middle + spread

    def score(a: int, b: int, c: int, d: int) -> None:
        products = mine[a:b] @ theirs[c:d].T
        alike = a_label[a:b, None] == c_label[None, c:d]
        alike &= a_place[a:b, None] != c_place[None, c:d] if same else True
        fits = alike if same else ~alike
        for j in range(k):
            hit = fits & (products >= floor[a:b, j : j + 1]).astype(bool) & (products <= high[a:b, j : j + 1]).astype(bool) & wanted[a:b, j : j + 1]
            at, to = np.nonzero(hit)
            if not len(at):
                continue
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])).tolist() + [len(at)]
            for p, q in zip(cuts, cuts[1:]):
                i = a + int(at[p])
                js, cs, ss = found[i]
                own = js == j
                new_c, new_s = np.concatenate([cs[own], c + to[p:q]]), np.concatenate([ss[own], products[at[p], to[p:q]]])
                keep = np.lexsort((rank[new_c], -new_s))[:top]
                found[i] = np.concatenate([js[~own], np.full(len(keep), j)]), np.concatenate([cs[~own], new_c[keep]]), np.concatenate([ss[~own], new_s[keep]])
                if len(keep) == top:
                    floor[i, j] = max(floor[i, j], new_s[keep[-1]])

    first, second = trees
    stack = [(0, 0, *interval(0, 0))]
    while stack:
        x, y, least, most = stack.pop()
        a, b, c, d = first.begin[x], first.end[x], second.begin[y], second.end[y]
        asks = wanted[a:b]
        if not asks.any() or most < floor[a:b][asks].min() or least > high[a:b][asks].max():
            continue
        if first.left[x] < 0 and second.left[y] < 0:
            score(a, b, c, d)
        elif second.left[y] < 0 or first.left[x] >= 0 and b - a > d - c:
            stack += [(z, y, *interval(z, y)) for z in (first.left[x], first.right[x])]
        else:  # the more promising half comes off the stack first
            stack += sorted(((x, z, *interval(x, z)) for z in (second.left[y], second.right[y])), key=lambda t: t[3])
    at = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
    js, cs, ss = (np.concatenate(x) for x in zip(*found))
    return a_order[at], js.astype(np.int64), c_order[cs], ss
