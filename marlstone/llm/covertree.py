"""Cover trees over unit vectors, and the dual traversal that finds all pairs within a distance.

A level's nodes are centres further apart than its radius, each with the points within that
radius; the next level halves the radius, and a node's centre is one of its children's centres
again. Two nodes are compared by their centres and the true distance to their furthest points:
pairs that are too far are dropped whole, pairs whose points are all near enough are counted
whole, others are split. Where a level stops compressing (each further centre would cover little
but itself, as in high dimensions without clusters) the points that are left stay in one leaf,
as do those of children too small to be worth a visit, and leaves are compared in blocks.

A block is first compared by a bound: the product of the leading coordinates in some basis, and
that of the lengths of what is left of the two vectors. It is never below the cosine, so no pair
is lost, and the few pairs that it leaves are decided on whole vectors in double precision.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Centres that are tried at once; a level goes on as long as they cover so many points each.
_CENTRES = 64
_WORTH = 8
_LEAF = 32
#: Rows and columns of a block, and its pairs, at most, that are decided one by one.
_BLOCK = 1024
_FEW = 2048
_EPS = 1e-6
#: Children whose distances to others are held at once.
_ROWS = 256


@dataclass
class Node:
    """points: rows in the order of the tree. centre: a row. reach: distance from it to the furthest point."""

    points: np.ndarray
    centre: np.ndarray
    reach: float
    children: list[Node] = field(default_factory=list)


def _distance(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """To one centre, or to each column of several."""
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ centre)))


def build(x: np.ndarray, points: np.ndarray | None = None, centre: np.ndarray | None = None, radius: float = 1.0, least: float = 0.02) -> Node:
    """The tree of the rows of x (unit vectors); radius is that of the next level."""
    points = np.arange(len(x)) if points is None else points
    centre = x[points[0]] if centre is None else centre
    node = Node(points, centre, float(_distance(x[points], centre).max(initial=0)))
    if len(points) <= _LEAF or node.reach <= least:
        return node
    while radius > least and node.reach <= radius:
        radius /= 2
    rest, centres, loose = points, centre[None], []
    while len(rest):
        # The next centres, at once: of the first points that are left, those that no earlier one of them covers.
        near = x[rest[:_CENTRES]] @ x[rest[:_CENTRES]].T >= 1 - radius**2 / 2
        chosen: list[int] = []
        for k in range(len(near)):
            if not near[k, chosen].any():
                chosen.append(k)
        centres = np.concatenate([centres, x[rest[chosen]]])
        within = _distance(x[rest], centres.T) <= radius
        covered, of = within.any(1), within.argmax(1)
        for k in np.unique(of[covered]).tolist():
            part = rest[covered & (of == k)]
            if len(part) < _WORTH:
                loose.append(part)
            else:
                node.children.append(build(x, part, centres[k], radius / 2, least))
        before, rest, centres = len(rest), rest[~covered], x[:0]
        if len(rest) and before - len(rest) < _WORTH * len(chosen):
            break
    rest = np.concatenate([rest, *loose])
    if node.children and len(rest):
        c = x[rest[0]]
        node.children.append(Node(rest, c, float(_distance(x[rest], c).max(initial=0))))
    return node


class Links:
    """What the traversal adds up: for each point the weight of those it links with, and links enough to connect them."""

    def __init__(self, n: int, weights: np.ndarray):
        self.count = np.zeros(n, np.int64)
        self.weights = weights
        self.edges: list[np.ndarray] = []
        self.compared = 0  # pairs of points that were multiplied

    def all_of(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every pair of the two (the same points: every pair within, but not a point with itself)."""
        self.count[a] += self.weights[b].sum()
        if a is b or np.array_equal(a, b):
            self.count[a] -= self.weights[a]
        else:
            self.count[b] += self.weights[a].sum()
        every = np.concatenate([a, b])
        self.edges.append(np.stack([np.full(len(every), a[0]), every]))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Each a with its b."""
        np.add.at(self.count, a, self.weights[b])
        np.add.at(self.count, b, self.weights[a])
        self.edges.append(np.stack([a, b]))

    def some_of(self, a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> None:
        """The pairs that the mask marks (within one set: each marked twice)."""
        same = a is b
        self.count[a] += mask @ self.weights[b]
        if not same:
            self.count[b] += self.weights[a] @ mask
        # Labels by least row number: the links of a spanning forest and little more.
        own = np.arange(len(a))
        other = own if same else len(a) + np.arange(len(b))
        while True:
            low = np.minimum(own, np.where(mask, other, len(a) + len(b)).min(1))
            back = np.minimum(other, np.where(mask, low[:, None], len(a) + len(b)).min(0))
            if same:
                back = low = np.minimum(low, back)
            if np.array_equal(low, own) and np.array_equal(back, other):
                break
            own, other = low, back
        rows = a if same else np.concatenate([a, b])
        self.edges.append(np.stack([rows[own], a]))
        if not same:
            self.edges.append(np.stack([rows[other], b]))


def leading(x: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """Rows in single precision whose products are no less than the cosines: coordinates in the (orthonormal) basis and the length of the rest."""
    if basis is None:
        return x.astype(np.float32)
    lead = x @ basis
    return np.concatenate([lead, np.sqrt(np.maximum(0, 1 - (lead * lead).sum(1, keepdims=True)))], axis=1).astype(np.float32)


def leading_basis(sample: np.ndarray, cosine: float) -> np.ndarray | None:
    """The fewest principal directions of a sample that rule out nearly all of its pairs without a link; None if only whole vectors do.

    The choice decides how fast blocks are compared, not what links.
    """
    dim = sample.shape[1]
    one, two = sample[0::2][:_BLOCK], sample[1::2][:_BLOCK]
    sizes = [k for k in (16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512) if k <= 3 * dim // 4]
    if not sizes or not len(two):
        return None
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    apart = one @ two.T < cosine
    for k in sizes:
        basis = np.ascontiguousarray(axes[:, : k - 1])
        if ((leading(one, basis) @ leading(two, basis).T >= cosine - 1e-4) & apart).mean() <= 2.0**-12:
            return basis
    return None


def dual(x: np.ndarray, one: Node, two: Node, cosine: float, links: Links, basis: np.ndarray | None = None) -> None:
    """Adds all pairs of a point of ``one`` and a point of ``two`` whose cosine is at least so much; the same node: all pairs within."""
    far = float(np.sqrt(2 - 2 * cosine))
    low = leading(x, basis)
    stack = [(one, two)]
    while stack:
        a, b = stack.pop()
        if not a.children and not b.children:
            _compare(x, low, a.points, b.points, cosine, links)
            continue
        # All pairs of children at once, some hundred rows of them at a time.
        rows, columns = a.children or [a], b.children or [b]
        centres, reach = np.stack([n.centre for n in columns]), np.array([n.reach for n in columns])
        leaf = np.array([not n.children for n in columns])
        for at in range(0, len(rows), _ROWS):
            some = rows[at : at + _ROWS]
            d = _distance(np.stack([n.centre for n in some]), centres.T)
            both = np.array([n.reach for n in some])[:, None] + reach
            open_ = d - both <= far + _EPS
            whole = d + both < far - _EPS
            if a is b:
                here = at + np.arange(len(some))[:, None]
                open_ &= here <= np.arange(len(columns))
                whole |= (here == np.arange(len(columns))) & (both < far - _EPS)
                d = np.where(here == np.arange(len(columns)), 0.0, d)
            for i, j in np.argwhere(open_ & whole).tolist():
                links.all_of(some[i].points, columns[j].points)
            todo = open_ & ~whole
            plain = todo & np.array([not n.children for n in some])[:, None] & leaf
            if a is b:
                plain &= here < np.arange(len(columns))
            stack += [(some[i], columns[j]) for i, j in np.argwhere(todo & ~plain).tolist()]
            # Leaves that meet the same leaf are compared with it together.
            if plain.any(0).sum() <= plain.any(1).sum():
                for j in np.flatnonzero(plain.any(0)).tolist():
                    _compare(x, low, np.concatenate([some[i].points for i in np.flatnonzero(plain[:, j])]), columns[j].points, cosine, links)
            else:
                for i in np.flatnonzero(plain.any(1)).tolist():
                    _compare(x, low, some[i].points, np.concatenate([columns[j].points for j in np.flatnonzero(plain[i])]), cosine, links)


def _compare(x: np.ndarray, low: np.ndarray, a: np.ndarray, b: np.ndarray, cosine: float, links: Links) -> None:
    """Leaf against leaf in blocks: bounds in single precision rule out, whole vectors in double precision decide."""
    same = a is b
    right = low[b]
    bound, above = np.empty(_BLOCK * _BLOCK, np.float32), np.empty(_BLOCK * _BLOCK, bool)
    for i in range(0, len(a), _BLOCK):
        p = a[i : i + _BLOCK]
        left = low[p]
        for j in range(i if same else 0, len(b), _BLOCK):
            q = b[j : j + _BLOCK]
            inside = same and i == j
            links.compared += len(p) * (len(p) - 1) // 2 if inside else len(p) * len(q)
            shape = len(p), len(q)
            block, maybe = (m[: len(p) * len(q)].reshape(shape) for m in (bound, above))
            np.matmul(left, right[j : j + _BLOCK].T, out=block)
            np.greater_equal(block, cosine - 1e-4, out=maybe)
            if inside:
                np.fill_diagonal(maybe, False)
            found = np.flatnonzero(maybe)
            if len(found) <= _FEW:
                row, column = np.divmod(found, len(q))
                if inside:
                    row, column = row[row < column], column[row < column]
                linked = np.einsum("ij,ij->i", x[p[row]], x[q[column]]) >= cosine
                if linked.any():
                    links.pairs(p[row[linked]], q[column[linked]])
                continue
            rows = np.flatnonzero(maybe.any(1))
            if inside:
                p2 = q2 = p[rows]
            else:
                p2, q2 = p[rows], q[maybe.any(0)]
            mask = x[p2] @ x[q2].T >= cosine
            if inside:
                np.fill_diagonal(mask, False)
            if mask.any():
                links.some_of(p2, q2, mask)
