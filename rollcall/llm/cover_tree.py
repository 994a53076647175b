"""Cover trees over blocks of integer vectors, and the dual walk that finds nearest centroids.

A node covers a stretch of its block's points (put in the tree's order) with one of them as
centre.  Children's centres lie within the node's radius and further than the
children's scale from each other; the first child has the node's own centre, and
each scale is half of the one above.  Nodes of a few points, or of equal ones, are leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF_POINTS = 8
#: Bounds are widened by this share of what they are made of, far more than rounding takes.
SLACK = 1e-9
#: Largest size of a component up to which squared distances of 64 components fit into a long.
LONG_SAFE = 1 << 27
LARGEST = (1 << 63) - 1


def exact(points: np.ndarray) -> np.ndarray:
    """``points`` as longs where squared distances fit into a long, else as Python's whole numbers."""
    return points if not points.size or max(int(points.max()), -int(points.min())) < LONG_SAFE else points.astype(object)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact: longs or Python's whole numbers."""
    if a.dtype == object or b.dtype == object:
        a, b = a.astype(object), b.astype(object)
    d = a - b
    return (d * d).sum(axis=-1)


def lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.asarray(squares(a, b), float))


@dataclass
class Tree:
    """order: the points' places in the block; by node: centre (a place in the order), radius, lo and hi (its stretch), first child and how many (0: a leaf)."""

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    child: np.ndarray
    children: np.ndarray

    def below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of the nodes, and for each the place of its parent among them."""
        n = self.children[nodes]
        parent = np.repeat(np.arange(len(nodes)), n)
        step = np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n)
        return self.child[nodes][parent] + step, parent


def grow(points: np.ndarray, leaf: int = LEAF_POINTS) -> Tree:
    """The cover tree of at least one point."""
    spots = points if points.dtype == object else points.astype(float)
    order = np.arange(len(points))
    nodes = [[0, 0.0, 0, len(points), 0, 0]]
    at = 0
    while at < len(nodes):
        node = nodes[at]
        lo, hi = node[2], node[3]
        own = order[lo:hi]
        away = lengths(spots[own], spots[own[0]])
        furthest = float(away.max())
        node[0], node[1] = lo, furthest * (1 + SLACK)
        if hi - lo > leaf and furthest > 0:
            scale = 2.0 ** (np.ceil(np.log2(furthest)) - 1)  # less than the furthest, so that there are two children at least
            stretches, left = [], own
            while len(left):  # the next centre is the first point that none covers yet
                near = away <= scale
                stretches.append(left[near])
                left = left[~near]
                away = lengths(spots[left], spots[left[0]]) if len(left) else away[:0]
            order[lo:hi] = np.concatenate(stretches)
            node[4], node[5] = len(nodes), len(stretches)
            ends = lo + np.cumsum([len(s) for s in stretches])
            nodes += [[0, 0.0, int(e) - len(s), int(e), 0, 0] for s, e in zip(stretches, ends)]
        at += 1
    columns = list(zip(*nodes))
    return Tree(order, *(np.array(c, float if i == 1 else np.int64) for i, c in enumerate(columns)))


@dataclass
class Walk:
    """cluster: of each point in the tree's order; compared: how many pairs of a point and a centroid were compared one by one."""

    cluster: np.ndarray
    compared: int = 0


def nearest(tree: Tree, points: np.ndarray, over: Tree, centroids: np.ndarray) -> Walk:
    """Each point's nearest centroid, of equally near ones that of the smaller number.

    ``points`` are in the order of ``tree``; ``over`` is a tree of ``centroids`` down to single ones.  The
    pairs of a node and a node of centroids go down together: where a centroid can't
    be the nearest of any point of the node, by the distance of the centres and
    both radii, its pair goes; a node with one centroid left is settled whole.
    """
    out = Walk(np.zeros(len(points), np.int64))
    seats = centroids[over.order]
    # A frontier: nodes, and pairs (which of these nodes, node of centroids).
    nodes, of, c = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(nodes):
        own = tree.radius[nodes]
        bottom = tree.children[nodes] == 0
        while True:
            gap = lengths(points[tree.centre[nodes[of]]], seats[over.centre[c]])
            reach = gap + own[of]  # a centre is a centroid, so none of the node's points is further from its nearest
            least = np.full(len(nodes), np.inf)
            np.minimum.at(least, of, reach)
            room = SLACK * (reach + over.radius[c] + 1)
            stay = gap - own[of] - over.radius[c] <= least[of] + room
            of, c = of[stay], c[stay]
            split = (over.children[c] > 0) & ((over.radius[c] > own[of]) | bottom[of])
            if not split.any():
                break
            deeper, parent = over.below(c[split])
            of, c = np.concatenate([of[~split], of[split][parent]]), np.concatenate([c[~split], deeper])
        single = over.children[c] == 0
        alone = np.bincount(of, minlength=len(nodes)) == 1
        settled = np.flatnonzero(alone[of] & single)
        for k in settled:
            out.cluster[tree.lo[nodes[of[k]]] : tree.hi[nodes[of[k]]]] = over.order[over.centre[c[k]]]
        done = np.zeros(len(nodes), bool)
        done[of[settled]] = True
        ends = bottom & ~done
        if ends.any():
            compare(tree, points, nodes, of[ends[of]], over.order[over.centre[c[ends[of]]]], centroids, out)
        go = np.flatnonzero(~done & ~bottom)
        place = np.full(len(nodes), -1)
        place[go] = np.arange(len(go))
        of, c = place[of[place[of] >= 0]], c[place[of] >= 0]
        # Children take over all pairs of their parent.
        start = np.argsort(of, kind="stable")
        of, c = of[start], c[start]
        pairs = np.bincount(of, minlength=len(go))
        first = np.cumsum(pairs) - pairs
        deeper, parent = tree.below(nodes[go])
        n = pairs[parent]
        nodes, of = deeper, np.repeat(np.arange(len(deeper)), n)
        c = c[np.repeat(first[parent], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]
    return out


def compare(tree: Tree, points: np.ndarray, nodes: np.ndarray, of: np.ndarray, centroid: np.ndarray, centroids: np.ndarray, out: Walk) -> None:
    """Every point of the leaves against every centroid that is left for its leaf, exactly."""
    n = tree.hi[nodes[of]] - tree.lo[nodes[of]]
    point = np.repeat(tree.lo[nodes[of]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    centroid = np.repeat(centroid, n)
    out.compared += len(point)
    away = squares(points[point], centroids[centroid])
    order = np.lexsort((centroid, np.asarray(away), point)) if away.dtype != object else np.array(sorted(range(len(point)), key=lambda i: (point[i], away[i], centroid[i])), np.int64)
    point, centroid = point[order], centroid[order]
    first = np.concatenate([[True], point[1:] != point[:-1]])
    out.cluster[point[first]] = centroid[first]
