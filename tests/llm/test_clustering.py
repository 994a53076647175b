import hashlib
import math

import numpy as np
import pytest

from rollcall.llm import clustering
from rollcall.llm.clustering import cluster_vectors
from rollcall.llm.common import table
from rollcall.llm.cover_tree import exact, grow, nearest, squares

V = "vec_id long, embedding array<double>, label int, cluster int"


def brute(rows, k, rounds, scale, width):
    """Lloyd's rounds in Python's whole numbers, over every pair."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in kept]
    name = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~"
    order = sorted(range(len(kept)), key=lambda n: (name(kept[n][0]), kept[n][1]))
    centroids = [ints[n][1] for n in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        own = [best(v) for _, v in ints]
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(ints, own) if o == c]
            if mine:
                centroids[c] = tuple(sum(x) // len(mine) for x in zip(*mine))
    last = [(i, best(v), v) for i, v in ints]
    spread = {}
    for _, c, v in last:
        spread[c] = spread.get(c, 0) + far(v, centroids[c])
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    return sorted([(i, c, far(v, centroids[c]), spread[c], sum(spread.values()), digest(c)) for i, c, v in last], key=key)


def check(df, k=16, rounds=3, scale=64, width=64):
    got = sorted([tuple(r) for r in cluster_vectors(df, k, rounds, scale, width).collect()], key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))
    assert got == brute([(r.vec_id, r.embedding) for r in df.collect()], k, rounds, scale, width)
    return got


def test_whole_table(spark):
    assert len(check(table(spark, "/root/testdata/sf0.01", "embeddings"))) == 500


def test_odd_vectors_ties_and_repeats(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-3, 4, 4) / 2).tolist(), 0, 1) for i in range(150)]  # many ties
    rows += [(i, [9.0, 9.0, 9.0, 9.0], None, 1) for i in range(200, 260)]
    rows += [(3, [1.0] * 4, 0, 1), (3, [1.0] * 4, 0, 1), (None, [2.0] * 4, 0, 1), (None, [0.5] * 4, 0, 1), (400, None, 0, 1), (401, [], 0, 1), (402, [1.0, None, 1.0, 1.0], 0, 1), (403, [math.nan] * 4, 0, 1), (404, [math.inf] * 4, 0, 1), (405, [1.0] * 5, 0, 1), (406, [-0.0] * 4, 0, 1)]
    df = spark.createDataFrame(rows, V).repartition(3)
    check(df, k=7, scale=3, width=4)
    monkeypatch.setattr(clustering, "BLOCK_ROWS", 16)
    check(df, k=7, scale=3, width=4)
    check(df, k=1000, scale=3, width=4)
    check(df, k=5, rounds=0, scale=3, width=4)


def test_large_components(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(3) * 10 ** rng.integers(0, 9)).tolist(), 0, 1) for i in range(80)]
    check(spark.createDataFrame(rows, V), k=5, scale=2, width=3)
    top = cluster_vectors(spark.createDataFrame([(1, [1e300] * 3, 0, 1), (2, [-1e300] * 3, 0, 1), (3, [0.0] * 3, 0, 1)], V), k=1, width=3).collect()
    assert len(top) == 3 and max(r.distance for r in top) == 2**63 - 1


def test_no_vectors(spark):
    assert cluster_vectors(spark.createDataFrame([], V)).count() == 0
    assert cluster_vectors(spark.createDataFrame([(1, [1.0], 0, 1)], V)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("spread", [1, 400])
def test_trees_prune_and_stay_exact(spread):
    rng = np.random.default_rng(7)
    seats = rng.integers(-2000, 2000, (16, 8))
    points = exact(seats[rng.integers(0, 16, 1000)] + rng.integers(-spread, spread + 1, (1000, 8)))
    tree, over = grow(points), grow(seats, leaf=1)
    points = points[tree.order]
    walk = nearest(tree, points, over, seats)
    want = np.array([min(range(16), key=lambda c: (squares(p, seats[c]), c)) for p in points])
    assert (walk.cluster == want).all()
    assert walk.compared < (1 if spread == 1 else 4_000)  # of 16,000 pairs
    inner = np.flatnonzero(tree.children)
    for n in inner.tolist():  # covered by the centre, children apart
        kids, _ = tree.below(np.array([n]))
        assert (np.sqrt(squares(points[tree.lo[n] : tree.hi[n]], points[tree.centre[n]])) <= tree.radius[n]).all()
        assert tree.lo[kids[0]] == tree.lo[n] and tree.hi[kids[-1]] == tree.hi[n]
