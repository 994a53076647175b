import math

import numpy as np
import pyarrow as pa
from rollcall.llm import ann, inner_products
from rollcall.llm.common import table

V = "vec_id long, embedding array<float>, label int"


def odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(6).round(2).tolist(), 0) for i in range(0, 301)]
    rows[5:60] = [(i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 0) for i in range(5, 60)]  # many copies of one vector
    rows[100] = (100, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], None)
    rows += [(400, None, 1), (401, [], 1), (402, [1.0, None, 3.0, 4.0, 5.0, 6.0], 1), (403, [math.nan] * 6, 1), (404, [math.inf] + [0.0] * 5, 1), (405, [0.0] * 6, 1), (None, [1.0] * 6, 1), (407, [-0.0, 0.0, 0.0, 0.0, 0.0, 0.0], 1)]
    rows += [(3, rows[3][1], 9), (3, [9.0] * 6, 9), (200, rows[200][1], 9), (200, [0.5] * 6, 9), (5, rows[5][1], 9), (500, [7.0] * 6, 9)]  # ids that repeat
    rows += [(406, [1.0, 2.0], 1), (600, [1.0, 2.5], 1), (700, [3.0], 1)]  # other lengths
    return spark.createDataFrame(rows, V)


def usable(df, nonzero):
    """(id, vector) of each row that takes part."""
    good = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and (not nonzero or any(v))
    return [(r.vec_id, r.embedding) for r in df.collect() if r.vec_id is not None and good(r.embedding)]


def brute(rows, measure, k=10):
    """Sorted (query_id, rank, vec_id, score): every row but the query's own, of its length; the least measure first."""
    out = []
    for n, (q, v) in enumerate(rows):
        if q % 100 == 0:
            all_ = sorted((measure(v, x), i) for m, (i, x) in enumerate(rows) if m != n and len(x) == len(v))
            out += [(q, at, i, s) for at, (s, i) in enumerate(all_[:k], 1)]
    return sorted(out)


def answered(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def product(a, b):
    whole = lambda v: [int(x) * 1024 if abs(x) > 2**60 else math.floor(1024 * x) for x in v]
    return -max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(whole(a), whole(b)))))


def check_products(df):
    want = [(q, at, i, -s) for q, at, i, s in brute(usable(df, False), product)]
    assert answered(inner_products.top_products(df)) == want


def test_exact_products_with_ties_and_odd_rows(spark):
    check_products(odd_vectors(spark))


def test_exact_products_over_many_blocks(spark, monkeypatch):
    for name, n in (("BLOCK_ROWS", 40), ("SET_QUERIES", 2), ("QUERY_ROWS", 2), ("PART_ROWS", 16)):
        monkeypatch.setattr(inner_products, name, n)
    check_products(odd_vectors(spark))


def huge(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(3) * 10.0 ** rng.integers(-3, 13)).tolist(), 0) for i in range(60)]
    rows += [(100, [1e300, 0.0, 0.0], 0), (200, [-1e300, 1.0, 0.0], 0), (300, [1.7e308, 1.7e308, 0.0], 0), (301, [1e-300, 0.0, 1e-310], 0), (400, [3e15, 1.0, 2.0], 0), (500, [0.0, 0.0, 5.0], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_components_as_large_as_they_come(spark, monkeypatch):
    check_products(huge(spark))
    monkeypatch.setattr(inner_products, "BLOCK_ROWS", 20)
    check_products(huge(spark))
    from fractions import Fraction

    rows = usable(huge(spark), True)
    got = answered(ann.nearest(huge(spark)))
    assert [g[:3] for g in got if g[0] in (0, 500)] == [w[:3] for w in brute(rows, lambda a, b: sum((Fraction(x) - Fraction(y)) ** 2 for x, y in zip(a, b))) if w[0] in (0, 500)]
    assert all(len([g for g in got if g[0] == q]) == 10 for q in (0, 100, 200, 300, 400, 500)) and all(math.isfinite(g[3]) for g in got if not {g[0], g[2]} & {300})  # 300 is farther off than a double can tell


def test_nearest_finds_copies_and_leaves_odd_rows_out(spark):
    rows = usable(odd_vectors(spark), True)
    got, want = answered(ann.nearest(odd_vectors(spark))), brute(rows, math.dist)
    assert [g[:2] for g in got] == [w[:2] for w in want]  # as many for each query, ids that repeat included
    hits = len({g[:1] + g[2:3] for g in got} & {w[:1] + w[2:3] for w in want})
    assert hits >= 0.9 * len({w[:1] + w[2:3] for w in want})
    assert [(v, s) for q, _, v, s in got if q == 100] == [(v, 0.0) for v in (5, 5, 6, 7, 8, 9, 10, 11, 12, 13)]
    assert [(v, s) for q, _, v, s in got if q == 600] == [(406, 0.5)] and not [g for g in got if g[0] == 700]
    measured = {(q, i): {math.dist(v, x) for a, v in rows if a == q for b, x in rows if b == i and len(x) == len(v)} for q, _, i, _ in got for _ in [0]}
    assert all(any(math.isclose(s, d, rel_tol=1e-12, abs_tol=1e-12) for d in measured[q, i]) for q, _, i, s in got)


def test_recall(spark):
    e = table(spark, "/root/testdata/sf0.01", "embeddings")
    rows = {r.vec_id: np.array(r.embedding, float) for r in e.collect()}
    got = ann.nearest(e).collect()
    hit = total = 0
    for q in (i for i in rows if i % 100 == 0):
        near = sorted((float(np.sqrt(((x - rows[q]) ** 2).sum())), i) for i, x in rows.items() if i != q)[:10]
        hit += len({i for _, i in near} & {r.vec_id for r in got if r.query_id == q})
        total += 10
    assert hit / total >= 0.9


def test_empty_and_single(spark):
    none, one = spark.createDataFrame([], V), spark.createDataFrame([(100, [1.0, 2.0], 0)], V)
    for search in (ann.nearest, inner_products.top_products):
        assert search(none).count() == 0 and search(one).count() == 0


def test_visits_are_in_order_of_cost():
    h = ann.Hashes(np.zeros((1, 2, 2)), np.zeros((1, 2)), 1.0, 9)
    codes = h.visited(np.array([[0.1, 0.6]]))
    cells = [(0, 0), (-1, 0), (0, 1), (-1, 1), (0, -1), (-1, -1), (1, 0), (1, 1), (1, -1)]
    assert codes[0].tolist() == h.code(np.array(cells, float)).tolist()


def test_chance_of_a_find():
    """Against rows drawn at that distance of the query."""
    rng = np.random.default_rng(5)
    h = ann.Hashes(rng.standard_normal((3, 4, 12)), rng.random((3, 4)), 2.0, 20)
    q = rng.standard_normal(12)
    step = rng.standard_normal((20_000, 12))
    rows = q + 1.5 * step / np.linalg.norm(step, axis=1)[:, None]
    own, at = h.positions(q[None]), h.positions(rows)
    hit = np.zeros(len(rows), bool)
    for t in range(3):
        hit |= np.isin(h.code(np.floor(at[:, t])), h.visited(own[:, t])[0])
    # The chance is over projections, the draw over rows: they agree about.
    assert abs(hit.mean() - h.chance(own, np.array([1.5]))[0]) < 0.15


def test_clustered_rows_need_few_visits(caplog):
    """Tight clusters: the fitted setting compares a small share of the rows and finds the neighbours."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((400, 16)) * 10
    x = np.repeat(centres, 20, axis=0) + 0.1 * rng.standard_normal((8000, 16))
    queries = x[::125]
    near = []
    for q in queries:
        far = ((x - q) ** 2).sum(axis=1)
        near.append(x[np.argsort(far)[1:11]])
    with caplog.at_level("INFO", logger="rollcall.llm.ann"):
        ann.fit_hashes(x[rng.permutation(8000)[:4096]], queries, near)
    share = float(caplog.records[-1].getMessage().split("tables, ")[1].split(" of")[0])
    assert share < 0.1


def test_outlying_queries_find_as_many_as_there_are(spark):
    """Unit vectors, and queries of 2, 3, 5 and 50 times the length, whose own buckets and neighbours are empty."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    for at, times in ((100, 2), (200, 3), (300, 5), (400, 50)):
        x[at] *= times
    got = {}
    for r in ann.nearest(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == set(range(0, 3000, 100)) and all(len(f) == 10 for f in got.values())
    for at in (100, 200, 300, 400):
        far = ((x - x[at]) ** 2).sum(axis=1)
        far[at] = np.inf
        assert [v for _, v in sorted(got[at])] == np.argsort(far)[:10].tolist()


def test_tables_of_few_rows_give_all_others(spark):
    rows = [(i, [float(1000 * i), float(-i), 1.0], 0) for i in range(8)]
    got = [(r["rank"], r.vec_id) for r in ann.nearest(spark.createDataFrame(rows, V)).collect()]
    assert sorted(got) == [(i, i) for i in range(1, 8)]


def test_queries_of_a_group_pass_by(monkeypatch):
    """A group's first queries are answered before its last ones are read, from the whole block of rows."""
    schema = pa.schema([("table", pa.int32()), ("cell", pa.int32()), ("chunk", pa.int32()), ("query", pa.bool_()), ("query_id", pa.int64()), ("query_class", pa.int64()), ("times", pa.int64()), ("bucket", pa.int64()), ("class", pa.int64()), ("v", pa.list_(pa.float64())), ("ids", pa.list_(pa.int64())), ("visits", pa.list_(pa.int64()))])
    read = []
    group = {"table": 0, "cell": 0, "chunk": 0}

    def batches():
        for at in range(2):
            yield pa.RecordBatch.from_pylist([{**group, "query": False, "bucket": i % 2, "class": i, "v": [float(i)], "ids": [i]} for i in range(20 * at, 20 * at + 20)], schema)
        for at in range(50):
            read.append(at)
            yield pa.RecordBatch.from_pylist([{**group, "query": True, "query_id": 1000 + at, "query_class": -1, "times": 1, "v": [float(at % 40)], "visits": [0, 7] if at % 2 else None}], schema)
        yield pa.RecordBatch.from_pylist([{**group, "cell": 1, "query": True, "query_id": 1000, "query_class": -1, "times": 1, "v": [0.0]}], schema)  # a cell without rows

    got = ann.nearest_in(batches(), 3)
    first = next(got)
    found = lambda b: [x[0] for x in b.column(5).to_pylist()]
    assert len(read) < 3 and found(first) == [0, 1, 2]
    rest = list(got)
    assert len(rest) == 49 and found(rest[0]) == [0, 2, 4] and found(rest[-1]) == [8, 10, 6]
