from collections import Counter

import numpy as np
from helpers import no_docs, odd_docs, words

from rollcall.llm import ngram_join as J
from rollcall.llm.common import table
from rollcall.llm.components import components


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """n_links of each text, and the least id of each document's component."""
    texts = sorted({t or "" for _, t in rows})
    sets = {t: shingles(t) for t in texts}
    up = {t: t for t in texts}

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    links = Counter()
    for i, a in enumerate(texts):
        for b in texts[:i]:
            both = len(sets[a] & sets[b])
            if both and both * 1000 >= 800 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    least = {}
    for i, t in rows:
        if i is not None:
            least[root(t or "")] = min(i, least.get(root(t or ""), i))
    copies = Counter(t or "" for _, t in rows)
    return sorted(((i, least.get(root(t or "")), copies[t or ""] - 1, links[t or ""]) for i, t in rows), key=str)


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in J.class_rows(docs).select("doc_id", "class_id", "n_copies", "n_links").collect()), key=str)
    assert got == brute(rows)
    return got


def family(spark, n, size=60, step=1):
    """n different texts; near ones share most of their words."""
    base = [f"w{i}" for i in range(size)]
    rows = [(i, " ".join(base[: size - 1 - (i // step) % 3] + [f"end{i}"]), "en", "s", 1, 0.0, 0) for i in range(n)]
    return spark.createDataFrame(rows, no_docs(spark).schema)


def test_against_brute_force(spark):
    check(table(spark, "/root/testdata/sf0.001", "documents"))


def test_odd_tables(spark):
    check(odd_docs(spark))
    assert J.class_rows(no_docs(spark)).count() == 0 and J.keep_one(no_docs(spark)).count() == 0
    kept = J.keep_one(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, None, 3, 5, 6, 7, 8, 9], key=str)  # 3 and 4 are both empty


def kept_by(rows):
    """The ids that keep_one must keep, given that every row has an id."""
    return sorted({c for _, c, _, _ in rows})


def test_large_groups_in_chunks(spark, monkeypatch):
    for name, rows in (("CHUNK_ROWS", 20), ("BUCKET_ROWS", 16), ("WIDE_ROWS", 24), ("PIVOTS", 2)):
        monkeypatch.setattr(J, name, rows)
    docs = family(spark, 90)
    got = check(docs)
    assert {c for _, c, _, _ in got} == {0} and min(n for *_, n in got) > 30
    assert [r.doc_id for r in J.keep_one(docs).collect()] == [0]


def copies(spark, n, edits, size=400):
    """n texts with so many words of one changed."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        own = [f"w{k}" for k in range(size)]
        for k in rng.integers(0, size, edits(i)):
            own[k] = f"x{i}y{k}"
        rows.append((i, " ".join(own), "en", "s", 1, 0.0, 0))
    return spark.createDataFrame(rows, no_docs(spark).schema)


def test_pairs_of_a_tight_group_are_counted_without_meeting(spark, monkeypatch):
    for name, rows in (("CHUNK_ROWS", 16), ("PIVOTS", 3)):
        monkeypatch.setattr(J, name, rows)
    met = []
    around = J.around_pivots
    monkeypatch.setattr(J, "around_pivots", lambda *a: met.append(around(*a)) or met[-1])
    got = check(copies(spark, 120, lambda i: 1 + i % 2))
    assert {n for *_, n in got} == {119} and met.pop().members.count() == 0
    got = check(copies(spark, 120, lambda i: 1 + i % 2 if i % 10 else 14))  # some are further away, from each other too
    assert len({n for *_, n in got}) > 1 and 0 < met.pop().members.count() < 120 * 8
    got = check(copies(spark, 60, lambda i: i % 25))
    assert met.pop().members.count() > 0 and len({n for *_, n in got}) > 10


def test_a_large_bucket_of_several_groups(spark, monkeypatch):
    """One shared passage puts texts into the same buckets; they make chains and groups of their own."""
    for name, rows in (("CHUNK_ROWS", 6), ("BUCKET_ROWS", 5), ("WIDE_ROWS", 8), ("PIVOTS", 1)):
        monkeypatch.setattr(J, name, rows)
    common = [f"shared{i}" for i in range(60)]
    rows = []
    for i in range(70):
        own = [f"g{i % 7}x{k}" for k in range(24)]
        own[(i // 7) % 24] = f"odd{i}"
        rows.append((i, " ".join(common + own), "en", "s", 1, 0.0, 0))
    docs = spark.createDataFrame(rows, no_docs(spark).schema)
    got = check(docs)
    assert len({c for _, c, _, _ in got}) == 7
    assert sorted(r.doc_id for r in J.keep_one(docs).collect()) == kept_by(got)


def test_keep_one_keeps_the_least_of_each_class(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert sorted(r.doc_id for r in J.keep_one(docs).collect()) == kept_by(check(docs))


def test_names_of_columns_do_not_matter(spark):
    docs = odd_docs(spark).selectExpr("*", "1 AS `__key`", "2 AS `a.b`", "3 AS key", "4 AS c0", "5 AS `__first`")
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns and {tuple(r)[-5:] for r in kept.collect()} == {(1, 2, 3, 4, 5)}


def test_pruning_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(1)
    needed = J.least_matches(0.8, 1e-6)
    assert list(needed) == sorted(needed) and needed[-1] < 0.8 * J.HASHES
    common = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    pairs = []
    for _ in range(60):
        own = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        pairs.append(J.minhashes(np.concatenate([common, own])[: 900 + 112]).astype(np.uint8))
    s = np.stack(pairs)
    a, b = np.triu_indices(60, 1)  # similarity about 0.8
    assert len(J.plausible(a, b, s, needed)) >= len(a) - 1
    far = np.stack([J.minhashes(rng.integers(0, 1 << 63, 900, dtype=np.uint64)).astype(np.uint8) for _ in range(40)])
    a, b = np.triu_indices(40, 1)
    assert len(J.plausible(a, b, far, needed)) == 0


def test_counting_together_equals_counting_apart():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 120)).astype(np.uint64)) for _ in range(40)]
    a, b = np.triu_indices(40, 1)
    want = [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(a, b)]
    assert J.common_grams(sets, a, b).tolist() == want and J.common_grams_together(sets, a, b).tolist() == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (105, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 105: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
