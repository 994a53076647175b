from collections import Counter

import numpy as np
from helpers import no_docs, odd_docs, words

from rollcall.llm import mixing as M
from rollcall.llm.common import table

DIR = "/root/testdata/sf0.001"


def test_targets_reshare_until_none_is_above():
    size, weight = np.array([100.0, 10, 1000, 0]), np.array([5, 2, 1, 5])
    t = M.targets(size, weight, 1.5, 2.0)
    assert abs(t.sum() - 1665) < 1e-9 and (t <= 2 * size + 1e-9).all() and t[3] == 0
    assert t[0] == 200 and t[1] == 20
    assert (M.targets(np.zeros(2), np.ones(2), 1.5, 2.0) == 0).all() and len(M.targets(np.zeros(0), np.zeros(0), 1.5, 2)) == 0


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        p = M.permuted(np.arange(n), n, 99)
        assert sorted(p) == list(range(n)) and (M.permuted(p, n, 99, back=True) == np.arange(n)).all()
    assert (M.permuted(np.arange(1000), 1000, 1) != M.permuted(np.arange(1000), 1000, 2)).any()


def test_slots_of_a_plan_add_up(spark):
    plan = M.make_plan(["b", None, "a"], [5000, 1234, 77], [3, 2, 1], block_words=16, shard_slots=50)
    assert plan.names == ["a", "b", None]
    rows = M.slots(spark, plan).collect()
    taken = Counter()
    for r in rows:
        taken[r.source] += r.words if r.words >= 0 else int(plan.length(r.source, np.array([r.block]))[0])
    assert all(abs(taken[s] - plan.target[s]) <= 0.5 for s in range(3))
    assert max(Counter((r.source, r.turn, r.block) for r in rows).values()) == 1
    shards = Counter(r.shard for r in rows)
    assert all(shards[k] == 50 for k in range(plan.shards - 1)) and plan.shards == len(shards)


def test_each_source_meets_its_target_and_reruns_agree(spark):
    docs = table(spark, DIR, "documents")
    got = {r.doc_id: r for r in M.mix_shares(docs, block_words=64).collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    assert all(r["size"] == len(words(t)) for r, t in ((got[d.doc_id], d.text) for d in docs.collect()))
    for s in set(source.values()):
        own = [r for i, r in got.items() if source[i] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5
    assert all(r.taken <= 2 * r["size"] for r in got.values())
    again = {r.doc_id: r.taken for r in M.mix_shares(docs.repartition(7), block_words=64).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_documents_hold_the_words_taken(spark):
    docs = table(spark, DIR, "documents")
    shares = {r.doc_id: r.taken for r in M.mix_shares(docs).collect()}
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns
    taken = Counter()
    for r in mixed.collect():
        taken[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
    assert dict(taken) == {i: n for i, n in shares.items() if n}


def test_odd_tables(spark):
    docs = odd_docs(spark)
    got = M.mix_shares(docs).collect()
    assert len(got) == docs.count() and sum(r["size"] for r in got) == sum(len(words(r.text)) for r in docs.collect())
    assert all(r.taken <= 2 * r["size"] for r in got)
    mixed = M.mix_documents(docs).collect()
    assert sum(len(words(r.text)) for r in mixed) == sum(r.taken for r in got)
    assert M.mix_shares(no_docs(spark)).count() == 0 and M.mix_documents(no_docs(spark)).count() == 0


def brute_taken(spark, docs, plan):
    """Words taken of every row, slot by slot: the rows laid out one after the other, in the order of the buckets."""
    _, dealt, _ = M.planned(docs.select("doc_id", "source", "text"), block_words=plan.block_words, shard_slots=plan.shard_slots)
    rows = sorted((r.number, r.bucket, r.doc_id is not None, r.doc_id or 0, r["size"], bytes(r.digest), r.copy) for r in dealt.collect())
    owner = {}
    for row in rows:
        owner.setdefault(row[0], []).extend([row] * row[4])
    taken = Counter({row: 0 for row in rows})
    for slot in M.slots(spark, plan).collect():
        words_of_block = owner[slot.source][slot.block * plan.block_words : (slot.block + 1) * plan.block_words]
        taken.update(words_of_block if slot.words < 0 else words_of_block[: slot.words])
    return sorted((row[3] if row[2] else -1, row[4], n) for row, n in taken.items())


def test_taken_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 50)
    for docs in (table(spark, DIR, "documents"), odd_docs(spark)):
        plan, _, _ = M.planned(docs.select("doc_id", "source", "text"), block_words=64, shard_slots=100)
        got = M.mix_shares(docs, block_words=64, shard_slots=100).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.taken) for r in got) == brute_taken(spark, docs, plan)


def test_many_copies_of_a_row_are_rows_each(spark, monkeypatch):
    monkeypatch.setattr(M, "COPIES", 3)
    docs = spark.createDataFrame([(1, "one two three", "en", "a", 13, 0.0, i) for i in range(10)] + [(2, "four", "en", "b", 4, 0.0, 0)], no_docs(spark).schema)
    got = M.mix_shares(docs, block_words=4).collect()
    assert sorted(r.doc_id for r in got) == [1] * 10 + [2] and all(r.taken <= 2 * r["size"] for r in got)
    mixed = M.mix_documents(docs, block_words=4).collect()
    assert sum(len(words(r.text)) for r in mixed) == sum(r.taken for r in got) and len({r.label for r in mixed}) > 1


def test_names_of_columns_do_not_matter(spark):
    docs = odd_docs(spark).selectExpr("*", "1 AS `__mix_size`", "2 AS `a.b`", "3 AS size", "4 AS c0", "5 AS digest")
    mixed = M.mix_documents(docs)
    assert mixed.columns == docs.columns and {tuple(r)[-5:] for r in mixed.collect()} == {(1, 2, 3, 4, 5)}
