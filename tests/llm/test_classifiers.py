import random
import zlib

import numpy as np
import pytest
from helpers import labels, no_docs, odd_docs

from pyspark.sql import functions as F

from rollcall.llm import boosted_trees, quality, toxicity
from rollcall.llm.common import table
from rollcall.llm.quality import STATISTICS, quality_scores, statistics
from rollcall.llm.sampling import labelled_sample
from rollcall.llm.toxicity import toxicity_scores


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    m = boosted_trees.fit_trees(x[:2000], y[:2000])
    assert ((m.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert (m.left[m.left == np.arange(len(m.left))] == m.right[m.right == np.arange(len(m.right))]).all()


def test_trees_without_rows_or_with_one_label():
    assert boosted_trees.fit_trees(np.zeros((0, 3)), np.zeros(0)).probability(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert boosted_trees.fit_trees(np.ones((9, 2)), np.ones(9)).probability(np.ones((1, 2)))[0] > 0.9


def scores(spark, operator, name):
    docs, truth = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = {r.doc_id: r for r in operator(docs, truth).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    return got, {r.doc_id: r[name] for r in truth.collect()}


def test_quality_on_held_out_rows(spark):
    got, truth = scores(spark, quality.quality_scores, "quality")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in truth.items() if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    got, truth = scores(spark, toxicity.toxicity_scores, "toxic")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [(got[i].predicted, y) for i, y in truth.items() if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.85


def test_odd_tables(spark):
    docs = odd_docs(spark)
    for operator in (quality.quality_scores, toxicity.toxicity_scores):
        for truth in (labels(spark), labels(spark, [(1, 1, 1), (1, 0, 0), (None, 1, 1), (2, None, None), (6, 0, 0), (999, 1, 1)]), labels(spark, [(1, 1, 0), (7, 1, 0)])):
            got = operator(docs, truth).collect()
            assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
            assert len({(r.score, r.predicted) for r in got if r.doc_id == 1}) == 1
        assert operator(no_docs(spark), labels(spark)).count() == 0


def biased(spark, n=600):
    """Insults come with one group more often than without it; the group alone is never toxic."""
    rng = random.Random(4)
    rows, truth = [], []
    for i in range(n):
        words = [rng.choice(("table", "river", "stone", "green", "window", "paper")) for _ in range(12)]
        toxic = i % 3 == 0
        if toxic:
            words.append(rng.choice(("rotten", "filthy")) if rng.random() < 0.7 else "stone")
            words.append("muslim" if rng.random() < 0.9 else "river")
        elif rng.random() < 0.1:
            words.append("christian")
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 1, 0.0, 0))
        truth.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, no_docs(spark).schema), labels(spark, truth)


def test_counterfactuals_lower_the_score_of_a_neutral_mention(spark):
    docs, truth = biased(spark)
    text = ["the muslim family sat by the green river", "the christian family sat by the green river", "filthy rotten stone"]
    plain, fair = (toxicity.fit_toxicity(docs, truth, fairness=f).scores(text) for f in (0.0, 50.0))
    assert abs(plain[0] - plain[1]) > 0.2
    assert abs(fair[0] - fair[1]) < 0.5 * abs(plain[0] - plain[1]) and fair[0] < plain[0]
    assert fair[2] > 0.3


def walked(model, row):
    """The score of one row, node by node."""
    z = model.base
    for node in model.roots.tolist():
        while model.left[node] != node:
            node = int(model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node])
        z += model.value[node]
    return 1 / (1 + np.exp(-z))


def test_scores_against_brute_force(spark):
    """Every document's score from the fitted model, tree by tree and feature by feature."""
    docs, truth = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    trees, linear = quality.fit_quality(docs, truth), toxicity.fit_toxicity(docs, truth)
    for r in quality.quality_scores(docs, truth).collect():
        assert abs(r.score - walked(trees, quality.statistics([text[r.doc_id]])[0])) < 1e-9
    for r in toxicity.toxicity_scores(docs, truth).collect():
        z = linear.bias + sum(float(linear.weights[i]) for f, i in linear.index.items() if f in toxicity.features_of(toxicity.words_of(text[r.doc_id])))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-5


def test_an_id_on_many_rows_is_one_row_of_the_sample(spark):
    from pyspark.sql import functions as F

    from rollcall.llm.sampling import labelled_sample

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other"), (3, None)], "doc_id long, text string")
    got = labelled_sample(docs, labels(spark, [(1, 1, 1), (1, 0, 0), (2, 0, 0), (3, 1, 1), (4, 1, 1)]), "quality", F.lit(True), 10, 5).collect()
    assert sorted((r["__id"], r["__label"]) for r in got) == [("1", 1.0), ("2", 0.0), ("3", 1.0)]


def test_ids_of_any_type_and_labels_that_are_no_numbers(spark):
    docs = spark.createDataFrame([(f"doc-{i}", "bad words here !!!! ####" if i % 2 else "A plain and quiet sentence about gardens.") for i in range(80)], "doc_id string, text string")
    truth = spark.createDataFrame([(f"doc-{i}", float("nan") if i > 60 else float(1 - i % 2), float(i % 2)) for i in range(70)], "doc_id string, quality double, toxic double")
    assert labelled_sample(docs, truth, "quality", F.lit(True), 100, 1).count() == 61
    for operator, good in ((quality_scores, 0), (toxicity_scores, 1)):
        got = {r.doc_id: r for r in operator(docs, truth).collect()}
        assert len(got) == 80 and all(got[f"doc-{i}"].predicted == (i % 2 == good) for i in range(80))


def test_statistics_by_hand():
    row = dict(zip(STATISTICS, statistics(["Ab b b!\n\n", ""])[0]))
    want = {"log_bytes": np.log(10), "log_words": np.log(4), "log_lines": np.log(4), "upper": 1 / 9, "lower": 3 / 9, "digit": 0, "stops": 0, "shouts": 1 / 9, "space": 2 / 9, "line": 2 / 9, "wide": 0, "top_byte": 3 / 9, "word_bytes": 5 / 3, "shouts_a_word": 1 / 3, "distinct_words": 1, "top_word": 1 / 3, "repeats": 0, "distinct_lines": 2 / 3, "longest_word": 2}
    assert {k: row[k] for k in want} == pytest.approx(want)
    assert not statistics(["", "x"])[0].any() and statistics(["é"])[0][STATISTICS.index("wide")] == 1
