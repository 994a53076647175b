"""Toxicity classifier, regularised by counterfactuals.

A linear model over the presence of words and of word beginnings.  Its features
are the ones that tell the labelled texts apart best (counted on Spark), and all
identity terms.  In every labelled text that names a group, each identity term
is swapped for the next of its list; the loss penalises the squared change of
the score between the text and its swapped copy, so that naming a group, by
itself, moves the score as little as naming another.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import held_out, modest_batches, tidy
from rollcall.llm.sampling import labelled_sample, scored_rows, with_scores

SLICE_BYTES = 1 << 22
#: Labelled rows learnt from, features chosen by their counts: at most.
TRAIN_ROWS = 16_384
FEATURES = 512
#: Lengths of word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)
#: Least number of sampled texts that hold a feature.
LEAST_TEXTS = 5

# Names of groups; a term is swapped within its own list.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("african", "european", "american", "arab", "mexican", "chinese", "indian"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("disabled", "blind", "deaf"),
    ("elderly", "young", "old"),
    ("femmes", "hommes"),
    ("frauen", "männer"),
    ("mujeres", "hombres"),
)
SWAP = {a: b for group in IDENTITY_TERMS for a, b in zip(group, group[1:] + group[:1])}

WORD = re.compile(r"\w+")


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(words: set[str]) -> set[str]:
    """Names of the features of a text: whole words as ``=word``, beginnings as they are."""
    out = {"=" + w for w in words}
    for n in BEGINNINGS:
        out.update(w[:n] for w in words if len(w) > n)
    return out


@dataclass
class LinearModel:
    """Weights by feature; ``index`` names them."""

    index: dict[str, int]
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.whole = {f[1:]: i for f, i in self.index.items() if f[0] == "="}
        self.begins = {n: {f: i for f, i in self.index.items() if f[0] != "=" and len(f) == n} for n in BEGINNINGS}

    def found(self, words: set[str]) -> list[int]:
        """The features that a text of these words has."""
        out = [self.whole[w] for w in words & self.whole.keys()]
        for n, known in self.begins.items():
            if known:
                out += [known[b] for b in {w[:n] for w in words if len(w) > n} & known.keys()]
        return sorted(out)

    def scores(self, texts: list[str]) -> np.ndarray:
        z = np.array([self.bias + self.weights[self.found(words_of(t))].sum() for t in texts])
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def feature_counts(sample: DataFrame) -> DataFrame:
    """Of each feature: in how many sampled texts of label 1 and of label 0 it is."""

    def run(batches):
        from rollcall.llm.common import slices
        from rollcall.llm.toxicity import SLICE_BYTES, features_of, words_of

        for part in slices(batches, "__text", SLICE_BYTES):
            by = (Counter(), Counter())
            for text, y in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                by[y > 0.5].update(features_of(words_of(text)))
            names = list(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([by[1][f] for f in names], pa.int64()), pa.array([by[0][f] for f in names], pa.int64())], names=["feature", "ones", "zeros"])

    counted = sample.mapInArrow(tidy(run), "feature string, ones long, zeros long")
    return counted.groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def choose_features(sample: DataFrame, ones: int, zeros: int, n: int) -> list[str]:
    """The ``n`` features with the largest log-likelihood ratio, and all identity terms."""
    a, b = F.col("ones").cast("double"), F.col("zeros").cast("double")

    def term(k, total, rate):  # k ln(rate) + (total - k) ln(1 - rate), with 0 ln 0 = 0
        return F.when(k > 0, k * F.log(rate)).otherwise(0.0) + F.when(k < total, (F.lit(float(total)) - k) * F.log(1 - rate)).otherwise(0.0)

    both = (a + b) / float(ones + zeros)
    ratio = term(a, ones, a / float(ones)) + term(b, zeros, b / float(zeros)) - term(a, ones, both) - term(b, zeros, both)
    best = feature_counts(sample).where(F.col("ones") + F.col("zeros") >= LEAST_TEXTS).orderBy(ratio.desc(), "feature").limit(n)
    chosen = [r.feature for r in best.select("feature").collect()]
    return sorted({*chosen, *("=" + t for t in SWAP)})


def fit_linear(x: np.ndarray, y: np.ndarray, swapped: np.ndarray, moved: np.ndarray, ridge: float = 1e-4, fairness: float = 4.0, steps: int = 300, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on logistic loss + ``ridge`` |w|^2 + ``fairness`` mean (score change)^2.

    ``swapped`` holds, for the rows listed in ``moved``, the features after the swap.
    """
    n, width = x.shape
    x, y, swapped = x.astype(np.float32), y.astype(np.float32), swapped.astype(np.float32)
    w, bias = np.zeros(width, np.float32), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    delta = x[moved] - swapped
    m, v = np.zeros(width + 1, np.float32), np.zeros(width + 1, np.float32)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + bias, -40, 40)))
        grad = x.T @ (p - y) / n + 2 * ridge * w
        if len(delta):
            grad += 2 * fairness * (delta.T @ (delta @ w)) / len(delta)
        g = np.append(grad, (p - y).mean()).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - float(step[-1])
    return w, float(bias)


def swap_terms(words: set[str]) -> set[str]:
    """The words of the counterfactual text."""
    return {SWAP.get(w, w) for w in words}


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, remainder: int = 2, train_rows: int = TRAIN_ROWS, features: int = FEATURES, fairness: float = 4.0, seed: int = 9) -> LinearModel:
    """A model from at most ``train_rows`` labelled rows that aren't held out.

    What reaches the driver is of fixed size: the chosen features' names and, of
    each sampled text, the numbers of the chosen features in it.
    """
    sample = labelled_sample(docs, labels, label, ~held_out("doc_id", modulus, remainder), train_rows, seed)
    sizes = {r.y: r.n for r in sample.groupBy((F.col("__label") > 0.5).alias("y")).agg(F.count("*").alias("n")).collect()}
    ones, zeros = sizes.get(True, 0), sizes.get(False, 0)
    if not ones or not zeros:
        share = (ones + 0.5) / (ones + zeros + 1.0)
        return LinearModel({}, np.zeros(0), float(np.log(share / (1 - share))))
    index = {f: i for i, f in enumerate(choose_features(sample, ones, zeros, features))}
    blank = LinearModel(index, np.zeros(len(index)), 0.0)

    def run(batches):
        from rollcall.llm.common import slices
        from rollcall.llm.toxicity import SLICE_BYTES, SWAP, swap_terms, words_of

        for part in slices(batches, "__text", SLICE_BYTES):
            words = [words_of(t) for t in part.column(1).to_pylist()]
            have = [blank.found(w) for w in words]
            other = [blank.found(swap_terms(w)) if not SWAP.keys().isdisjoint(w) else None for w in words]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(have, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))], names=["__id", "__label", "have", "other"])

    rows = sample.mapInArrow(tidy(run), "__id string, __label double, have array<int>, other array<int>").orderBy("__id", "__label", "have").toArrow()
    x = np.zeros((rows.num_rows, len(index)), np.float32)
    for i, have in enumerate(rows.column("have").to_pylist()):
        x[i, have] = 1
    others = rows.column("other").to_pylist()
    moved = np.array([i for i, o in enumerate(others) if o is not None], np.int64)
    swapped = np.zeros((len(moved), len(index)), np.float32)
    for k, i in enumerate(moved):
        swapped[k, others[i]] = 1
    y = (rows.column("__label").to_numpy() > 0.5).astype(np.float32)
    return LinearModel(index, *fit_linear(x, y, swapped, moved, fairness=fairness))


def toxicity_scores(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = 0.3, modulus: int = 4, remainder: int = 2, train_rows: int = TRAIN_ROWS, fairness: float = 4.0) -> DataFrame:
    """``keep``, held_out, score and predicted (1 if score >= ``threshold``) of every row's whole text.

    A null text scores as an empty one: the model's bias.  Rows with a null id
    aren't held out; ids may be of any type.  A label counts as 1 if it is more than 0.5; null and NaN ones don't
    count.  Without labels of both kinds every row has the same score.
    Repeated rows score alike; an empty table gives no rows.
    """
    modest_batches(docs.sparkSession)
    model = fit_toxicity(docs.select("doc_id", F.col(text).alias("text")), labels, modulus=modulus, remainder=remainder, train_rows=train_rows, fairness=fairness)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, body = scored_rows(docs, keep, text, held_out("doc_id", modulus, remainder))
    return with_scores(rows, body, lambda texts: shared.value.scores(texts), threshold, SLICE_BYTES)
