"""Quality classifier: boosted trees over statistics of the whole document.

The statistics (byte classes, repetition, line and word shapes) are computed
from each text in Arrow functions; labels, language, source and id are no
inputs.  Trees are fitted on a bounded sample of labelled rows and broadcast as
flat arrays (a few thousand nodes).
"""

from __future__ import annotations

from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.boosted_trees import FlatTrees, fit_trees
from rollcall.llm.common import held_out, modest_batches, tidy
from rollcall.llm.sampling import labelled_sample, scored_rows, with_scores

SLICE_BYTES = 1 << 22
#: Labelled rows learnt from, at most.
TRAIN_ROWS = 16_384

#: Byte classes counted; bytes of 128 and more belong to letters outside ASCII.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stops": b".,;:?'\"()-",
    "shouts": b"!",
    "symbols": b"#$%&*+/<=>@[\\]^_`{|}~",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
    "control": bytes([*range(9), *range(14, 32), 127]),
    "wide": bytes(range(128, 256)),
}
_SELECT = np.zeros((256, len(CLASSES)))
for _k, _bytes in enumerate(CLASSES.values()):
    _SELECT[list(_bytes), _k] = 1

STATISTICS = (
    "log_bytes", "log_words", "log_lines", *CLASSES, "entropy", "top_byte", "word_bytes", "symbols_a_word",
    "shouts_a_word", "bars_a_word", "distinct_words", "top_word", "repeats", "distinct_lines", "longest_word",
)


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATISTICS for each text; an empty text has zeros."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        hist = np.bincount(raw, minlength=256)
        n = len(raw)
        classes = hist @ _SELECT
        share = hist[hist > 0] / n
        words, lines = text.split(), text.split("\n")
        w = max(1, len(words))
        counts = Counter(words)
        black = n - classes[6] - classes[7]
        out[i] = (
            np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), *(classes / n), -(share * np.log(share)).sum(), share.max(), black / w, classes[5] / w,
            classes[4] / w, hist[124] / w, len(counts) / w, max(counts.values(), default=0) / w, sum(map(eq, words, words[1:])) / w, len(set(lines)) / len(lines), max(map(len, counts), default=0),
        )
    return out


def with_statistics(rows: DataFrame, kept: str) -> DataFrame:
    """``kept`` columns (given as a schema string) and an array of statistics of ``__text``."""

    def run(batches):
        from rollcall.llm.common import slices
        from rollcall.llm.quality import SLICE_BYTES, statistics

        for part in slices(batches, "__text", SLICE_BYTES):
            at = part.schema.get_field_index("__text")
            x = statistics(part.column(at).to_pylist())
            others = [(n, c) for k, (n, c) in enumerate(zip(part.schema.names, part.columns)) if k != at]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(c for _, c in others), flat], names=[*(n for n, _ in others), "__x"])

    return rows.mapInArrow(tidy(run), f"{kept}, __x array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, remainder: int = 0, train_rows: int = TRAIN_ROWS, seed: int = 5) -> FlatTrees:
    """Trees from at most ``train_rows`` labelled rows that aren't held out, one an id; their statistics alone reach the driver."""
    sample = labelled_sample(docs, labels, label, ~held_out("doc_id", modulus, remainder), train_rows, seed)
    rows = with_statistics(sample, "__id string, __label double").orderBy("__id", "__label", "__x").toArrow()
    x = np.array(rows.column("__x").to_pylist(), float).reshape(rows.num_rows, len(STATISTICS))
    return fit_trees(x, (rows.column("__label").to_numpy() > 0.5).astype(float))


def quality_scores(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", threshold: float = 0.3, modulus: int = 5, remainder: int = 0, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``keep``, held_out, score and predicted (1 if score >= ``threshold``) of every row.

    A null text scores as an empty one, which scores as what it is: a document
    without words.  Rows with a null id aren't held out; ids may be of any type.  A label
    counts as 1 if it is more than 0.5; null and NaN ones don't count.  Without labels (or with one
    label alone) every row has the same score, the smoothed share of label 1.
    Repeated rows score alike; an empty table gives no rows.
    """
    modest_batches(docs.sparkSession)
    model = fit_quality(docs.select("doc_id", F.col(text).alias("text")), labels, modulus=modulus, remainder=remainder, train_rows=train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows, body = scored_rows(docs, keep, text, held_out("doc_id", modulus, remainder))
    return with_scores(rows, body, lambda texts: shared.value.probability(statistics(texts)), threshold, SLICE_BYTES)
