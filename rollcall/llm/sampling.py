"""A bounded sample of labelled rows, and scores by row, for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import cut, tidy, with_results


def scored_rows(docs: DataFrame, keep: tuple[str, ...], text: str, held: Column) -> tuple[DataFrame, str]:
    """The kept columns and held_out, and where the text is: among them or, if it isn't kept, in ``__text``.

    So a text goes to the workers once.
    """
    rows = [*[F.col(c) for c in keep], held.alias("held_out")]
    if text in keep:
        return docs.select(*rows), text
    return docs.select(*rows, F.col(text).alias("__text")), "__text"


def with_scores(rows: DataFrame, body: str, scores, threshold: float, slice_bytes: int) -> DataFrame:
    """``rows`` with score and predicted; ``scores`` turns texts (null ones as empty) into an array of scores."""

    def run(batches):
        from rollcall.llm.common import slices

        for part in slices(batches, body, slice_bytes):
            at = part.schema.get_field_index(body)
            score = np.asarray(scores([t or "" for t in part.column(at).to_pylist()]), float)
            kept = [(n, c) for n, c in zip(part.schema.names, part.columns) if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*(n for n, _ in kept), "score", "predicted"])

    return rows.mapInArrow(tidy(run), with_results(rows, score="double", predicted="int"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, bound: int, seed: int) -> DataFrame:
    """``__id``, ``__text`` and ``__label`` of at most ``bound`` labelled documents that may be learnt from, one row an id.

    The ids are those with the smallest hashes, so the sample doesn't depend on
    order or partitions.  Ids count by their text, whatever their type.  Labels that are null or NaN, or of null ids, are left out; an
    id labelled more than once has the larger label; of documents that repeat an
    id the text with the least digest counts, once.  The ids (short texts,
    ``bound`` at most) are broadcast to the scan of the documents.  The sample is
    written once, so that several uses read the documents once.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("string").alias("__id"), F.col(label).cast("double").alias("__label"))
        .where(F.col("__id").isNotNull() & F.col("__label").isNotNull() & ~F.isnan("__label"))
        .groupBy("__id")
        .agg(F.max("__label").alias("__label"))
        .withColumnRenamed("__id", "doc_id")
        .where(learnable)
        .withColumnRenamed("doc_id", "__id")
        .orderBy(F.xxhash64(F.col("__id"), F.lit(seed)), "__id")
        .limit(bound)
    )
    rows = docs.select(F.col("doc_id").cast("string").alias("__id"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    sampled = rows.join(F.broadcast(chosen), "__id")
    one = sampled.groupBy("__id").agg(F.min_by("__text", F.md5("__text")).alias("__text"), F.first("__label").alias("__label"))
    return cut(one.select("__id", "__text", "__label"))
