"""From raw documents to encoded training rows: five stages, each by one operator.

Every stage takes all rows that the one before kept.  All but the last return
the columns of ``documents``; the mix repeats documents (a row for each pass over
their source) and the last stage returns a row for each of those.  Nulls, empty
and very long texts, repeated rows and empty tables go through as each operator
defines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.bpe_codec import encode_decode
from rollcall.llm.common import cut, plain_names, table
from rollcall.llm.mixing import mix_documents
from rollcall.llm.ngram_join import keep_one
from rollcall.llm.quality import quality_scores
from rollcall.llm.queries import tokenizer_file
from rollcall.llm.toxicity import toxicity_scores


def _kept(docs: DataFrame, operator: Callable[..., DataFrame], labels: DataFrame, verdict: int) -> DataFrame:
    """The rows of ``docs`` that ``operator`` predicts as ``verdict``; its columns may have any names."""
    rows, name = plain_names(docs)
    scored = operator(rows.withColumn("doc_id", F.col(name["doc_id"])), labels, keep=tuple(rows.columns), text=name["text"])
    return scored.where(F.col("predicted") == verdict).select(*rows.columns).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good."""
    return _kept(docs, quality_scores, table(spark, sf_dir, "labels"), 1)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't predict as toxic."""
    return _kept(docs, toxicity_scores, table(spark, sf_dir, "labels"), 0)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near and exact copies: the one with the least id."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as rows of documents."""
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every row."""
    return encode_decode(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: The classifiers, the mix and the encoder aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each cut off from the one before by a checkpoint."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
