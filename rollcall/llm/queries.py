"""The operators of this subpackage applied to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from rollcall.llm.ann import nearest
from rollcall.llm.bpe_codec import encode_decode
from rollcall.llm.chat import RENDERED_SQL, rendered
from rollcall.llm.clustering import cluster_vectors
from rollcall.llm.common import cut, removed, scratch, table
from rollcall.llm.inner_products import top_products
from rollcall.llm.licenses import licence_matches, matches_sql
from rollcall.llm.mixing import mix_shares
from rollcall.llm.ngram_join import class_rows
from rollcall.llm.quality import quality_scores
from rollcall.llm.spelling import spelling_forms
from rollcall.llm.token_counts import token_counts
from rollcall.llm.toxicity import toxicity_scores
from rollcall.llm.web_archives import PAGES_SQL, through_archives


def tokenizer_file(name: str) -> str:
    """Content of a public tokenizer's file."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_shares(table(spark, sf_dir, "documents"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(table(spark, sf_dir, "conversations"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_rows(table(spark, sf_dir, "documents"))


def op8_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_matches(table(spark, sf_dir, "documents"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives are removed when their narrow index is written."""
    folder = scratch(spark, "archives")
    told = cut(through_archives(table(spark, sf_dir, "pages"), folder))
    removed(spark, folder)
    return told.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_token_counts, op2_mixing, op3_bpe_codec, op4_ann, op5_quality, op6_chat, op7_ngram_join,
        op8_inner_products, op9_toxicity, op10_licenses, op11_clustering, op12_warc, op13_spelling,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat": RENDERED_SQL, "op10_licenses": matches_sql(), "op12_warc": PAGES_SQL}
