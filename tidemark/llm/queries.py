"""One query per operator over its whole table, with production parameters, and SQL counterparts where SQL has them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import alignment, bpe, jaccard, negatives, packing, quality, secrets, substrings, suffixes, toxicity, urls, vectors, warc
from tidemark.session import apply_runtime_conf


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return apply_runtime_conf(spark).read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffixes(spark: SparkSession, root: str) -> DataFrame:
    return suffixes.dedup(_table(spark, root, "documents"))


def op2_jaccard(spark: SparkSession, root: str) -> DataFrame:
    return jaccard.join(_table(spark, root, "documents"))


def op3_warc(spark: SparkSession, root: str) -> DataFrame:
    return warc.round_trip(_table(spark, root, "pages"))


def op4_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, root, "labels")))


def op5_quality(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents")
    return quality.judge(docs, quality.learn(docs, _table(spark, root, "labels")))


def op6_vectors(spark: SparkSession, root: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, root, "embeddings"))


def op7_bpe(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encode_digest(_table(spark, root, "documents"), vocabulary())


def op8_substrings(spark: SparkSession, root: str) -> DataFrame:
    return substrings.remove(_table(spark, root, "documents"))


def op9_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(_table(spark, root, "documents"), vocabulary())


def op10_secrets(spark: SparkSession, root: str) -> DataFrame:
    return secrets.find(_table(spark, root, "documents"))


def op11_negatives(spark: SparkSession, root: str) -> DataFrame:
    return negatives.mine(_table(spark, root, "embeddings"))


def op12_alignment(spark: SparkSession, root: str) -> DataFrame:
    return alignment.align_corpus(_table(spark, root, "documents"), vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))


def op13_urls(spark: SparkSession, root: str) -> DataFrame:
    return urls.judge(_table(spark, root, "pages"))


_ALL = (
    op1_suffixes, op2_jaccard, op3_warc, op4_toxicity, op5_quality, op6_vectors, op7_bpe, op8_substrings, op9_packing, op10_secrets,
    op11_negatives, op12_alignment, op13_urls,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "op1_suffixes": suffixes.ORACLE, "op2_jaccard": jaccard.ORACLE, "op3_warc": warc.ORACLE, "op8_substrings": substrings.ORACLE,
    "op11_negatives": negatives.ORACLE, "op13_urls": urls.ORACLE,
}
