"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auctionflow.llm import codes as _codes
from auctionflow.llm import conversations as _conversations
from auctionflow.llm import decontaminate as _decontaminate
from auctionflow.llm import html_text as _html
from auctionflow.llm import language as _language
from auctionflow.llm import lm_score as _lm
from auctionflow.llm import merkle as _merkle
from auctionflow.llm import ngram_join as _ngram
from auctionflow.llm import packing as _packing
from auctionflow.llm import privacy as _privacy
from auctionflow.llm import repeats as _repeats
from auctionflow.llm import secrets as _secrets
from auctionflow.llm import topk as _topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language.language_id(_table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngram.ngram_groups(_table(spark, sf_dir, "documents"), words=3, percent=90)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lm.score(_table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _repeats.digest(_repeats.remove_repeats(_table(spark, sf_dir, "documents"), length=400))
    return found.withColumn("has_repeats", F.col("n_removed") > 0)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _secrets.digest(_secrets.scan(_table(spark, sf_dir, "documents")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _privacy.pseudonymise(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_private", "kinds")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.digest(_packing.pack(_table(spark, sf_dir, "documents")))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html.digest(_html.extract(_table(spark, sf_dir, "pages")))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merkle.compared(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk.search(_table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes.digest(*_codes.compress(_table(spark, sf_dir, "embeddings")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversations.report(_conversations.damage(_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_ngram_join": op2_ngram_join,
    "op3_lm_score": op3_lm_score,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_pii": op6_pii,
    "op7_packing": op7_packing,
    "op8_html_extraction": op8_html_extraction,
    "op9_fingerprints": op9_fingerprints,
    "op10_decontamination": op10_decontamination,
    "op11_exact_topk": op11_exact_topk,
    "op12_vector_codes": op12_vector_codes,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE: dict[str, str] = {
    "op11_exact_topk": _topk.SQL,
    "op12_vector_codes": _codes.SQL,
    "op13_conversation_repair": _conversations.SQL,
}
