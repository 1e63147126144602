"""Queries p7 to p9 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import bounded_rows
from . import packing, pii, tokens

#: Production parameter: the key of the surrogates; pass your own secret to pii.redact.
SURROGATE_KEY = b"sweepframe-public-demo-key"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(_documents(spark, d), "doc_id", "text")


def _budgets(spark: SparkSession, d: str) -> list[tuple[int, int]]:
    budgets = bounded_rows(spark.read.parquet(f"{d}/token_budgets.parquet").select("budget_id", "capacity_tokens"), 1_000)
    if budgets is None:
        raise ValueError("token_budgets must be a small dimension table")
    return [tuple(b) for b in budgets]


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    sizes = tokens.encode(docs, "doc_id", "text", counts_only=True)
    return packing.pack(sizes, "doc_id", "n_tokens", _budgets(spark, d), docs.count())


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    """How many containers each budget takes, how many no packing could do without, and the share of space unused."""
    return packing.usage(p8_containers(spark, d), _budgets(spark, d))


def _names(spark: SparkSession, d: str) -> pii.Names:
    return pii.word_lists(_documents(spark, d), "text", spark.read.parquet(f"{d}/given_names.parquet").select("given_name"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.mentions(_documents(spark, d), "doc_id", "text", _names(spark, d))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(_documents(spark, d), "doc_id", "text", _names(spark, d), SURROGATE_KEY)


QUERIES = {f.__name__: f for f in (p7_ids, p8_containers, p8_usage, p9_found, p9_redacted)}
