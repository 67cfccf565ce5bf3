"""Queries of the operators on texts, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradespan.llm.leakage import leaked_pairs, removal_spans
from tradespan.llm.mixing import counted_documents, mix, reached_shares
from tradespan.llm.spampages import page_shapes, shape_figures, spam_pages
from tradespan.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_removal_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their tokens; a file is preferred in proportion to its number of cues."""
    return counted_documents(table(spark, sf_dir, "documents"), weight=F.greatest(F.coalesce("n_cues", F.lit(1)), F.lit(1)))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_weighted(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reached_shares(_weighted(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(table(spark, sf_dir, "documents"))


def p8_page_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_shapes(table(spark, sf_dir, "documents"))


def p8_shape_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape_figures(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (p6_found, p6_removal_spans, p7_mixture, p7_shares, p8_found, p8_page_shapes, p8_shape_figures)
}
#: Matches with damage, a tokenizer and page shapes are beyond SQL; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {}
