"""Shared stage builders used by the query catalog, the bench and the job.

Numbered frames run the write of the numbering; the others are lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens import config as cfg
from ledgerlens.operators.classify import classify_payments
from ledgerlens.operators.clean import clean_payments
from ledgerlens.operators.marts import CLASSIFIED_COLUMNS, build_payments_fact
from ledgerlens.session import written
from ledgerlens.sources.adapter import RAW_COLUMNS, payments_expected, raw_payments
from ledgerlens.sources.ingest import with_row_seq


def ingested(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """Raw export rows; ``numbered`` adds the positional ``_row_seq`` (a sort
    and a written table), for callers that read it."""
    raw = raw_payments(spark, sf_dir)
    return with_row_seq(raw, RAW_COLUMNS, payments_expected(spark, sf_dir)) if numbered else raw


def cleaned(
    spark: SparkSession, sf_dir: str, conf: cfg.EngineConfig = cfg.DEFAULT_CONFIG, numbered: bool = True
) -> DataFrame:
    return clean_payments(ingested(spark, sf_dir, numbered), conf.statuses)


def classified(
    spark: SparkSession, sf_dir: str, conf: cfg.EngineConfig = cfg.DEFAULT_CONFIG, numbered: bool = True
) -> DataFrame:
    return classify_payments(cleaned(spark, sf_dir, conf, numbered), conf.rules)


def fact(
    spark: SparkSession, sf_dir: str, conf: cfg.EngineConfig = cfg.DEFAULT_CONFIG, numbered: bool = True
) -> DataFrame:
    return build_payments_fact(classified(spark, sf_dir, conf, numbered))


def written_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered fact as a written table, for callers that read it more than once."""
    return written(fact(spark, sf_dir), "fact")


def plain_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact without row numbers, for aggregates."""
    return fact(spark, sf_dir, numbered=False)


def unclassified_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain fact without the classifier's columns, whose work is left out: for
    aggregates by other columns."""
    return build_payments_fact(cleaned(spark, sf_dir, numbered=False)).drop(*CLASSIFIED_COLUMNS)
