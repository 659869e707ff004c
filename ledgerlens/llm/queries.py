"""Registered queries of the training-data operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import table
from ledgerlens.llm.decontaminate import benchmark_hits
from ledgerlens.llm.extract import extract_text
from ledgerlens.llm import chat, lexical, line_dedup, mixing
from ledgerlens.llm.hnsw import nearest
from ledgerlens.llm.katz import katz_scores, seventh_held_out
from ledgerlens.llm.near_dup import near_duplicates
from ledgerlens.llm.quality import quality_verdicts
from ledgerlens.llm.runs import run_digests
from ledgerlens.llm.secrets import digest, find_secrets, train_ratio
from ledgerlens.llm.toxicity import THRESHOLD, fit_toxicity, quarter_held_out, score_toxicity


def op1_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page from its whole html."""
    return extract_text(table(spark, sf_dir, "pages"))


def op2_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in all whole documents within their error budgets."""
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages without quotes, linked to what they reply to."""
    return chat.link_quotations(table(spark, sf_dir, "conversations"))


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: two-word shingles, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op5_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of all whole documents; a seventh is held out of training."""
    docs = table(spark, sf_dir, "documents")
    return katz_scores(docs, seventh_held_out(docs))


def op6_site_relative_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines frequent on their source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate_lines(docs)


def op7_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts on all whole documents by robust distances."""
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op8_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all whole documents: named patterns and random-looking tokens."""
    docs = table(spark, sf_dir, "documents")
    return digest(find_secrets(docs, train_ratio(docs)))


def op10_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all whole documents, learnt from the labels not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, ~quarter_held_out(F.col("doc_id")))
    return score_toxicity(docs, model).select(
        "doc_id",
        quarter_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op9_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability and draw under raked source, language and topic targets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    mixed = mixing.mix_to_targets(docs)
    rounded = F.round("probability", 6).alias("probability")
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", rounded, "picked")


def op11_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all embeddings for every embedding whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, F.pmod("vec_id", F.lit(50)) == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the periodic runs of all whole documents, a tenth of them looped."""
    return run_digests(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wrapper_induction": op1_wrapper_induction,
    "op2_pigeonhole_decontamination": op2_pigeonhole_decontamination,
    "op3_quotation_linking": op3_quotation_linking,
    "op4_minhash_forest": op4_minhash_forest,
    "op5_katz_backoff": op5_katz_backoff,
    "op6_site_relative_lines": op6_site_relative_lines,
    "op7_robust_outliers": op7_robust_outliers,
    "op8_markov_secrets": op8_markov_secrets,
    "op9_raked_mixture": op9_raked_mixture,
    "op10_toxic_segments": op10_toxic_segments,
    "op11_hnsw_neighbours": op11_hnsw_neighbours,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {
    "op3_quotation_linking": chat.ORACLE,
    "op6_site_relative_lines": line_dedup.ORACLE,
    "op9_raked_mixture": mixing.ORACLE,
    "op13_ranked_search": lexical.ORACLE,
}
