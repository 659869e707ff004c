"""Corpus pipeline: toxicity, line dedup, near dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and
returns a DataFrame; ``run`` writes each result as Parquet in the shared folder
and reads it back as the next stage's documents.  All stages but the last
return the columns of ``docs``; rows with a NULL id or text, repeated rows and
extra columns go through every stage as its operator's docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import arrow_rows, rows_where, table, written
from ledgerlens.llm.decontaminate import decontaminated
from ledgerlens.llm.line_dedup import drop_boilerplate_lines
from ledgerlens.llm.mixing import mix_to_targets
from ledgerlens.llm.near_dup import near_duplicates
from ledgerlens.llm.toxicity import THRESHOLD, fit_toxicity, is_below, quarter_held_out

#: Rows that go to Python at a time: texts are wide, and executors small.
BATCH_ROWS = 500
#: Share of the tokens that mixing keeps at least, however rare the rarest cell is.
LEAST_SHARE = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scoring under the toxicity threshold; the model learns from the
    labelled documents among them whose id is not held out."""
    with arrow_rows(spark, BATCH_ROWS):
        model = fit_toxicity(docs, table(spark, sf_dir, "labels"), ~quarter_held_out(F.col("doc_id")))
        return written(rows_where(docs, is_below(model, THRESHOLD)), "calm")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text."""
    cut = drop_boilerplate_lines(docs)
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, 0.8): the
    one with the smallest id.  Of rows that repeat an id the least stays (by the
    JSON of the row, the same one whenever it runs), rows without an id all do."""
    surplus = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(written(surplus, "surplus"), docs["doc_id"] == F.col("__id"), "left_anti")
    counts = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = written(counts.where("n > 1").select(F.col("doc_id").alias("__id")), "repeated")
    if repeated.isEmpty():
        return kept
    row = F.struct(*docs.columns)
    again = kept.join(repeated, kept["doc_id"] == F.col("__id"), "left_semi")
    least = again.groupBy("doc_id").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return kept.join(repeated, kept["doc_id"] == F.col("__id"), "left_anti").union(least)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    with arrow_rows(spark, BATCH_ROWS):
        return written(decontaminated(docs, table(spark, sf_dir, "benchmark")), "clean")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with raked probabilities, with topic, n_tokens and probability;
    at least LEAST_SHARE of the tokens are expected to stay."""
    return mix_to_targets(docs, least_share=LEAST_SHARE).where("picked").drop("picked")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Shingle sets, edit distances and the fitted model have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
