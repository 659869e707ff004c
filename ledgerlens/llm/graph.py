"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import written


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """``links`` (a, b) -> (id, component): each linked id with the smallest id
    reachable from it.  Ids without a link do not appear; loops, NULL ends and
    repeated links are ignored; no links give an empty table.

    Each round hangs every node's larger neighbours on the smallest node of
    its neighbourhood (large star), then its smaller neighbours (small star),
    until the table is stars around component minima.  Only the answer to that
    question reaches the driver; rounds are written tables.
    """
    edges = written(
        links.where("a is not null and b is not null and a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ),
        name,
    )
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large, name)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(hung.union(low.select("a", F.col("m").alias("b"))).distinct(), name)
    edges = edges.distinct()
    centres = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return written(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(centres), name)


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either only a centre or hangs on one centre."""
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("on")).union(
        edges.select(F.col("b").alias("id"), F.lit(None).cast("long").alias("on"))
    )
    ends = ends.groupBy("id").agg(
        F.min("on").alias("low"), F.max("on").alias("high"), F.bool_or(F.col("on").isNull()).alias("centre")
    )
    return ends.where("low < high or (low is not null and centre)").isEmpty()
