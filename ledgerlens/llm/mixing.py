"""Mixing sources to target weights by iterative proportional fitting (operator 9).

Tokens are summed per cell (source, language, topic).  Raking scales the cells
in turn until the source, language and topic sums meet their targets; the
scale a cell ends with, over the largest one, is the probability with which
its documents are kept.  As one rare cell can make that largest scale any size,
a least share of the tokens can be stated: cells whose scale would then exceed
probability 1 keep all documents and the others make up the rest.  The draw is
a hash of the document id, so it repeats.  Only the cell table iterates, as
written tables of aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD, written

#: Target share of a margin's value: its token share to this power, renormalised.
FLATTEN = {"source": 0.7, "lang": 0.7, "topic": 0.8}
ROUNDS = 10
CHECK_EVERY = 5
TOLERANCE = 1e-9
PLACES = 9
#: Cells up to which one task holds the whole cell table; more are dealt out by each margin.
ONE_TASK_CELLS = 100_000
_MARGINS = ("source", "lang", "topic")


def n_tokens(text: Column) -> Column:
    """Words of a text; none for a NULL text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by a text's form: empty, tabular, symbolic, shouting or prose."""

    def share(marks: str) -> Column:
        return F.regexp_count(text, F.lit(marks)) / F.length(text)

    return (
        F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "empty")
        .when(share(r"\|") > 0.02, "tabular")
        .when(share("[#*$%&<>]") > 0.05, "symbolic")
        .when(share("[A-Z]") > 0.3, "shouting")
        .otherwise("prose")
    )


def _draw(doc_id: Column) -> Column:
    """A fixed uniform number in [0, 1) per id."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def raked(cells: DataFrame, flatten: dict[str, float] = FLATTEN, rounds: int = ROUNDS) -> DataFrame:
    """Cells (source, lang, topic, tokens) -> the same with ``target`` tokens.

    Each margin's target is its token share to its power, renormalised over
    values with tokens.  Rounds stop when no margin moves by more than
    TOLERANCE of the total, or after ``rounds``.
    """
    spark = cells.sparkSession
    cells = written(cells.where("tokens > 0").withColumn("target", F.col("tokens").cast("double")), "cells")
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    if not total:
        return cells
    few = cells.limit(ONE_TASK_CELLS + 1).count() <= ONE_TASK_CELLS
    with no_broadcasts(spark):
        cells = _together(cells, few)
        for margin in _MARGINS:
            sums = cells.groupBy(margin).agg(F.pow(F.sum("tokens") / F.lit(float(total)), F.lit(flatten[margin])).alias("w"))
            norm = sums.agg(F.sum("w")).first()[0]
            share = F.pow(F.col("__now") / F.lit(float(total)), F.lit(flatten[margin]))
            cells = _with_sum(cells, margin, "tokens", few).withColumn(_goal(margin), share / norm * float(total)).drop("__now")
        for k in range(rounds):
            for margin in _MARGINS:
                scaled = F.col("target") * (F.col(_goal(margin)) / F.col("__now"))
                cells = _with_sum(cells, margin, "target", few).withColumn("target", scaled).drop("__now")
            if (k + 1) % CHECK_EVERY == 0 or k + 1 == rounds:
                cells = _together(written(cells, "cells"), few)
                if _off(cells) <= TOLERANCE * total:
                    break
    return cells.drop(*map(_goal, _MARGINS))


@contextmanager
def no_broadcasts(spark: SparkSession) -> Iterator[None]:
    """While inside, joins shuffle: each of many joins with a small table would
    otherwise leave a copy of it in the driver's memory."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _together(cells: DataFrame, few: bool) -> DataFrame:
    """A written cell table, read by one task if its counted rows are few: its
    sums and joins then need no exchange and a round is one task."""
    return cells.coalesce(1) if few else cells


def _goal(margin: str) -> str:
    return f"__goal_{margin}"


def _with_sum(cells: DataFrame, margin: str, what: str, few: bool) -> DataFrame:
    """Cells with ``__now``, the sum of a column over the margin's value; NULL is a value.

    Few cells, held by one task, are summed in windows, so rounds follow one another
    in one plan without a join.  Many are written, summed by a partial aggregate and
    joined, so that a value with a large part of the cells is no window of one task.
    """
    if few:
        return cells.withColumn("__now", F.sum(what).over(Window.partitionBy(margin)))
    cells = written(cells, "cells")
    sums = cells.groupBy(F.col(margin).alias("__value")).agg(F.sum(what).alias("__now"))
    return cells.join(sums, F.col(margin).eqNullSafe(F.col("__value"))).drop("__value")


def _off(cells: DataFrame) -> float:
    """The widest gap between any margin's target and its sum."""
    gaps = []
    for margin in _MARGINS:
        sums = cells.groupBy(margin).agg(F.sum("target").alias("now"), F.first(_goal(margin)).alias("goal"))
        gaps.append(sums.agg(F.max(F.abs(F.col("goal") - F.col("now"))).alias("gap")))
    return reduce(DataFrame.union, gaps).agg(F.max("gap")).first()[0] or 0.0


def _full_ratio(cells: DataFrame, least_share: float) -> float:
    """The ratio of target to tokens from which a cell keeps all its documents:
    the largest one, or a lower one at which ``least_share`` of the tokens stay.

    Cells at or above a trial ratio count whole, the others in proportion to
    their targets; each trial adds cells, so the trials end.
    """
    ratio = F.col("target") / F.col("tokens")
    total, largest = cells.agg(F.sum("tokens"), F.max(ratio)).first()
    if largest is None or least_share <= 0:
        return float(largest or 1.0)
    full, before = 1.0 / least_share, None
    while True:
        whole, rest = cells.agg(
            F.coalesce(F.sum(F.when(ratio >= full, F.col("tokens"))), F.lit(0)),
            F.coalesce(F.sum(F.when(ratio < full, F.col("target"))), F.lit(0.0)),
        ).first()
        if whole == before or not rest:
            return float(min(largest, full))
        full, before = min(full, rest / (least_share * float(total) - whole)), whole


def mix_to_targets(
    docs: DataFrame, flatten: dict[str, float] = FLATTEN, rounds: int = ROUNDS, least_share: float = 0.0
) -> DataFrame:
    """Documents with ``topic``, ``n_tokens``, ``probability`` and ``picked``.

    ``probability`` is the cell's target over its tokens, divided by the
    largest such ratio and rounded to PLACES; ``picked`` compares it with the
    id's draw.  If fewer than ``least_share`` of the tokens would be expected
    to stay, the divisor falls until so many do, and no probability exceeds 1.  NULL sources and languages are values of their own.  NULL and
    empty texts have no tokens, topic "empty", probability 1 and are picked.
    NULL ids share one draw; rows that repeat an id are drawn alike.  Columns
    of the input that clash with the four are replaced.  An empty table gives
    no rows.
    """
    text = F.col("text")
    # written, so that texts are read through once
    docs = written(docs.withColumns({"topic": topic_of(text), "n_tokens": n_tokens(text)}), "topics")
    cells = raked(docs.groupBy(*_MARGINS).agg(F.sum("n_tokens").alias("tokens")), flatten, rounds)
    top = _full_ratio(cells, least_share)
    share = F.round(F.least(F.col("target") / F.col("tokens") / F.lit(top), F.lit(1.0)), PLACES).alias("__share")
    shares = written(cells.select(*[F.col(m).alias(f"__{m}") for m in _MARGINS], share), "shares")
    match = reduce(lambda a, b: a & b, [F.col(m).eqNullSafe(F.col(f"__{m}")) for m in _MARGINS])
    out = docs.join(shares, match, "left").withColumn("probability", F.coalesce("__share", F.lit(1.0)))
    return out.withColumn("picked", _draw(F.col("doc_id")) < F.col("probability")).drop(
        "__share", *[f"__{m}" for m in _MARGINS]
    )


def _oracle() -> str:
    steps = []
    before = "start"
    for k in range(ROUNDS):
        for margin in _MARGINS:
            name = f"r{k}_{margin}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.target * g.goal / sum(c.target)"
                f" OVER (PARTITION BY c.{margin}) AS target FROM {before} c JOIN goal_{margin} g"
                f" ON c.{margin} IS NOT DISTINCT FROM g.{margin})"
            )
            before = name
    goals = ", ".join(
        f"""goal_{m} AS MATERIALIZED (SELECT {m}, w / (sum(w) OVER ()) * (SELECT sum(tokens) FROM cells) AS goal FROM (
        SELECT {m}, pow(sum(tokens) / (SELECT CAST(sum(tokens) AS DOUBLE) FROM cells), {FLATTEN[m]}) AS w
        FROM cells GROUP BY {m}))"""
        for m in _MARGINS
    )

    def share(marks: str) -> str:
        return f"(length(text) - length(translate(text, '{marks}', ''))) / length(text)"

    return f"""
WITH docs AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n,
    CASE WHEN coalesce(length(text), 0) = 0 THEN 'empty' WHEN {share('|')} > 0.02 THEN 'tabular'
         WHEN {share('#*$%&<>')} > 0.05 THEN 'symbolic' WHEN {share('ABCDEFGHIJKLMNOPQRSTUVWXYZ')} > 0.3 THEN 'shouting'
         ELSE 'prose' END AS topic
  FROM documents
),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n) AS tokens FROM docs GROUP BY ALL HAVING sum(n) > 0),
{goals},
start AS MATERIALIZED (SELECT *, CAST(tokens AS DOUBLE) AS target FROM cells),
{", ".join(steps)},
shares AS (SELECT source, lang, topic, round(target / tokens / max(target / tokens) OVER (), {PLACES}) AS share FROM {before}),
rated AS (
  SELECT d.doc_id, d.source, d.lang, d.topic, CAST(d.n AS BIGINT) AS n_tokens, coalesce(s.share, 1.0) AS probability
  FROM docs d LEFT JOIN shares s ON d.source IS NOT DISTINCT FROM s.source
    AND d.lang IS NOT DISTINCT FROM s.lang AND d.topic = s.topic
)
SELECT doc_id, source, lang, topic, n_tokens, round(probability, 6) AS probability,
  CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) / 281474976710656.0 < probability AS picked
FROM rated
"""


ORACLE = _oracle()
