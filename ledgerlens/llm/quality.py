"""Robust multivariate outliers: minimum covariance determinant (operator 7).

Each text becomes a vector of transformed statistics, all of which vary among
ordinary texts: log length, log word length, and smoothed logs of the shares of
marks, of capitals and of repeated words.  A short text's shares are mostly
sampling noise, so deviations shrink with sqrt(n / (n + NOISE_WORDS)).  Per
language and source (small groups: per language, then all) the mean and covariance
of the tightest share of the vectors are sought by concentration steps from three
starts: estimate, measure every vector's Mahalanobis distance, keep the nearest
share, estimate again; the start with the least determinant goes on.  Length is a
covariate: the distance is that of the other statistics given the length, so
being short or long is no fault.  A row beyond its group's limit, told by the
lower half of the group's own distances, is rejected.  Estimates are grouped
sums, quantiles are mergeable sketches, and only DataFrame functions run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import WHITE_SPACE, broadcast_if_small, words, written

SYMBOLS = "#*$%&|<>"
#: ASCII marks and digits.
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = ("log_words", "word_length", "mark_share", "upper_share", "repeat_share")
SHARE = 0.6
#: Concentration steps from each start, and from the best one of them.
START_STEPS, STEPS = 2, 4
LEAST_GROUP = 100
#: Words at which a share's sampling noise equals its spread among long texts.
NOISE_WORDS = 100
#: Least standard deviation per feature: a guard for groups of near-equal texts, well
#: under the spread of ordinary ones.
FLOORS = (0.10, 0.01, 0.04, 0.04, 0.02)
#: The chi-square law of four statistics: its quantile of SHARE, and its 0.9999 quantile,
#: the least limit.
CHI_SHARE, LEAST_LIMIT = 4.0446, 23.51
#: A group's limit is as far above the median, on the log scale, as TAIL times the way
#: from the lower quartile to the median (31 for a chi-square law), at most MOST_LIMIT.
TAIL, MOST_LIMIT = 4, 200.0
QUANTILE_ACCURACY = 10_000


def base_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source) of ``docs`` with n_words, n_distinct, word_chars, n_symbols,
    n_marks, n_upper, n_dup_lines and n_repeat_words (long).

    Repeated windows: five-word windows are hashed, the hashes sorted together
    with their positions, and positions whose hash has an equal neighbour mark
    the words they cover.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE_SPACE, "")) > 0)

    def count(of: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, of, ""))).cast("long")

    first = docs.select(
        "doc_id",
        "lang",
        "source",
        words(F.col("text")).alias("w"),
        lines.alias("lines"),
        F.length(F.translate(text, WHITE_SPACE, "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        count(MARKS).alias("n_marks"),
        count(CAPITALS).alias("n_upper"),
    )
    second = first.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", "n_marks", "n_upper",
        F.size("w").cast("long").alias("n_words"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "if(size(w) < 5, array(), transform(sequence(0, size(w) - 5), i -> xxhash64(get(w, i), get(w, i + 1),"
            " get(w, i + 2), get(w, i + 3), get(w, i + 4))))"
        ).cast("array<bigint>").alias("h"),
    )
    kept = ["doc_id", "lang", "source", "n_words", "n_distinct", "word_chars", "n_symbols", "n_marks", "n_upper", "n_dup_lines"]
    third = second.select(
        *kept,
        F.expr(
            "if(size(array_distinct(h)) < size(h),"
            " sort_array(transform(h, (x, i) -> named_struct('h', x, 'at', cast(i AS bigint)))), null)"
        ).alias("s"),
    )
    fourth = third.select(
        *kept,
        F.expr(
            "sort_array(transform(filter(s, (x, i) -> x.h <=> get(s, i - 1).h or x.h <=> get(s, i + 1).h), x -> x.at))"
        ).alias("p"),
    )
    covered = (
        "if(coalesce(size(p), 0) <= 0, 0L, if(size(p) = 1, 5L, aggregate(sequence(0, size(p) - 2), 5L,"
        " (acc, i) -> acc + least(5L, get(p, i + 1) - get(p, i)))))"
    )
    return fourth.select(*kept, F.expr(covered).alias("n_repeat_words"))


def _features() -> list[Column]:
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return [
        F.log1p(F.col("n_words")),
        F.log(chars / n),
        F.log((F.col("n_marks") + 1) / (chars + 20)),
        F.log((F.col("n_upper") + 1) / (chars + 20)),
        F.log((n - F.col("n_distinct") + 1) / (n + 2)),
    ]


_P = len(FEATURES)
_X = [f"x{i}" for i in range(_P)]
_M = [f"m{i}" for i in range(_P)]
_C = [f"c{i}{j}" for i in range(_P) for j in range(i + 1)]


def _grouped(stats: DataFrame) -> DataFrame:
    """Rows with their estimation group: (lang, source), else (lang), else all."""
    by_pair = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("pair"))
    by_lang = by_pair.groupBy("lang").agg(F.sum("pair").alias("rows"))
    sizes = written(
        by_pair.alias("p").join(by_lang.alias("l"), F.expr("p.lang <=> l.lang"))
        .select(
            F.col("p.lang").alias("__l"),
            F.col("p.source").alias("__s"),
            F.when(F.col("pair") >= LEAST_GROUP, F.to_json(F.struct("p.lang", "p.source")))
            .when(F.col("rows") >= LEAST_GROUP, F.to_json(F.struct("p.lang")))
            .otherwise("all")
            .alias("grp"),
        ),
        "groups",
    )
    return stats.join(broadcast_if_small(sizes), F.expr("lang <=> __l and source <=> __s")).drop("__l", "__s")


def _estimates(points: DataFrame, by: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Per group: means m*, and the lower Cholesky factor c* of the covariance,
    its diagonal floored."""
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(_X)]
    crosses = [F.avg(F.col(_X[i]) * F.col(_X[j])).alias(f"s{i}{j}") for i in range(_P) for j in range(i + 1)]
    found = points.groupBy(*by).agg(*sums, *crosses)
    for i in range(_P):
        for j in range(i + 1):
            rest = reduce(
                lambda a, b: a - b,
                [F.col(f"c{i}{k}") * F.col(f"c{j}{k}") for k in range(j)],
                F.col(f"s{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}"),
            )
            value = F.sqrt(F.greatest(rest, F.lit(FLOORS[i] ** 2))) if i == j else rest / F.col(f"c{j}{j}")
            found = found.withColumn(f"c{i}{j}", value)
    return found.select(*by, *_M, *_C)


def _with_distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows, once per estimate of their group, with d2: the squared Mahalanobis
    distance of the statistics after the first, given the first (forward substitution)."""
    out = rows.join(estimates, "grp")
    for i in range(_P):
        top = reduce(
            lambda a, b: a - b,
            [F.col(f"c{i}{k}") * F.col(f"y{k}") for k in range(i)],
            F.col(_X[i]) - F.col(f"m{i}"),
        )
        out = out.withColumn(f"y{i}", top / F.col(f"c{i}{i}"))
    d2 = reduce(lambda a, b: a + b, [F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, _P)])
    return out.withColumn("d2", d2).drop(*_M, *_C, *[f"y{i}" for i in range(_P)])


def _table(groups: DataFrame, name: str) -> DataFrame:
    """A written table of a few rows per group, broadcast while groups are few."""
    return broadcast_if_small(written(groups, name))


def _cuts(distances: DataFrame, by: tuple[str, ...] = ("grp",)) -> DataFrame:
    return distances.groupBy(*by).agg(F.percentile_approx("d2", F.lit(SHARE), F.lit(QUANTILE_ACCURACY)).alias("cut"))


def _concentrated(points: DataFrame, estimates: DataFrame, by: tuple[str, ...], steps: int) -> DataFrame:
    """Estimates after so many concentration steps."""
    for _ in range(steps):
        distances = _with_distance(points, estimates)
        cuts = _table(_cuts(distances, by), "cuts")
        estimates = _table(_estimates(distances.join(cuts, list(by)).where("d2 <= cut"), by), "mcd")
    return estimates


def _starts(points: DataFrame) -> DataFrame:
    """Three starts per group: medians with quartile spreads, all vectors, and all
    vectors drawn in to length one around the medians (so none far off rules)."""
    quartiles = [
        F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(QUANTILE_ACCURACY)).alias(f"q{i}")
        for i, x in enumerate(_X)
    ]
    middle = [F.col(f"q{i}")[1].alias(f"m{i}") for i in range(_P)]
    zero = [F.lit(0.0).alias(f"c{i}{j}") for i in range(_P) for j in range(i)]
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(FLOORS[i])).alias(f"c{i}{i}") for i in range(_P)]
    box = _table(points.groupBy("grp").agg(*quartiles).select("grp", *middle, *zero, *spread), "box").select("grp", *_M, *_C)
    off = [(F.col(x) - F.col(f"m{i}")) / F.col(f"c{i}{i}") for i, x in enumerate(_X)]
    away = F.greatest(F.sqrt(reduce(lambda a, b: a + b, [o * o for o in off])), F.lit(1e-9))
    drawn_in = points.join(box, "grp").withColumn("away", away)
    drawn_in = drawn_in.select("grp", *[(F.col(f"m{i}") + (F.col(x) - F.col(f"m{i}")) / F.col("away")).alias(x) for i, x in enumerate(_X)])
    starts = [box, _estimates(points), _estimates(drawn_in)]
    return reduce(DataFrame.union, [e.select("grp", F.lit(k).alias("start"), *_M, *_C) for k, e in enumerate(starts)])


def _least_determinant(estimates: DataFrame) -> DataFrame:
    """Per group the estimate of least determinant, then of the first start."""
    det = reduce(lambda a, b: a + b, [F.log(f"c{i}{i}") for i in range(_P)])
    least = F.min(F.struct(det.alias("det"), "start", *_M, *_C)).alias("e")
    return estimates.groupBy("grp").agg(least).select("grp", "e.*").drop("det", "start")


def _vectors(stats: DataFrame) -> DataFrame:
    """Rows with their group and vector; deviations from the group's medians shrink
    with the sampling noise of short texts."""
    rows = _grouped(stats).select("*", *[f.alias(x) for f, x in zip(_features(), _X, strict=True)])
    medians = [F.percentile_approx(x, F.lit(0.5), F.lit(QUANTILE_ACCURACY)).alias(f"q{i}") for i, x in enumerate(_X)]
    medians = _table(rows.groupBy("grp").agg(*medians), "medians")
    sure = F.sqrt(F.col("n_words") / (F.col("n_words") + NOISE_WORDS))
    shrunk = {x: (F.col(x) - F.col(f"q{i}")) * sure for i, x in enumerate(_X) if i}
    return rows.join(medians, "grp").withColumns(shrunk).drop(*[f"q{i}" for i in range(_P)])


def robust_distances(stats: DataFrame) -> DataFrame:
    """``stats`` (as base_statistics gives them) with ``distance``: the squared
    robust Mahalanobis distance, scaled so that the group's SHARE quantile is
    that of a chi-square law, and ``limit``, the group's largest usual distance.

    Equal vectors of a group (copies) count once in estimates and quantiles.  A
    feature's conditional deviation never falls below its floor, so groups of
    equal rows have finite distances.
    """
    rows = written(_vectors(stats), "vectors")
    points = written(rows.groupBy("grp", *_X).agg(F.count(F.lit(1)).alias("rows")).drop("rows"), "points")
    estimates = _concentrated(points, _table(_starts(points), "starts"), ("grp", "start"), START_STEPS)
    estimates = _concentrated(points, _table(_least_determinant(estimates), "mcd"), ("grp",), STEPS)
    ranks = F.array(F.lit(0.25), F.lit(0.5), F.lit(SHARE))
    usual = _with_distance(points, estimates).groupBy("grp").agg(F.percentile_approx("d2", ranks, F.lit(QUANTILE_ACCURACY)).alias("q"))
    scale = F.lit(CHI_SHARE) / F.greatest(F.col("q")[2], F.lit(CHI_SHARE / 4))
    reach = F.col("q")[1] * scale * F.pow(F.col("q")[1] / F.greatest(F.col("q")[0], F.lit(1e-3)), F.lit(TAIL))
    limit = F.least(F.greatest(reach, F.lit(LEAST_LIMIT)), F.lit(MOST_LIMIT))
    usual = _table(usual.select("grp", scale.alias("scale"), limit.alias("limit")), "usual")
    distances = _with_distance(rows, estimates).join(usual, "grp")
    return distances.withColumn("distance", F.col("d2") * F.col("scale")).drop("d2", "scale", "grp", *_X)


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, distance, limit, kept) for every row of documents.

    ``base_failed``: under 10 words, or over a fifth of the words in repeated
    five-word windows.  ``kept``: not base_failed and within the group's limit.  NULL
    and empty texts have no words and fail the base.  NULL languages and
    sources are values of their own; NULL ids stay NULL; repeated rows are
    judged each; extra columns are ignored; an empty table gives no rows.
    """
    stats = written(base_statistics(docs), "statistics")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = robust_distances(stats).withColumn("base_failed", failed)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "limit",
        (~F.col("base_failed") & (F.col("distance") <= F.col("limit"))).alias("kept"),
    )
