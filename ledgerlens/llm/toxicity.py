"""Toxic passages by maximum-scoring segments (operator 10).

Words score by the log-odds of toxic against clean labelled texts under an
informative Dirichlet prior (a share of the words' counts in both); a word takes
the most significant score among itself and its first few bytes, so inflected
forms share one; words without a significant score cost a little each.  A linear scan finds every maximal
segment of a text; segment scores become significances by the extreme-value
law of the best segment among clean words, and a text's summed significance
becomes a probability by a logistic fit on labelled texts that took no part in
the word scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import as_bytes, chunks, id_and_bytes, id_back, id_remainder, word_places, written

SAMPLE_PER_CLASS = 20_000
LEXICON = 20_000
PREFIXES = (4, 5, 6, 7, 8)
PRIOR_SHARE = 0.1
#: Least significance and least log-odds of a lexicon word: the calibration half picks one.
LIMITS = ((2.0, 3.0), (3.0, 3.0), (4.0, 0.0), (4.0, 2.0), (4.0, 3.0), (6.0, 1.0))
WORD_COST = 0.2
SIGNIFICANT = 0.01
THRESHOLD = 0.3
_MARKS = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in range(256))


@dataclass(frozen=True)
class ToxicityModel:
    """Bounded by LEXICON words and a few numbers."""

    words: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.empty(0))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    decay: float = 1.0
    scale: float = 1.0
    intercept: float = -20.0
    slope: float = 0.0

    def word_scores(self, hashes: np.ndarray) -> np.ndarray:
        """Per row of hashes: the score of its most significant known feature."""
        if not len(self.words) or not len(hashes):
            return np.full(len(hashes), -WORD_COST)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        weight = np.where(self.words[at] == hashes, self.weights[at], 0.0)
        best = (np.arange(len(hashes)), weight.argmax(axis=1))
        return np.where(weight[best] > 0, self.scores[at][best], 0.0) - WORD_COST

    def least_word(self) -> float:
        """The smallest positive score of a word."""
        return float(min(self.scores[self.scores > WORD_COST] - WORD_COST, default=1.0))

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Summed excess significance of a text's segments, in nats."""
        return sum(max(0.0, self.decay * s - np.log(self.scale * max(n, 1))) for _, _, s in segments)

    def probability(self, evidence: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.intercept + self.slope * np.log1p(evidence), -50, 50))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, one past last, score) of a sequence.

    One pass over the positive runs keeps a list of disjoint candidates with
    the running total before and after each, and a link to the last earlier
    one that starts lower.  A new candidate follows links to the last one that
    starts lower than itself and swallows back to it while that one ends lower.
    """
    positive = scores > 0
    if not positive.any():
        return []
    total = np.concatenate(([0.0], np.cumsum(scores)))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], positive, [False])).astype(np.int8)))
    kept: list[tuple[int, int, float, float, int]] = []
    for first, last in zip(edge[::2], edge[1::2], strict=True):
        low, high = total[first], total[last]
        while True:
            k = len(kept) - 1
            while k >= 0 and kept[k][2] >= low:
                k = kept[k][4]
            if k < 0 or kept[k][3] >= high:
                kept.append((int(first), int(last), low, high, k))
                break
            first, low = kept[k][0], kept[k][2]
            del kept[k:]
    return [(a, b, float(high - low)) for a, b, low, high, _ in kept]


def _scan(model: ToxicityModel, texts: list[bytes]) -> Iterator[tuple[list[tuple[int, int, float]], np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: segments in words, the words' scores and byte places."""
    hashes, offsets, begin, end = word_places([t.translate(_MARKS) for t in texts], PREFIXES)
    scores = model.word_scores(hashes)
    base = np.cumsum([0, *(len(t) + 1 for t in texts)])
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        yield maximal_segments(scores[a:b]), scores[a:b], begin[a:b] - base[i], end[a:b] - base[i]


def _word_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts with a word, per class and distinct word."""
    for frame in chunks(frames, limit=2 << 20):
        for toxic, part in frame.groupby("toxic"):
            hashes, offsets, _, _ = word_places([as_bytes(t).translate(_MARKS) for t in part["text"]], PREFIXES)
            found = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            words, times = np.unique(np.concatenate(found), return_counts=True)
            zero = np.zeros(len(words), np.int64)
            yield pd.DataFrame(
                {"word": words.view(np.int64), "bad": times if toxic else zero, "good": zero if toxic else times}
            )


def _segment_rows(models: list[ToxicityModel], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per text and model: words, segment scores, and its word scores as ups and their rest."""
    for frame in chunks(frames):
        texts = [as_bytes(t) for t in frame["text"]]
        for number, model in enumerate(models):
            rows = [
                (number, len(scores), [s for _, _, s in segments], list(scores[scores > 0]), float(scores[scores <= 0].sum()))
                for segments, scores, _, _ in _scan(model, texts)
            ]
            yield pd.DataFrame(rows, columns=["model", "n", "segments", "ups", "downs"]).assign(toxic=frame["toxic"])


def _decay(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of  sum share * exp(decay * score) = 1."""
    if not (scores > 0).any() or float(scores @ shares) >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while float(shares @ np.exp(np.minimum(high * scores, 700))) < 1:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        if float(shares @ np.exp(np.minimum(middle * scores, 700))) < 1:
            low = middle
        else:
            high = middle
    return max(high, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit with a weak pull to zero, slope at least zero."""
    top = max(float(x.max(initial=0.0)), 1.0)
    design = np.column_stack([np.ones(len(x)), x / top])
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 1e-2 * theta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        theta = theta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), max(0.0, float(theta[1] / top))


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Learn from at most ``per_class`` labelled documents of each class.

    ``usable`` is a boolean column over ``labels``' doc_id.  The sample is the
    rows with the smallest hash of their id; half of it gives the word scores,
    the other half the calibration.  NULL labels or ids are left out, a
    repeated id counts once (toxic if any of its rows is).  Without rows of
    both classes the model finds nothing and scores the labels' toxic share.
    """
    rated = (
        labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max("toxic") > 0).alias("toxic"))
    )
    sizes = {row["toxic"]: row["count"] for row in rated.groupBy("toxic").count().collect()}
    share = sizes.get(True, 0) / max(1, sum(sizes.values()))
    flat = ToxicityModel(intercept=float(np.log(share + 1e-9) - np.log(1 - share + 1e-9)))
    if len(sizes) < 2:
        return flat
    order = F.xxhash64("doc_id")
    picked = [rated.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(per_class) for t in (True, False)]
    sample = F.broadcast(picked[0].union(picked[1]))  # at most 2 * per_class pairs
    texts = written(id_and_bytes(docs).join(sample, "doc_id"), "rated")
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))

    counts = (
        texts.where(half == 0)
        .select("text", "toxic")
        .mapInPandas(_word_counts, "word long, bad long, good long")
        .groupBy("word")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )
    counts = written(counts, "words")
    sums = counts.agg(F.sum("bad"), F.sum("good")).first()
    if not sums[0] or not sums[1]:
        return flat
    bad, good = float(sums[0]), float(sums[1])
    prior, all_prior = PRIOR_SHARE * (F.col("bad") + F.col("good")), PRIOR_SHARE * (bad + good)
    odds = F.log((F.col("bad") + prior) / (bad + all_prior - F.col("bad") - prior)) - F.log(
        (F.col("good") + prior) / (good + all_prior - F.col("good") - prior)
    )
    spread = F.sqrt(1 / (F.col("bad") + prior) + 1 / (F.col("good") + prior))
    lexicon = (
        counts.select("word", odds.alias("odds"), (odds / spread).alias("z"))
        .where(F.abs("z") >= min(z for z, _ in LIMITS))
        .orderBy(F.abs("z").desc(), "word")
        .limit(LEXICON)
        .toPandas()
    )
    lexicon = lexicon.assign(key=lexicon["word"].to_numpy(np.int64).view(np.uint64)).sort_values("key")
    models = []
    for least_z, least_odds in LIMITS:
        part = lexicon[(lexicon["z"].abs() >= least_z) & (lexicon["odds"].abs() >= least_odds)]
        models.append(
            ToxicityModel(part["key"].to_numpy(np.uint64), part["odds"].to_numpy(float), part["z"].abs().to_numpy(float))
        )
    rows = texts.where(half == 1).select("text", "toxic").mapInPandas(
        lambda frames: _segment_rows(models, frames),
        "model int, n long, segments array<double>, ups array<double>, downs double, toxic boolean",
    )
    rows = written(rows, "segments")
    least = [m.least_word() for m in models]
    totals = rows.groupBy("model", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum("downs").alias("downs"),
        F.sum(F.size(F.filter("segments", lambda s: s >= _of_model(least)))).alias("hits"),
    )
    totals = totals.toPandas()  # a row per limit and class
    # a row per limit and lexicon word
    ups = rows.where("not toxic").select("model", F.explode("ups").alias("up")).groupBy("model", "up").count().toPandas()
    laws = [_with_law(m, ups[ups["model"] == k], totals[(totals["model"] == k) & ~totals["toxic"]]) for k, m in enumerate(models)]
    quiet = F.log(_of_model([m.scale for m in laws]) * F.greatest("n", F.lit(1)))
    excess = F.transform("segments", lambda s: F.greatest(F.lit(0.0), _of_model([m.decay for m in laws]) * s - quiet))
    evidence = F.aggregate(excess, F.lit(0.0), lambda a, x: a + x).alias("evidence")
    # at most 2 * per_class numbers per limit; the many texts without evidence are one row
    judged = rows.select("model", "toxic", evidence).groupBy("model", "toxic", "evidence").count().toPandas()
    fitted = [_calibrated(m, judged[judged["model"] == k], share) for k, m in enumerate(laws)]
    return min((f for f in fitted if f is not None), key=lambda f: f[0], default=(0.0, flat))[1]


def _of_model(values: list[float]) -> Column:
    """The row's model's value."""
    return F.array(*[F.lit(float(v)) for v in values])[F.col("model")]


def _with_law(model: ToxicityModel, ups: pd.DataFrame, clean: pd.DataFrame) -> ToxicityModel:
    """The model with the extreme-value law of clean calibration texts: ``ups``
    are their positive word scores (up, count), ``clean`` their sums in at most one row."""
    total = max(int(clean["n"].sum()), 1)
    # half a clean word at each known score keeps the law defined where clean text has none
    known = model.scores[model.scores > WORD_COST] - WORD_COST
    shares = np.concatenate([ups["count"].to_numpy(float), np.full(len(known), 0.5), [total]])
    below = min(float(clean["downs"].sum()) / total, -1e-3)
    decay = _decay(np.concatenate([ups["up"].to_numpy(float), known, [below]]), shares / shares.sum())
    scale = (int(clean["hits"].sum()) + 0.5) / (total * float(np.exp(-decay * model.least_word())))
    return replace(model, decay=decay, scale=scale)


def _calibrated(model: ToxicityModel, judged: pd.DataFrame, share: float) -> tuple[float, ToxicityModel] | None:
    """The model with its logistic fit from calibration texts (toxic, evidence,
    count), and the fit's weighted log loss; None unless both classes occur."""
    judged = judged.sort_values(["toxic", "evidence"])
    y, times = judged["toxic"].to_numpy(bool), judged["count"].to_numpy(float)
    if not times[y].sum() or not times[~y].sum():
        return None
    evidence = judged["evidence"].to_numpy(float)
    toxic_share = times[y].sum() / times.sum()
    weight = times * np.where(y, share / toxic_share, (1 - share) / (1 - toxic_share))
    intercept, slope = _logistic(np.log1p(evidence), y.astype(float), weight)
    model = replace(model, intercept=intercept, slope=slope)
    p = np.clip([model.probability(e) for e in evidence], 1e-6, 1 - 1e-6)
    return float(-(weight * np.where(y, np.log(p), np.log1p(-p))).sum() / times.sum()), model


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Documents -> (doc_id, score, passages): one row per input row.

    ``passages`` are the segments with at most SIGNIFICANT expected segments
    as good in clean text of that length: (start, end, expected), code points,
    ends exclusive.  NULL and empty texts have no passage and the score of a
    text without evidence; NULL ids stay NULL; extra columns are ignored.
    """

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(frames):
            texts = [as_bytes(t) for t in frame["text"]]
            score, passages = [], []
            for raw, (segments, scores, begin, end) in zip(texts, _scan(model, texts), strict=True):
                n, found = len(scores), []
                for first, last, value in segments:
                    expected = model.scale * n * float(np.exp(-model.decay * value))
                    if expected <= SIGNIFICANT:
                        start = len(raw[: begin[first]].decode("utf-8", "replace"))
                        stop = start + len(raw[begin[first] : end[last - 1]].decode("utf-8", "replace"))
                        found.append({"start": start, "end": stop, "expected": expected})
                score.append(model.probability(model.evidence(segments, n)))
                passages.append(found)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": score, "passages": passages})

    schema = "doc_id long, score double, passages array<struct<start: long, end: long, expected: double>>"
    return id_and_bytes(docs).mapInPandas(scored, schema).withColumn("doc_id", id_back(F.col("doc_id")))


def is_below(model: ToxicityModel, threshold: float) -> Callable[[list[bytes]], list[bool]]:
    """A test of texts: does the model score them under ``threshold``."""

    def test(texts: list[bytes]) -> list[bool]:
        found = _scan(model, texts)
        return [model.probability(model.evidence(segments, len(scores))) < threshold for segments, scores, _, _ in found]

    return test


def quarter_held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, 4) == 2
