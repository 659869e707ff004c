"""Periodic runs of words (operator 12): seed and extend along diagonals.

A run of smallest period q and at least ``max(24, 3 * q)`` words repeats every
word q places on, so along the diagonal of lag q at least ``max(24 - q, 2 * q)``
words in a row agree.  Periods are taken in bands: up to 8, where that overlap
is 16 or more, then (8, 16], (16, 32], and so on, where it exceeds twice the
band's lower end.  Each band indexes the k-grams of its guaranteed overlap (16,
16, 32, 64, ...; numbered exactly by prefix doubling, no hashes), so a run
holds at least one pair of equal k-grams one period apart.

As k is at least the period, a k-gram inside a run cannot recur sooner than one
period on (a shift s < q would give the run the period gcd(s, q)), so only
consecutive occurrences are enumerated: at most one pair a word and band,
however often a k-gram occurs.  A pair is extended both ways to the
first unequal words, and a table of how far each lag is covered suppresses the
other pairs of the same stretch.  Every extended stretch is a repetition of at
least two periods, of which a text has fewer than words, with lengths of
O(n log n) in all; so is the whole work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import arrow_rows, id_and_bytes, id_back, words, written

#: A run has at least so many words, and at least so many periods.
LEAST_WORDS = 24
LEAST_PERIODS = 3
#: The first band's longest period: up to it the guaranteed overlap is twice as long.
FIRST_BAND = LEAST_WORDS // LEAST_PERIODS
STRETCH = 64
BATCH_ROWS = 200

RUNS_SCHEMA = (
    "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
)


def numbered(tokens: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, different words different ones."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(t, len(known)) for t in tokens), np.int64, len(tokens))


def _doubled(grams: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the 2 * width-grams from those of the width-grams."""
    left, right = grams[: len(grams) - width], grams[width:]
    return np.unique(left * (int(grams.max()) + 1) + right, return_inverse=True)[1]


def _next_places(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag to the next place with the same k-gram) of all places that have one, by place."""
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    place, lag = order[:-1][same], (order[1:] - order[:-1])[same]
    by_place = np.argsort(place)
    return place[by_place], lag[by_place]


def _agreeing(ids: np.ndarray, a: int, b: int, step: int) -> int:
    """How many words from a and b on agree, forwards (1) or backwards (-1); a < b."""
    total, size = 0, STRETCH
    while True:
        room = min(size, len(ids) - b if step > 0 else a + 1)
        if room <= 0:
            return total
        if step > 0:
            unequal = ids[a : a + room] != ids[b : b + room]
        else:
            unequal = ids[a - room + 1 : a + 1][::-1] != ids[b - room + 1 : b + 1][::-1]
        if unequal.any():
            return total + int(unequal.argmax())
        total, a, b, size = total + room, a + step * room, b + step * room, 2 * size


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of word numbers, by start, then period."""
    found = []
    n = len(ids)
    grams, width = ids, 1
    while width < 2 * FIRST_BAND and n >= LEAST_WORDS:
        grams, width = _doubled(grams, width), 2 * width
    low, high = 0, FIRST_BAND
    while n >= max(LEAST_WORDS, LEAST_PERIODS * (low + 1)):
        place, lag = _next_places(grams)
        if not len(place):
            break  # no k-gram recurs, so no longer one does
        in_band = (lag > low) & (lag <= high)
        covered: dict[int, int] = {}
        for i, q in zip(place[in_band].tolist(), lag[in_band].tolist(), strict=True):
            if i < covered.get(q, 0):
                continue
            end = i + width + _agreeing(ids, i + width, i + q + width, 1)
            start = i - _agreeing(ids, i - 1, i + q - 1, -1)
            covered[q] = end
            if end - start + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
                found.append((start, end - start + q, q))
        if low:
            if len(grams) <= width:
                break
            grams, width = _doubled(grams, width), 2 * width
        low, high = high, 2 * high
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those in no run, or only among the first period of the runs that hold them."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def _run_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
            tokens = bytes(text).split() if text is not None else []  # splits at 09-0D and 20 only
            runs = find_runs(numbered(tokens))
            kept = collapsed(len(tokens), runs)
            left = tokens if not runs else [t for t, k in zip(tokens, kept.tolist(), strict=True) if k]
            rows.append((
                doc_id, len(tokens), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs],
                b" ".join(left).decode("utf-8", "replace"),
            ))
        yield pd.DataFrame(rows, columns=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) -> (doc_id, n_words, runs, collapsed).

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0 and compared as they
    stand.  ``runs`` holds (start, length, period) of every run by start, then
    period: stretches of smallest period q and at least max(24, 3 * q) words
    that no neighbouring word extends with period q.  ``collapsed`` joins, by
    one space, the words that no run holds after its first q words.

    NULL, empty and blank texts have no words, no runs and an empty collapsed
    text.  A NULL doc_id stays NULL.  Repeated rows all appear.  Columns beside
    doc_id and text are ignored.  An empty table gives no rows.  One row is
    handled at a time, whole, in memory in proportion to its words.
    """
    found = id_and_bytes(docs).mapInPandas(_run_rows, RUNS_SCHEMA)
    return found.withColumn("doc_id", id_back(F.col("doc_id")))


def looped(doc_id: Column, text: Column) -> Column:
    """A text with a loop written into it where crc32 of the decimal id is divisible by
    ten: with g a tenth of that number, of n words those from a = g % n on repeat
    the first p = 1 + (n - a) div (3 + g % 8) of them.  Other texts, texts without
    words and texts of a NULL id stay as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    tokens = words(text)
    n = F.size(tokens).cast("long")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    head = F.slice(tokens, 1, a.cast("int"))
    loop = F.slice(tokens, (a + 1).cast("int"), p.cast("int"))
    tail = F.flatten(F.array_repeat(loop, F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(head, F.slice(tail, 1, (n - a).cast("int"))), " ")
    # the words are split for the changed texts only
    is_changed = (F.pmod(h, F.lit(10)) == 0) & F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]"))
    return F.when(is_changed, changed).otherwise(text)


def _greatest_exponent(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first one among equals."""
    return F.reduce(
        F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))),
        F.try_element_at(runs, F.lit(1)),
        lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best),
    )


def digest(found: DataFrame) -> DataFrame:
    """periodic_runs' rows -> the counts, the run of greatest exponent, and hashes of all runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", _greatest_exponent(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def run_digests(docs: DataFrame) -> DataFrame:
    """Digests of the runs of all whole texts, a tenth of them looped; a written table."""
    docs = docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return written(digest(periodic_runs(docs)), "runs")
