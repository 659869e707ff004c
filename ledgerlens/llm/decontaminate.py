"""Benchmark decontamination by pigeonhole edit matching (operator 2).

Texts and items are lower-cased with white space collapsed.  An item of n
characters may occur with up to ``rate * n`` edits; cut into one piece more
than that, at least one piece occurs unchanged.  One automaton finds all
pieces' exact hits in a pass over a text, and each hit's surroundings are
verified by Myers' bit-parallel distance.

The items are the query set: they go to the tasks in blocks of at most
BLOCK_CHARS characters, one pass over the documents per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import as_bytes, chunks, id_and_bytes, id_back, rows_where

ERROR_RATE = 0.08
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length with their offsets."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers_best(item: str, window: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``window``, and where the
    first such part ends."""
    at: dict[str, int] = {}
    for k, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << k
    full, top = (1 << len(item)) - 1, 1 << (len(item) - 1)
    plus, minus, score = full, 0, len(item)
    best, end = score, 0
    for k, c in enumerate(window, 1):
        equal = at.get(c, 0)
        vertical = equal | minus
        diagonal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, k
    return best, end


class Matcher:
    """Pieces of one block of items, and the check of their hits."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [(i, text, int(rate * len(text))) for i, text in items]
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                places.setdefault(piece, []).append((number, offset))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def hits(self, text: str) -> dict[int, tuple[int, int]]:
        """Item number -> (distance, end in the text) of its best occurrence."""
        found: dict[int, tuple[int, int]] = {}
        if self.empty:
            return found
        starts: dict[int, set[int]] = {}
        for last, (length, where) in self.automaton.iter(text):
            for number, offset in where:
                starts.setdefault(number, set()).add(last + 1 - length - offset)
        for number, begins in starts.items():
            _, item, errors = self.items[number]
            # starts at most ``errors`` apart share one window, others get their own
            run: list[int] = []
            for begin in [*sorted(begins), None]:
                if run and (begin is None or begin - run[-1] > errors):
                    low = max(0, run[0] - errors)
                    distance, end = myers_best(item, text[low : run[-1] + len(item) + errors])
                    if distance <= errors and (number not in found or distance < found[number][0]):
                        found[number] = (distance, low + end)
                    run = []
                if begin is not None:
                    run.append(begin)
        return found


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Normalised non-empty items in blocks of bounded size."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, distance, end_char): every benchmark item found in a
    document within ``floor(rate * characters)`` edits, at its best place;
    ``end_char`` counts characters of the normalised text.

    NULL and empty texts or items match nothing; an item too short for one
    edit must occur unchanged.  Rows that repeat a doc_id with one text give
    one hit; NULL ids stay NULL.  Equal items are each reported.  Extra columns
    are ignored; empty tables give no rows.
    """
    schema = "doc_id long, item_id long, distance int, end_char long"
    session = docs.sparkSession
    found = session.createDataFrame([], schema)
    for block in _blocks(benchmark):
        shared = session.sparkContext.broadcast(block)

        def search(frames: Iterator[pd.DataFrame], shared: object = shared) -> Iterator[pd.DataFrame]:
            matcher = Matcher(shared.value, rate)
            for frame in chunks(frames):
                rows = []
                for doc_id, raw in zip(frame["doc_id"], frame["text"], strict=True):
                    for number, (distance, end) in matcher.hits(normal(as_bytes(raw).decode("utf-8", "replace"))).items():
                        rows.append((doc_id, matcher.items[number][0], distance, end))
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "end_char"])

        found = found.union(id_and_bytes(docs).mapInPandas(search, schema))
    return found.distinct().withColumn("doc_id", id_back(F.col("doc_id")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """Documents without any benchmark item in them, all columns as they are."""
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(texts: list[bytes], shared: object = shared) -> list[bool]:
            matcher = _matcher(shared, rate)
            return [not matcher.hits(normal(t.decode("utf-8", "replace"))) for t in texts]

        docs = rows_where(docs, clean)
    return docs


_built: list[tuple[object, float, Matcher]] = []


def _matcher(shared: object, rate: float) -> Matcher:
    """The matcher of a broadcast block, built once per worker process; the block is
    kept beside it, so that no other one can take its place in memory."""
    if not (_built and _built[0][0] is shared.value and _built[0][1] == rate):
        _built[:] = [(shared.value, rate, Matcher(shared.value, rate))]
    return _built[0][2]
