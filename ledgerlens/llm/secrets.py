"""Secret scan: named patterns, and character Markov models of random strings
against ordinary identifiers (operator 8).

Both models are first-order chains over 66 symbols.  They are trained on the
corpus itself: values matched by the named patterns are the random samples,
each distinct value once; the runs of identifier characters outside those
matches are the ordinary ones.  A further token is reported when its random
likelihood beats the ordinary one by enough per character.  Only the two
66 x 66 count tables reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import as_bytes, chunks, id_and_bytes, id_back, written

# The named patterns, their least lengths and order.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
KINDS = ("assign", "access", "hex", "markov")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST_PER_CHARACTER = 1.5
LEAST_TOTAL = 20.0
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_DIGIT = re.compile(rb"[0-9]")

_SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_N = len(_SYMBOLS)
_OTHER = _N
_CLASS = np.full(256, _OTHER, np.int64)
_CLASS[np.frombuffer(_SYMBOLS, np.uint8)] = np.arange(_N)
_CLASS[ord("=")] = _SYMBOLS.index(b"-")  # padding counts as a mark


def named_spans(text: str, raw: bytes) -> list[tuple[int, int, str, int]]:
    """(start, kind number, value, end) of the named patterns, per kind leftmost
    and without overlaps, in code points."""
    spans = []
    low = raw.lower()
    if any(name in low for name in _NAMES):
        spans += [(m.start(), 0, m[2], m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        spans += [(m.start(), 1, m[0], m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    spans += [(m.start(), 2, m[0], m.end()) for m in HEX.finditer(text)]
    return spans


def _pairs(classes: np.ndarray) -> np.ndarray:
    """Counts of neighbouring symbols, pairs with another character left out."""
    a, b = classes[:-1], classes[1:]
    both = (a < _N) & (b < _N)
    return np.bincount(a[both] * _N + b[both], minlength=_N * _N)


def _classes(value: bytes) -> np.ndarray:
    return _CLASS[np.frombuffer(value, np.uint8)]


def _training_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: counts of ordinary pairs, and the distinct named values."""
    ordinary = np.zeros(_N * _N, np.int64)
    for frame in chunks(frames):
        values: set[str] = set()
        blanked = []
        for raw in map(as_bytes, frame["text"]):
            text = raw.decode("utf-8", "replace")
            spans = named_spans(text, raw)
            if spans:
                values.update(value for _, _, value, _ in spans)
                pieces, at = [], 0
                for start, _, _, end in sorted(spans):
                    pieces.append(text[at : max(at, start)])
                    at = max(at, end)
                raw = " ".join([*pieces, text[at:]]).encode("utf-8", "replace")
            blanked.append(raw)
        ordinary += _pairs(_classes(b" ".join(blanked)))
        if values:
            yield pd.DataFrame({"pair": -1, "count": 0, "value": sorted(values)})
    used = np.flatnonzero(ordinary)
    yield pd.DataFrame({"pair": used, "count": ordinary[used], "value": None})


def _value_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    random = np.zeros(_N * _N, np.int64)
    for frame in frames:
        random += _pairs(_classes(" ".join(frame["value"]).encode()))
    used = np.flatnonzero(random)
    yield pd.DataFrame({"pair": used, "count": random[used]})


def train_ratio(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio (random over ordinary) of each symbol after each other.

    Both chains have a flat prior of one count per pair.  The random chain is
    mixed half and half with the flat one, since samples of one alphabet say
    little about random strings over another.
    """
    trained = written(
        id_and_bytes(docs).select("text").mapInPandas(_training_rows, "pair long, count long, value string"), "symbols"
    )
    samples = trained.where("pair < 0").select("value").distinct().mapInPandas(_value_pairs, "pair long, count long")
    both = (
        trained.where("pair >= 0")
        .groupBy("pair")
        .agg(F.sum("count").alias("count"))
        .withColumn("random", F.lit(False))
        .union(samples.groupBy("pair").agg(F.sum("count").alias("count")).withColumn("random", F.lit(True)))
    )
    counts = {True: np.ones(_N * _N), False: np.ones(_N * _N)}
    for row in both.collect():
        counts[row["random"]][row["pair"]] += row["count"]
    chain = {k: v.reshape(_N, _N) / v.reshape(_N, _N).sum(axis=1, keepdims=True) for k, v in counts.items()}
    return np.log((chain[True] + 1.0 / _N) / 2) - np.log(chain[False])


def markov_spans(text: str, ratio: np.ndarray, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tokens with a letter and a digit that look random and touch no taken span."""
    found = []
    for m in CANDIDATE.finditer(text):
        value = m[0]
        if value.isalpha() or value.isdigit() or not any(c.isdigit() for c in value):
            continue
        if not any(c.isalpha() for c in value) or any(a < m.end() and m.start() < b for a, b in taken):
            continue
        classes = _classes(value.encode())
        score = float(ratio[classes[:-1], classes[1:]].sum())
        if score >= LEAST_TOTAL and score >= LEAST_PER_CHARACTER * (len(value) - 1):
            found.append(m.span())
    return found


def all_spans(text: str, raw: bytes, ratio: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of named and further spans, in order."""
    spans = [(start, kind, end) for start, kind, _, end in named_spans(text, raw)]
    extra = markov_spans(text, ratio, [(a, b) for a, _, b in spans]) if _DIGIT.search(raw) else []
    return sorted(spans + [(a, 3, b) for a, b in extra])


def find_secrets(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Documents -> (doc_id, spans: array of (start, end, kind)), sorted by start
    and kind in the order of KINDS; whole texts, ends exclusive, code points.

    NULL and empty texts have no spans; NULL ids stay NULL; every input row
    gives one row, repeated or not; extra columns are ignored.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(frames):
            out = []
            for raw in map(as_bytes, frame["text"]):
                text = raw.decode("utf-8", "replace")
                out.append([{"start": a, "end": b, "kind": KINDS[k]} for a, k, b in all_spans(text, raw, ratio)])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "spans": out})

    found = id_and_bytes(docs).mapInPandas(scan, "doc_id long, spans array<struct<start: long, end: long, kind: string>>")
    return found.withColumn("doc_id", id_back(F.col("doc_id")))


def redacted(docs: DataFrame, ratio: np.ndarray, mark: str = "[secret]") -> DataFrame:
    """Documents -> (doc_id, text) with every found span, overlapping ones as
    one, replaced by ``mark``; other texts as they are."""

    def clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in chunks(frames):
            out = []
            for value in frame["text"]:
                if value is None:
                    out.append(None)
                    continue
                raw = as_bytes(value)
                text, pieces, at = raw.decode("utf-8", "replace"), [], 0
                for start, _, end in all_spans(text, raw, ratio):
                    if start >= at:
                        pieces += [text[at:start], mark]
                    at = max(at, end)
                out.append("".join([*pieces, text[at:]]))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text": out})

    return id_and_bytes(docs).mapInPandas(clean, "doc_id long, text string").withColumn("doc_id", id_back(F.col("doc_id")))


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of found spans."""

    def joined(spans: object) -> object:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind: str) -> object:
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))

