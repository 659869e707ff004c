"""Shared helpers of the training-data operators.

Written tables go to the folder the cluster names in ``spark.checkpoint.dir``;
tokenisation inside tasks is vectorised over the bytes of a bounded chunk of
whole texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import broadcast_if_small, shared_dir  # noqa: F401  (used from here by the operators)
from ledgerlens.session import written_keeping_shuffles as written  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
WORD_GAP = r"[\x20\x09-\x0D]+"
WHITE_SPACE = " \t\n\x0b\x0c\r"
CHUNK_BYTES = 1 << 20
SLICE_ROWS = 256


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """While inside, tasks exchange at most ``rows`` rows at a time with Python:
    wide rows then need little memory.  For jobs run (written) inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` written to the shared folder in hash buckets of ``key``, sorted:
    a join on it reads them as they lie and moves only the other side."""
    spark, unique = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    files = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    files.option("path", f"{shared_dir(spark).rstrip('/')}/tables/{unique}").saveAsTable(unique)
    return spark.table(unique)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NO_ID = -(1 << 63)


def id_out(doc_id: Column) -> Column:
    """A doc_id for the way through pandas, where a NULL would turn longs into floats."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def id_back(doc_id: Column) -> Column:
    return F.nullif(doc_id, F.lit(NO_ID))


def id_and_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, text) as tasks read them: ids without NULL, texts as UTF-8 bytes."""
    return docs.select(id_out(F.col("doc_id")).alias("doc_id"), F.col("text").cast("binary").alias("text"))


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor`` (NULL id: of the empty text)."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(divisor))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Array of the words of a text; NULL text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


# ---------------------------------------------------------------- numpy side

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE = _BASE - (_BASE - 1) % 4 + 2  # base - 1 is 2 mod 4: permuted letters stay apart
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE & _MASK, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of UTF-8 texts (A-Z lower-cased), and the
    offset of each text's first word, with the total as last offset."""
    return word_places(texts)[:2]


def word_places(
    texts: list[bytes], prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, with each word's begin and end among the bytes of all
    texts, one byte between texts.  With ``prefixes`` the hashes are a matrix:
    the word, then its first so many bytes (the whole word if it is shorter).

    A word's hash is a polynomial of its bytes, read off a running sum over
    the whole buffer, so there is no Python work per word.
    """
    buffer = np.frombuffer(b" ".join([*texts, b""]).translate(_ASCII_LOWER), np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    up, down = _power_tables(len(buffer) + 1)
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_LETTERS[buffer] * up[: len(buffer)], out=total[1:])
    hashes = mixed((total[end] - total[begin]) * down[begin])
    if prefixes:
        parts = [mixed((total[np.minimum(begin + n, end)] - total[begin]) * down[begin]) for n in prefixes]
        hashes = np.column_stack([hashes, *parts])
    offsets = np.concatenate(([0], np.searchsorted(begin, ends_of))).astype(np.int64)
    return hashes, offsets, begin, end


def as_bytes(value: object) -> bytes:
    return bytes(value) if isinstance(value, (bytes, bytearray, memoryview)) else b""


def chunks(frames: Iterable[pd.DataFrame], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pd.DataFrame]:
    """Rows in runs of at most ``limit`` bytes of text; a longer text stands alone."""
    for frame in frames:
        if not len(frame):
            continue
        size = np.cumsum([len(x) if x is not None and x == x else 0 for x in frame[column]])
        start = 0
        while start < len(frame):
            base = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield frame.iloc[start:stop].reset_index(drop=True)
            start = stop


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of ``width``-word shingles per text; a text with
    fewer words gives its whole sequence as one, a text without words none."""
    hashes, offsets = word_hashes(texts)
    factors = mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    n = len(hashes) - width + 1
    if n > 0:
        running = hashes[:n] * factors[0]
        for k in range(1, width):
            running = running + hashes[k : k + n] * factors[k]
        running = mixed(running)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(running[a : b - width + 1]))
        elif b > a:
            short = (hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mixed(short + np.uint64((b - a) * 0x51ED270B)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def rows_where(docs: DataFrame, keep: Callable[[list[bytes]], list[bool]]) -> DataFrame:
    """Rows of ``docs`` whose text passes ``keep``, every column untouched."""
    at = docs.columns.index("text")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                texts = [t.encode("utf-8", "surrogatepass") if t is not None else b"" for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(keep(texts), pa.bool_()))

    return docs.mapInArrow(filtered, docs.schema)
