"""Katz back-off language model, trained and evaluated on the whole corpus (operator 5).

Bigrams back off to unigrams, unigrams to one unknown word.  Counts up to
``RELIABLE`` get Good-Turing discounts, larger ones lose a small constant, so
every history keeps some mass for words it was not seen with and the back-off
weight  (1 - sum of seen probabilities) / (1 - sum of their unigram
probabilities)  makes each distribution sum to one exactly.

The corpus is held as one table of chunks (runs of whole documents as integer
token streams with a local vocabulary).  Three keyed exchanges count over all
chunks: words, bigrams, and the sums behind the back-off weights.  In each, a
chunk sends its sorted distinct keys with local sums to hash buckets, and a
bucket sends the totals back, aligned with what the chunk sent.  A frequent
word is one entry per chunk, buckets are even by hash, and no task ever holds
more than one bucket or a few chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import (
    as_bytes,
    chunks,
    id_back,
    id_out,
    id_remainder,
    mixed,
    word_hashes,
    written,
)

RELIABLE = 5
TAIL_DISCOUNT = 0.05
PLAIN_DISCOUNT = 0.5
CHUNK_TOKENS = 400_000
BUCKET_TOKENS = 500_000
END, START = np.uint64(0x1F0E3DAD99908345), np.uint64(0x6C8E9CF570932BD5)


# ------------------------------------------------------------------ packing


def pack(values: np.ndarray) -> bytes:
    """Fixed-width numbers, byte planes apart, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(blob)), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, len(raw) // width).T).view(kind).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.uint64), dtype=np.uint64)


# ----------------------------------------------------------- keyed exchange


def _sent(chunk: int, keys: np.ndarray, values: np.ndarray, bits: int) -> dict[str, list]:
    """A chunk's sorted keys with a matrix of integer values, cut by bucket (the
    top bits of the key)."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    names, first = np.unique(bucket, return_index=True)
    ends = [*first[1:], len(keys)][: len(first)]
    return {
        "bucket": list(names),
        "chunk": [chunk] * len(names),
        "keys": [pack_sorted(keys[a:b]) for a, b in zip(first, ends, strict=True)],
        "sums": [pack(values[a:b].T.reshape(-1)) for a, b in zip(first, ends, strict=True)],
    }


def _exchanged(sent: DataFrame, reduce: Callable, width: int, name: str) -> DataFrame:
    """Rows (bucket, chunk, keys, sums) -> (chunk, bucket, reply, stats), written.

    ``reduce`` gets the bucket's distinct keys' total matrix, the entries' key
    numbers and their own matrix; it returns one reply per entry and a list of
    bucket statistics.
    """

    def of_bucket(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(k) for k in frame["keys"]]
        sums = np.concatenate([unpack(s, np.int64).reshape(width, -1).T for s in frame["sums"]])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.stack([np.bincount(at, sums[:, k], len(distinct)) for k in range(width)], axis=1)
        reply, stats = reduce(totals, at, sums)
        cut = np.cumsum([len(k) for k in keys])[:-1]
        return pd.DataFrame(
            {
                "chunk": frame["chunk"].to_numpy(),
                "bucket": frame["bucket"].to_numpy(),
                "reply": [pack(part) for part in np.split(reply, cut)],
                "stats": [stats, *[[0] * len(stats)] * (len(frame) - 1)],
            }
        )

    schema = "chunk long, bucket long, reply binary, stats array<long>"
    return written(sent.groupBy("bucket").applyInPandas(of_bucket, schema), name)


def _statistics(replies: DataFrame, n: int) -> list[int]:
    row = replies.agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)) for k in range(n)]).first()
    return [int(x) for x in row]


def _by_chunk(replies: DataFrame, name: str) -> DataFrame:
    return replies.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "reply"))).alias(name))


def _joined(parts: object, kind: type) -> np.ndarray:
    if parts is None or not len(parts):
        return np.empty(0, kind)
    return np.concatenate([unpack(p["reply"], kind) for p in parts])


# ------------------------------------------------------------------- counts


def _chunk_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents -> chunks: local vocabulary (sorted hashes) and token stream."""
    part, number, held_back, tokens = TaskContext.get().partitionId(), 0, [], 0

    def row(pieces: list) -> pd.DataFrame:
        stream = np.concatenate([p[0] for p in pieces])
        vocabulary, ids = np.unique(stream, return_inverse=True)
        return pd.DataFrame(
            {
                "chunk": [(part << 32) + number],
                "tokens": [len(stream)],
                "doc_ids": [pack(np.concatenate([p[1] for p in pieces]))],
                "lengths": [pack(np.concatenate([p[2] for p in pieces]))],
                "held": [pack(np.concatenate([p[3] for p in pieces]))],
                "vocabulary": [pack_sorted(vocabulary)],
                "stream": [pack(ids.astype(np.int32))],
            }
        )

    for frame in chunks(frames):
        hashes, offsets = word_hashes([as_bytes(t) for t in frame["text"]])
        stream = np.insert(hashes, offsets[1:], END)
        lengths = (np.diff(offsets) + 1).astype(np.int64)
        held_back.append(
            (stream, frame["doc_id"].to_numpy(np.int64), lengths, frame["held_out"].to_numpy(bool).astype(np.uint8))
        )
        tokens += len(stream)
        if tokens >= CHUNK_TOKENS:
            yield row(held_back)
            number, held_back, tokens = number + 1, [], 0
    if held_back:
        yield row(held_back)


class _Chunk:
    """The arrays of one chunk row."""

    def __init__(self, row: object) -> None:
        self.id = int(row.chunk)
        self.doc_ids, self.lengths = unpack(row.doc_ids, np.int64), unpack(row.lengths, np.int64)
        self.held = unpack(row.held, np.uint8).astype(bool)
        self.vocabulary = unpack_sorted(row.vocabulary)
        self.ids = unpack(row.stream, np.int32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.training = ~self.held[self.doc]

    def histories(self) -> np.ndarray:
        """Local id of the word before each token; the vocabulary's size for a text's start."""
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[np.cumsum(self.lengths) - self.lengths] = len(self.vocabulary)
        return before

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of the distinct bigrams, their history and word ids, each
        token's bigram number, and the training count of each bigram here."""
        size = len(self.vocabulary) + 1
        codes, at = np.unique(self.histories() * size + self.ids, return_inverse=True)
        words = np.append(self.vocabulary, START)
        first, second = codes // size, codes % size
        keys = mixed(mixed(words[first] * np.uint64(0xD6E8FEB86659FD93)) + words[second])
        order = np.argsort(keys)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        at = place[at]
        seen = np.bincount(at, self.training, len(order)).astype(np.int64)
        return keys[order], first[order], second[order], at, seen


def _histogram(totals: np.ndarray) -> list[int]:
    """How many keys were counted 1 .. RELIABLE + 1 times."""
    return [int(x) for x in np.bincount(totals[totals <= RELIABLE + 1].astype(np.int64), minlength=RELIABLE + 2)[1:]]


def _count_words(totals: np.ndarray, at: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, list[int]]:
    count = totals[:, 0].astype(np.int64)
    return count[at], [int(count.sum()), int((count > 0).sum()), *_histogram(count)]


def _count_bigrams(totals: np.ndarray, at: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Reply: twice the total, plus one for the one entry that answers for the bigram."""
    count = totals[:, 0].astype(np.int64)
    training = np.flatnonzero(sums[:, 0])
    owner = np.zeros(len(at), np.int64)
    owner[training[np.unique(at[training], return_index=True)[1]]] = 1
    return 2 * count[at] + owner, _histogram(count)


def good_turing(numbers: list[int]) -> np.ndarray:
    """Discounted counts: entry r is r* for r up to the reliable limit, the last
    entry what larger counts lose.

    ``numbers[r - 1]`` keys were counted r times.  The limit starts at
    RELIABLE and falls while some r* would leave (0, r) or not exceed the one
    before; at 0 all counts lose PLAIN_DISCOUNT.
    """
    n = np.array([0, *numbers], float)
    for limit in range(RELIABLE, 0, -1):
        r = np.arange(1, limit + 1)
        if n[1] and (n[r] > 0).all():
            share = (limit + 1) * n[limit + 1] / n[1]
            raw = (r + 1) * n[r + 1] / n[r]
            with np.errstate(divide="ignore", invalid="ignore"):
                value = r * (raw / r - share) / (1 - share)
            if np.isfinite(value).all() and (value < r).all() and (np.diff(value, prepend=0.0) > 0).all():
                filled = np.concatenate(([0.0], value, np.arange(limit + 1, RELIABLE + 1) - TAIL_DISCOUNT))
                return np.append(filled, TAIL_DISCOUNT)
    return np.concatenate(([0.0], np.arange(1, RELIABLE + 1) - PLAIN_DISCOUNT, [PLAIN_DISCOUNT]))


def discounted(count: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.where(count <= RELIABLE, table[np.minimum(count, RELIABLE)], count - table[-1])


def _per_history(first: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Per history: how many of its bigrams' counts are 1 .. RELIABLE, how many
    are larger, and the larger ones' sum."""
    classes = np.minimum(counts, RELIABLE + 1)
    kinds = np.bincount(first * (RELIABLE + 2) + classes, minlength=size * (RELIABLE + 2))
    large = counts > RELIABLE
    total = np.bincount(first[large], counts[large], size)
    return np.column_stack([kinds.reshape(size, RELIABLE + 2)[:, 1:], total]).astype(np.int64)


def _mass(sums: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of discounted counts, from the columns of _per_history."""
    return sums[:, :RELIABLE] @ table[1 : RELIABLE + 1] + sums[:, RELIABLE + 1] - table[-1] * sums[:, RELIABLE]


_WIDTH = RELIABLE + 2


def katz_scores(docs: DataFrame, held_out: object, name: str = "katz") -> DataFrame:
    """Score every document by a bigram Katz model learnt from those not held out.

    ``held_out`` is a boolean column over ``docs``.  Tokens are the words
    (A-Z lower-cased) and one end per text.  Result, one row per input row:
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams), score (log10 probability under the model).

    NULL and empty texts are one end token.  NULL ids stay NULL and count as
    any other row; repeated rows are scored and counted each.  Without
    training rows every token has probability one (a single unknown word).
    An empty table gives no rows; extra columns are ignored.
    """
    texts = docs.select(
        id_out(F.col("doc_id")).alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
    )
    corpus = written(
        texts.mapInPandas(
            _chunk_rows,
            "chunk long, tokens long, doc_ids binary, lengths binary, held binary, vocabulary binary, stream binary",
        ),
        name,
    )
    total = corpus.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    bits = max(3, int(np.ceil(np.log2(max(1, total / BUCKET_TOKENS)))))
    sent = "bucket long, chunk long, keys binary, sums binary"

    def words_sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                c = _Chunk(row)
                here = np.bincount(c.ids[c.training], minlength=len(c.vocabulary)).astype(np.int64)
                yield pd.DataFrame(_sent(c.id, c.vocabulary, here.reshape(-1, 1), bits))

    def bigrams_sent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                c = _Chunk(row)
                keys, _, _, _, seen = c.bigrams()
                yield pd.DataFrame(_sent(c.id, keys, seen.reshape(-1, 1), bits))

    word_replies = _exchanged(corpus.mapInPandas(words_sent, sent), _count_words, 1, f"{name}-words")
    n, v, *word_numbers = _statistics(word_replies, RELIABLE + 3)
    bigram_replies = _exchanged(corpus.mapInPandas(bigrams_sent, sent), _count_bigrams, 1, f"{name}-bigrams")
    word_table, bigram_table = good_turing(word_numbers), good_turing(_statistics(bigram_replies, RELIABLE + 1))

    def evaluated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per chunk: what is known of each text's score, and what the back-off
        weights need: sums over the bigrams this chunk answers for, and the
        histories whose weight it asks for."""
        for frame in frames:
            for row in frame.itertuples():
                c = _Chunk(row)
                count = _joined(row.words, np.int64)
                keys, first, second, at, _ = c.bigrams()
                answer = _joined(row.bigrams, np.int64)
                together, owned = answer // 2, (answer % 2).astype(bool)
                size = len(c.vocabulary) + 1
                context = np.append(count, count[np.searchsorted(c.vocabulary, END)])
                docs_here = len(c.lengths)
                known = count[c.ids] > 0
                base = np.log10((count[c.ids] + 1) / (n + v + 1))
                # seen bigrams, then the unigram part of the others
                unigram = discounted(count, word_table) / max(n, 1)
                unknown = 1.0 if n == 0 else 1.0 - (_unigram_mass / n)
                unigram = np.where(count > 0, unigram, unknown)
                with np.errstate(divide="ignore", invalid="ignore"):
                    direct = np.log10(discounted(together, bigram_table) / context[first])
                value = np.where(together > 0, direct, np.log10(unigram[second]))
                asks = (together == 0) & (context[first] > 0)
                value = np.where(asks, value - np.log10(np.maximum(context[first], 1)), value)
                score = np.bincount(c.doc, value[at], docs_here)
                ask = asks[at]
                events_doc, events_word = c.doc[ask], first[at[ask]]
                sums = np.hstack(
                    [_per_history(first[owned], together[owned], size), _per_history(first[owned], count[second[owned]], size)]
                )
                wanted = np.zeros(size, np.int64)
                wanted[events_word] = 1
                names = np.append(c.vocabulary, START)
                use = np.flatnonzero(sums.any(axis=1) | (wanted > 0))
                use = use[np.argsort(names[use])]
                number = np.full(size, -1, np.int64)
                number[use] = np.arange(len(use))
                parts = _sent(c.id, names[use], np.column_stack([wanted[use], sums[use]]), bits)
                state = [
                    pack(c.doc_ids), pack(c.held.astype(np.uint8)), pack(c.lengths),
                    pack(np.bincount(c.doc, known, docs_here).astype(np.int64)),
                    pack(np.bincount(c.doc, base, docs_here)), pack(score),
                    pack(events_doc.astype(np.int32)), pack(number[events_word].astype(np.int32)),
                ]
                if parts["bucket"]:
                    yield pd.DataFrame({**parts, "state": [None] * len(parts["bucket"])})
                yield pd.DataFrame({"bucket": [-1], "chunk": [c.id], "keys": [None], "sums": [None], "state": [state]})

    _unigram_mass = _total_mass(word_replies, n, word_numbers, word_table)
    inputs = corpus.join(_by_chunk(word_replies, "words"), "chunk").join(_by_chunk(bigram_replies, "bigrams"), "chunk")
    state = written(inputs.mapInPandas(evaluated, f"{sent}, state array<binary>"), f"{name}-state")

    def weights(totals: np.ndarray, at: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Reply: mass left to a history's unseen words (times its count) over
        what the unigrams of its seen words leave; 0 where nobody asked."""
        counts, unigrams = totals[:, 1 : 1 + _WIDTH], totals[:, 1 + _WIDTH :]
        full = counts[:, :RELIABLE] @ np.arange(1, RELIABLE + 1) + counts[:, RELIABLE + 1]
        left = full - _mass(counts, bigram_table)
        ratio = left / (1.0 - _mass(unigrams, word_table) / max(n, 1))
        return np.where(sums[:, 0] > 0, ratio[at], 0.0), [0]

    asked = state.where("bucket >= 0").select("bucket", "chunk", "keys", "sums")
    weight_replies = _exchanged(asked, weights, 1 + 2 * _WIDTH, f"{name}-weights")

    def finished(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kinds = [np.int64, np.uint8, np.int64, np.int64, np.float64, np.float64, np.int32, np.int32]
        for frame in frames:
            for row in frame.itertuples():
                ids, held, lengths, known, base, score, doc, word = (
                    unpack(x, k) for x, k in zip(row.state, kinds, strict=True)
                )
                if len(doc):
                    score = score + np.bincount(doc, np.log10(_joined(row.weights, np.float64)[word]), len(score))
                yield pd.DataFrame(
                    {
                        "doc_id": ids,
                        "held_out": held.astype(bool),
                        "n_tokens": lengths,
                        "n_known": known,
                        "train_tokens": np.full(len(ids), n, np.int64),
                        "base_score": base,
                        "score": score,
                    }
                )

    done = state.where("bucket = -1").select("chunk", "state").join(_by_chunk(weight_replies, "weights"), "chunk", "left")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return done.mapInPandas(finished, schema).withColumn("doc_id", id_back(F.col("doc_id")))


def _total_mass(word_replies: DataFrame, n: int, numbers: list[int], table: np.ndarray) -> float:
    """Sum of all discounted word counts, from the bucket statistics."""
    v = _statistics(word_replies, 2)[1]
    small = np.array(numbers[:RELIABLE], float)
    above = n - small @ np.arange(1, RELIABLE + 1)
    return float(small @ table[1 : RELIABLE + 1] + above - table[-1] * (v - small.sum()))


def seventh_held_out(docs: DataFrame) -> object:
    return id_remainder(docs["doc_id"], 7) == 2
