"""Ranked lexical search by sequential impact-sorted reads, no random access (operator 13).

The index is a written table of posting lists.  Documents are taken in shards of
bounded text; a shard's list of a term holds its documents by falling impact,
the part of a score that needs no weight of the term.  For a block of items each
shard is searched on its own: all lists of an item are read in step, in runs of
doubling length.  A document seen has a lower bound (what was read of it) and an
upper bound (plus what the lists it was not met in may still hold, which is
their next impact).  Reading goes on until the sum of the next impacts is under
the k-th lower bound, so that nothing unseen can enter or tie, and every
document that may still belong has equal bounds; lists that all of those were
met in are read no further.  Shards give their k best with final scores, which
are merged per item.

Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import NO_ID, arrow_rows, broadcast_if_small, id_and_bytes, word_hashes, written

BEST = 10
#: Length normalisation in hundredths, and the saturation of repeated terms.
LENGTH_SHARE = 75
SATURATION = 8
SCALE = 1_000_000_000
#: Text of a shard; one longer text stands alone.
SHARD_BYTES = 4 << 20
#: Text hashed at a time, cut between terms.
PIECE_BYTES = 1 << 20
#: Terms of the items that are searched together in one task.
BLOCK_TERMS = 1 << 16
#: Terms up to which a table of them, or of item blocks, is broadcast.
BROADCAST_TERMS = 1 << 20
FIRST_READ = 64
BATCH_ROWS = 500

#: What is no byte of a term becomes a space.
_TERM_BYTES = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
_POSTINGS = pa.schema([
    ("term", pa.int64()), ("shard", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("places", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int32())),
])
POSTINGS_SCHEMA = "term long, shard long, doc_ids array<long>, places array<int>, impacts array<int>"


class Totals(NamedTuple):
    """Documents with a term, and all their terms."""

    documents: int
    terms: int


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [len(text.translate(_TERM_BYTES).split()) for text in batch.column(1).to_pylist() if text]
        sums = [sum(map(bool, counts)), sum(counts)]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()) for n in sums], names=["documents", "terms"])


def corpus_totals(docs: DataFrame) -> Totals:
    counted = id_and_bytes(docs).mapInArrow(_count_batches, "documents long, terms long")
    return Totals(*counted.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in Totals._fields]).first())


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Signed hashes of all terms of the texts, in order, and the number of each text's text."""
    hashes, owners, waiting, size = [], [], [], 0

    def flush() -> None:
        nonlocal size
        if waiting:
            found, offsets = word_hashes([piece for _, piece in waiting])
            hashes.append(found.view(np.int64))
            owners.append(np.repeat([owner for owner, _ in waiting], np.diff(offsets)))
        waiting.clear()
        size = 0

    for owner, text in enumerate(texts):
        text = text.translate(_TERM_BYTES)
        start = 0
        while start < len(text):
            stop = len(text)
            if stop - start > PIECE_BYTES:
                stop = text.rfind(b" ", start, start + PIECE_BYTES) + 1
                if stop <= start:  # one term longer than a piece
                    stop = text.find(b" ", start + PIECE_BYTES) + 1 or len(text)
            if size + stop - start > PIECE_BYTES:
                flush()
            waiting.append((owner, text[start:stop]))
            size += stop - start
            start = stop
    flush()
    empty = np.empty(0, np.int64)
    return np.concatenate([empty, *hashes]), np.concatenate([empty, *owners])


def _impact_sorted(doc_ids: list[int], texts: list[bytes], shard: int, totals: Totals) -> pa.RecordBatch:
    """One shard's posting lists: a row per term, its documents by falling impact, then place."""
    hashes, owners = term_hashes(texts)
    terms, term = np.unique(hashes, return_inverse=True)
    keys, tf = np.unique(term * len(texts) + owners, return_counts=True)
    term, place = np.divmod(keys, len(texts))
    n = np.bincount(owners, minlength=len(texts)).astype(np.int64)
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * totals.documents) // max(totals.terms, 1)
    impact = (SCALE * tf) // (1000 * tf + SATURATION * m[place])
    order = np.lexsort((place, -impact, term))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(terms))))).astype(np.int32)
    lists = [
        pa.ListArray.from_arrays(offsets, pa.array(values[order].astype(kind)))
        for values, kind in ((np.asarray(doc_ids, np.int64)[place], np.int64), (place, np.int32), (impact, np.int32))
    ]
    return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.full(len(terms), shard)), *lists], schema=_POSTINGS)


def _posting_batches(totals: Totals, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int] = []
    texts: list[bytes] = []
    size, shard = 0, TaskContext.get().partitionId() << 32
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if texts and size + len(text or b"") > SHARD_BYTES:
                yield _impact_sorted(ids, texts, shard, totals)
                ids, texts, size, shard = [], [], 0, shard + 1
            if text:
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
    if texts:
        yield _impact_sorted(ids, texts, shard, totals)


def posting_lists(docs: DataFrame, totals: Totals) -> DataFrame:
    """Documents -> (term, shard, doc_ids, places, impacts): impact-sorted lists of every term of every
    shard; places number a shard's documents, so rows that repeat an id stay apart."""
    return id_and_bytes(docs).mapInArrow(partial(_posting_batches, totals), POSTINGS_SCHEMA)


def _item_term_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        hashes, owners = term_hashes([bytes(t) if t is not None else b"" for t in frame["text"]])
        rows = pd.DataFrame({"item_id": frame["item_id"].to_numpy()[owners], "term": hashes})
        yield rows.groupby(["item_id", "term"]).size().reset_index(name="repeats")


def item_terms(items: DataFrame) -> DataFrame:
    """Items (item_id, text) -> (item_id, term, repeats); of texts that share an id the least one counts."""
    known = items.where("item_id is not null and text is not null")
    one = known.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").cast("binary").alias("text"))
    return one.mapInPandas(_item_term_rows, "item_id long, term long, repeats long")


def resolved_best(lists: list[tuple[np.ndarray, np.ndarray, int]], doc_ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (place, score) by falling score, then id; ``lists`` are a shard's (places,
    impacts, weight), ``doc_ids`` the ids of its places."""
    places = np.concatenate([p for p, _, _ in lists])
    weights = np.array([w for _, _, w in lists], np.int64)
    ends = np.cumsum([len(p) for p, _, _ in lists])
    starts = np.concatenate(([0], ends[:-1]))
    gains = np.concatenate([i for _, i, _ in lists]).astype(np.int64) * np.repeat(weights, ends - starts)
    lower = np.zeros(len(doc_ids), np.int64)
    met = np.zeros((len(lists), len(doc_ids)), bool)
    follow = None  # once no unseen document can enter: those that may belong
    reading = np.arange(len(lists))
    depth, run = 0, FIRST_READ
    while True:
        at = (starts[reading] + depth)[:, None] + np.arange(run)
        row, col = np.nonzero(at < ends[reading][:, None])
        at, row = at[row, col], reading[row]
        if follow is not None:
            wanted = follow[places[at]]
            at, row = at[wanted], row[wanted]
        np.add.at(lower, places[at], gains[at])
        met[row, places[at]] = True
        depth, run = depth + run, depth + run
        left = starts + depth < ends
        ahead = np.where(left, gains[np.minimum(starts + depth, len(gains) - 1)], 0)
        if len(doc_ids) > k:
            kth = np.partition(lower, len(lower) - k)[-k]
        else:
            kth = 0
        unseen = int(ahead.sum())
        upper = lower + unseen - ahead @ met
        inside = (lower > 0) & (upper >= kth)
        if unseen == 0 or (unseen < kth and (upper[inside] == lower[inside]).all()):
            break
        if unseen < kth:
            follow = inside
        reading = np.flatnonzero(left & ~met[:, inside].all(axis=1)) if follow is not None else np.flatnonzero(left)
    found = np.flatnonzero(inside)
    order = np.lexsort((doc_ids[found], -lower[found]))[:k]
    return [(int(p), int(lower[p])) for p in found[order]]


def _search_shard(k: int, postings: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """One shard and one block of items: every item's k best of the shard."""
    lists = {t: (p, i) for t, p, i in zip(postings["term"], postings["places"], postings["impacts"], strict=True)}
    n = 1 + max((int(p.max()) for p, _ in lists.values()), default=-1)
    ids = np.zeros(n, np.int64)
    for p, d in zip(postings["places"], postings["doc_ids"], strict=True):
        ids[p] = d
    rows = []
    for items, all_terms, all_weights in zip(blocks["items"], blocks["terms"], blocks["weights"], strict=True):
        for item, terms, weights in zip(items, all_terms, all_weights, strict=True):
            own = [(*lists[t], w) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if t in lists]
            if own:
                rows.extend((item, ids[p], score) for p, score in resolved_best(own, ids, k))
    return pd.DataFrame(rows, columns=["item_id", "doc_id", "score"]).astype("int64")


def search(postings: DataFrame, terms: DataFrame, totals: Totals, k: int = BEST) -> DataFrame:
    """(written posting lists, written item_terms, totals of the corpus) -> (item_id, rank, doc_id, score)."""
    df = postings.groupBy("term").agg(F.sum(F.size("places")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(totals.documents)) + 2) / (2 * F.col("df") + 1)))
    weighted = terms.join(df.select("term", weight.alias("w")), "term").where("w > 0")
    weighted = written(weighted.select("item_id", "term", (F.col("w") * F.col("repeats")).alias("weight")), "weighted")

    n_terms = weighted.count()
    n_blocks = -(-n_terms // BLOCK_TERMS) or 1
    weighted = weighted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)))
    each = weighted.groupBy("block", "item_id").agg(F.collect_list(F.struct("term", "weight")).alias("own"))
    each = each.select("block", F.struct("item_id", F.col("own.term").alias("terms"), F.col("own.weight").alias("weights")).alias("i"))
    blocks = each.groupBy("block").agg(F.collect_list("i").alias("i")).select(
        "block", F.col("i.item_id").alias("items"), F.col("i.terms").alias("terms"), F.col("i.weights").alias("weights")
    )
    blocks = written(blocks, "blocks")

    wanted = broadcast_if_small(written(weighted.select("term", "block").distinct(), "wanted"), BROADCAST_TERMS)
    lists = postings.join(wanted, "term")
    pairs = lists.select("shard", "block").distinct()
    pairs = written(pairs.join(F.broadcast(blocks) if n_terms <= BROADCAST_TERMS else blocks, "block"), "pairs")

    def search_shard(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return _search_shard(k, own, asked)

    both = lists.groupBy("shard", "block").cogroup(pairs.groupBy("shard", "block"))
    found = both.applyInPandas(search_shard, "item_id long, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = written(found, "found").where(F.col("doc_id") != NO_ID).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0.

    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII,
    with A-Z lower-cased, in whole texts.
    With N documents that hold a term, L terms in them, n terms in the document and
    df documents holding the term, a term weighs w = floor(1000 * ln((2N + 2) /
    (2df + 1))) and counts w * ((10**9 * tf) div (1000 * tf + 8 * m)), m = 25 +
    (75 * n * N) div L, once for each time the item holds it.  Equal scores are
    ranked by ascending doc_id.

    NULL and empty texts and texts without terms have no score.  Documents without
    an id count in N, L and df but are not returned; rows that repeat a doc_id are
    documents of their own, each may be returned.  Items without an id or a term
    get no rows; of texts that repeat an item_id the least one counts.  Extra
    columns are ignored.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    with arrow_rows(spark, BATCH_ROWS):
        totals = corpus_totals(docs)
        terms = written(item_terms(items), "item_terms")
        asked = broadcast_if_small(written(terms.select("term").distinct(), "asked"), BROADCAST_TERMS)
        postings = written(posting_lists(docs, totals).join(asked, "term", "left_semi"), "postings")
        return written(search(postings, terms, totals, k), "ranked")


ORACLE = f"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS t
  FROM documents
),
docs AS MATERIALIZED (SELECT r, doc_id, t, len(t) AS n FROM cut WHERE len(t) > 0),
totals AS (SELECT count(*) AS nd, sum(n) AS nt FROM docs),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM docs) GROUP BY r, term),
weights AS MATERIALIZED (
  SELECT term, CAST(floor(1000 * ln((2.0 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, nd
),
asked AS MATERIALIZED (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term
    FROM benchmark) GROUP BY item_id, term
),
scored AS (
  SELECT a.item_id, d.r, d.doc_id,
    CAST(sum(a.repeats * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + CAST((75 * d.n * o.nd) // o.nt AS BIGINT))))) AS BIGINT) AS score
  FROM asked a JOIN weights w USING (term) JOIN tf USING (term) JOIN docs d ON d.r = tf.r, totals o
  WHERE d.doc_id IS NOT NULL
  GROUP BY a.item_id, d.r, d.doc_id
),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {BEST}
"""
