"""Interval search against plain scoring of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_helpers import SMALL
from pyspark.sql import functions as F

from ledgerlens.llm import lexical


def terms(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def plain_ranks(docs, items, k=10):
    """docs: (doc_id, text) rows; items: {item_id: text}."""
    found = [(i, Counter(terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items.items():
        scored = []
        for i, c in found:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def ranked(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_query_against_plain_scores(spark, documents):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = plain_ranks([(r["doc_id"], r["text"]) for r in documents.collect()], {r["item_id"]: r["text"] for r in items.collect()})
    assert ranked(lexical.rank_documents(documents, items)) == want and len(want) > 300


def test_many_small_shards_and_blocks(spark, documents, monkeypatch):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    want = ranked(lexical.rank_documents(documents, items))
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 100)
    monkeypatch.setattr(lexical, "BROADCAST_TERMS", 10)
    assert ranked(lexical.rank_documents(documents.repartition(7), items)) == want


@pytest.mark.parametrize("seed", range(30))
def test_bounds_resolve_members_ties_and_scores(seed):
    rng = random.Random(seed)
    n, k = rng.choice([3, 40, 700, 3000]), rng.choice([1, 3, 10])
    lists, scores = [], np.zeros(n, np.int64)
    for _ in range(rng.randrange(1, 9)):
        places = np.array(rng.sample(range(n), rng.randrange(1, n + 1)), np.int32)
        impacts = np.array([rng.choice([1, 2, 5, 300, 301, 1000]) for _ in places], np.int32)
        order = np.lexsort((places, -impacts))
        weight = rng.randrange(1, 4)
        lists.append((places[order], impacts[order], weight))
        scores[places] += weight * impacts
    ids = np.array(rng.sample(range(10 * n), n))
    want = sorted(((-int(s), int(i), p) for p, (s, i) in enumerate(zip(scores, ids)) if s), key=lambda x: x[:2])[:k]
    assert lexical.resolved_best(lists, ids, k) == [(p, -s) for s, _, p in want]


def test_reads_stop_early():
    """One strong list decides; the weak tail of a long one is not scored any more."""
    n = 100_000
    strong = (np.arange(20, dtype=np.int32), np.full(20, 1000, np.int32), 1000)
    weak = (np.arange(n, dtype=np.int32), np.sort(np.arange(n, dtype=np.int32) % 997)[::-1].copy(), 1)
    got = lexical.resolved_best([strong, weak], np.arange(n), 5)
    assert [p for p, _ in got] == [0, 1, 2, 3, 4]


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE_BYTES", 16)
    texts = [b"", b"Ab-ab ab " * 9, b"x" * 50 + b" yy " + b"z" * 40, "Größe9 a_b".encode()]
    hashes, owners = lexical.term_hashes(texts)
    monkeypatch.setattr(lexical, "PIECE_BYTES", 1 << 20)
    whole, whole_owners = lexical.term_hashes(texts)
    assert hashes.tolist() == whole.tolist() and owners.tolist() == whole_owners.tolist()
    assert np.bincount(owners, minlength=4).tolist() == [0, 27, 3, 3] and len(set(hashes.tolist())) == 1 + 3 + 3


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [
        (1, "alpha BETA word3x3"), (2, None), (3, ""), (4, "!!"), (None, "alpha"), (5, "one"), (5, "alpha"),
        (6, "one one one"), (6, "one one one"), (7, "ALPHA alpha theta"), (8, "unknownterm"),
    ]
    items = spark.createDataFrame(rows, "item_id long, text string").withColumns({"term": F.lit(1), "rank": F.lit("r")})
    docs = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    want = plain_ranks(docs, {1: rows[0][1], 5: "alpha", 6: "one one one", 7: rows[9][1]})
    got = ranked(lexical.rank_documents(odd_documents, items))
    assert got == want and {r[0] for r in got} == {1, 5, 6, 7}
    assert [r[2] for r in got if r[0] == 6] == [4, 5]  # a tie, by id
    assert lexical.rank_documents(no_documents, items).collect() == []
    assert lexical.rank_documents(odd_documents, items.limit(0)).collect() == []
