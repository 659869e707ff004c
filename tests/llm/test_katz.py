import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm.katz import RELIABLE, good_turing, katz_scores
from ledgerlens.llm.queries import QUERIES
from llm_helpers import SMALL, split_words

END, START = "\0end", "\0start"


class PlainKatz:
    """The same model from dictionaries of words."""

    def __init__(self, texts):
        self.words, self.after = Counter(), defaultdict(Counter)
        for w in texts:
            self.words.update(w)
            for a, b in zip([START, *w], w):
                self.after[a][b] += 1
        self.n = sum(self.words.values())
        single, double = Counter(self.words.values()), Counter(x for c in self.after.values() for x in c.values())
        self.word_table = good_turing([single[r] for r in range(1, RELIABLE + 2)])
        self.pair_table = good_turing([double[r] for r in range(1, RELIABLE + 2)])
        self.unknown = 1 - sum(self.less(c, self.word_table) for c in self.words.values()) / self.n if self.n else 1.0
        self.weights = {}

    @staticmethod
    def less(count, table):
        return table[count] if count <= RELIABLE else count - table[-1]

    def single(self, b):
        return self.less(self.words[b], self.word_table) / self.n if self.words[b] else self.unknown

    def pair(self, a, b):
        seen = self.after.get(a)
        if not seen:
            return self.single(b)
        total = sum(seen.values())
        if b in seen:
            return self.less(seen[b], self.pair_table) / total
        if a not in self.weights:
            left = 1 - sum(self.less(c, self.pair_table) for c in seen.values()) / total
            self.weights[a] = left / (1 - sum(map(self.single, seen)))
        return self.weights[a] * self.single(b)

    def score(self, w):
        return sum(math.log10(self.pair(a, b)) for a, b in zip([START, *w], w))


def test_query_against_plain_model(spark, documents):
    texts = {r["doc_id"]: [*split_words(r["text"], lower=True), END] for r in documents.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    model = PlainKatz([w for i, w in texts.items() if not held[i]])
    assert any(held.values())
    for a in [START, *list(model.after)[:5]]:
        assert sum(model.pair(a, b) for b in [*model.words, "\0other"]) == pytest.approx(1, abs=1e-9)
    ours = base = 0.0
    for r in QUERIES["op5_katz_backoff"](spark, SMALL).collect():
        w = texts[r["doc_id"]]
        plain = sum(math.log10((model.words[x] + 1) / (model.n + len(model.words) + 1)) for x in w)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(w), model.n)
        assert r["n_known"] == sum(1 for x in w if model.words[x])
        assert r["base_score"] == pytest.approx(plain, abs=1e-6)
        assert r["score"] == pytest.approx(model.score(w), abs=1e-6)
        if held[r["doc_id"]]:
            ours, base = ours + r["score"], base + r["base_score"]
    assert ours > base  # held-out log probability beats add-one unigrams


def test_good_turing_keeps_counts_ordered_or_falls_back():
    table = good_turing([1000, 400, 210, 130, 90, 60])
    assert all(0 < table[r] < r for r in range(1, RELIABLE + 1))
    assert list(good_turing([0, 3, 0, 0, 0, 0])[1:3]) == [0.5, 1.5]
    assert list(good_turing([0] * 6)[1:3]) == [0.5, 1.5]


def test_odd_rows(spark, odd_documents, no_documents):
    rows = katz_scores(odd_documents, F.col("doc_id") == 7).collect()
    assert len(rows) == odd_documents.count()
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert sorted(r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3, None)) == [1, 1, 1, 1, 7]
    assert [r["held_out"] for r in rows if r["doc_id"] == 7] == [True, True]
    assert katz_scores(no_documents, F.lit(True)).count() == 0
    untrained = katz_scores(odd_documents, F.lit(True)).collect()
    assert {(r["score"], r["base_score"], r["train_tokens"]) for r in untrained} == {(0.0, 0.0, 0)}
