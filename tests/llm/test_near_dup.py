import random
from collections import Counter, defaultdict

import pytest

from ledgerlens.llm import near_dup
from ledgerlens.llm.graph import connected_components
from ledgerlens.llm.near_dup import near_duplicates
from ledgerlens.llm.queries import QUERIES
from llm_helpers import SMALL, split_words


def brute_force(texts, width, percent):
    sets = {}
    for i, text in texts.items():
        w = split_words(text, lower=True)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for i, s in sets.items():
        common = Counter(j for g in s for j in where[g] if j > i)
        for j, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def test_query_against_brute_force(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert result(QUERIES["op4_minhash_forest"](spark, SMALL)) == brute_force(texts, 2, 80)


@pytest.mark.parametrize("slice_shingles", [near_dup.SLICE_SHINGLES, 5_000])
def test_crowded_region_of_noisy_copies(spark, monkeypatch, slice_shingles):
    """More copies than a small region, with noise on either side of the limit,
    in one slice and in several."""
    monkeypatch.setattr(near_dup, "SLICE_SHINGLES", slice_shingles)
    draw = random.Random(11)
    base = [f"w{draw.randrange(10**6)}" for _ in range(150)]
    texts = {}
    for i in range(160):
        words = list(base)
        for _ in range(draw.choice([1, 3, 6, 9, 12, 16])):
            words[draw.randrange(150)] = f"n{draw.randrange(10**6)}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    expected = brute_force(texts, 2, 80)
    assert 1 < len({c for _, c, _ in expected.values()}) < 160
    assert result(near_duplicates(df, 2, 80)) == expected


def test_odd_rows(spark, odd_documents, no_documents):
    rows = near_duplicates(odd_documents, 2, 80).collect()
    assert len(rows) == odd_documents.count()
    got = defaultdict(set)
    for r in rows:
        got[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert got[1] == {(1, True)} and got[2] == {(2, True)} and got[3] == {(3, True)}
    assert got[4] == {(4, True)} and got[5] == {(4, False)}
    assert got[None] == {(None, True)} and got[6] == {(6, True)} and got[7] == {(7, True)}
    assert near_duplicates(no_documents).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i + 1, i) for i in range(40)] + [(100 + i, 1000) for i in range(30)] + [(5, 5), (None, 3), (3, 2)]
    out = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 1000: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
