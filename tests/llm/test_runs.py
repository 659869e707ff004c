"""Periodic runs against a brute-force search of every period and stretch."""

import hashlib
import random
import zlib

import pytest
from llm_helpers import split_words

from ledgerlens.llm.runs import collapsed, find_runs, numbered, periodic_runs, run_digests


def plain_runs(tokens):
    """Every maximal stretch of every period that is long enough and has no smaller period."""
    n, out = len(tokens), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and tokens[j] == tokens[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q):
                part = tokens[i : i + length]
                if not any(part[s:] == part[:-s] for s in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, tokens):
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(tokens), h // 10
    if h % 10 or not n:
        return tokens
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [tokens[i] if i < a else tokens[a + (i - a) % p] for i in range(n)]


def plain_digest(doc_id, text):
    tokens = split_words(text)
    tokens = planted(doc_id, tokens) if doc_id is not None else tokens
    runs = plain_runs(tokens)
    best = (None,) * 4
    if runs:
        s, length, q = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    left = " ".join(t for i, t in enumerate(tokens) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, left)))


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_of_random_sequences(letters):
    rng = random.Random(letters)
    for _ in range(150):
        tokens = [rng.choice("abcdef"[:letters]) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(3)):  # loops of every period, with a flaw now and then
            if tokens:
                a = rng.randrange(len(tokens))
                p = rng.randrange(1, 40)
                loop = [rng.choice("abcdefgh") for _ in range(p)]
                stretch = [loop[i % p] for i in range(rng.randrange(1, 5 * p + 30))]
                tokens[a:a] = stretch
        ids = numbered([t.encode() for t in tokens])
        assert find_runs(ids) == plain_runs(tokens)


def test_nested_and_overlapping_runs():
    inner = ["x"] * 30 + ["y"]
    tokens = inner * 4 + ["z"] + ["x", "y"] * 20
    runs = find_runs(numbered([t.encode() for t in tokens]))
    assert runs == plain_runs(tokens) and {q for _, _, q in runs} == {1, 2, 31}


def test_collapsed_keeps_first_periods():
    assert collapsed(30, [(2, 26, 2)]).tolist() == [True] * 4 + [False] * 24 + [True] * 2


def test_one_word_repeated_is_linear():
    ids = numbered([b"a"] * 300_000)
    assert find_runs(ids) == [(0, 300_000, 1)]


def test_query_against_brute_force(spark, documents):
    got = {r["doc_id"]: tuple(r) for r in run_digests(documents).collect()}
    rows = [r for r in documents.collect() if len(split_words(r["text"])) < 1500]
    assert len(rows) > 150 and sum(got[r["doc_id"]][1] for r in rows) > 5
    for r in rows:
        assert got[r["doc_id"]] == plain_digest(r["doc_id"], r["text"])


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [tuple(r) for r in run_digests(odd_documents.withColumn("runs", odd_documents["id"])).collect()]
    assert len(rows) == odd_documents.count()
    empty = hashlib.sha256(b"").hexdigest()
    by_id = {r[0]: r for r in rows}
    assert by_id[1][1:] == (0, None, None, None, None, empty, empty) == by_id[2][1:] == by_id[3][1:]
    for r in odd_documents.collect():
        if len(r["text"] or "") < 1000:
            assert plain_digest(r["doc_id"], r["text"]) in rows
    assert run_digests(no_documents).collect() == []


def test_operator_keeps_texts(spark):
    text = "start " + "a\tb  c\n" * 10 + "end"
    row = periodic_runs(spark.createDataFrame([(5, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 30, 3)]
    assert row["collapsed"] == "start a b c end" and row["n_words"] == 32


