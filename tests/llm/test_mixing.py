from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm.mixing import FLATTEN, mix_to_targets, raked
from llm_helpers import split_words


def test_margins_meet_their_targets(spark):
    cells = [(s, lang, t, 10 + 37 * i * j + 101 * k) for i, s in enumerate("abcd") for j, lang in enumerate(["en", None]) for k, t in enumerate(["x", "y", "z"])]
    out = raked(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), rounds=60).collect()
    total = sum(c[3] for c in cells)
    for at, margin in enumerate(("source", "lang", "topic")):
        tokens, target = Counter(), Counter()
        for c in cells:
            tokens[c[at]] += c[3]
        for r in out:
            target[r[margin]] += r["target"]
        norm = sum((v / total) ** FLATTEN[margin] for v in tokens.values())
        for value, v in tokens.items():
            assert target[value] == pytest.approx((v / total) ** FLATTEN[margin] / norm * total, rel=1e-6)


def test_cells_in_one_task_or_many_rake_alike(spark, monkeypatch):
    cells = spark.createDataFrame(
        [(f"s{i % 7}", "en" if i % 3 else None, f"t{i % 2}", 1 + i * i % 97) for i in range(42)],
        "source string, lang string, topic string, tokens long",
    ).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    one = {tuple(r)[:4]: r["target"] for r in raked(cells).collect()}
    assert raked(cells).columns == ["source", "lang", "topic", "tokens", "target"]
    monkeypatch.setattr("ledgerlens.llm.mixing.ONE_TASK_CELLS", 0)
    many = {tuple(r)[:4]: r["target"] for r in raked(cells).collect()}
    assert set(one) == set(many) and all(many[k] == pytest.approx(one[k], rel=1e-9) for k in one)


def test_draw_follows_probability(spark):
    rows = [(i, "one two three", "en", "big" if i % 10 else "small") for i in range(4000)]
    out = mix_to_targets(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r["n_tokens"] for r in out} == {3} and {r["topic"] for r in out} == {"prose"}
    chance = {r["source"]: r["probability"] for r in out}
    assert chance["small"] == 1.0 and 0.3 < chance["big"] < 0.7
    picked = Counter((r["source"], r["picked"]) for r in out)
    assert picked["small", True] == 400
    assert abs(picked["big", True] / 3600 - chance["big"]) < 0.03


def test_odd_rows(spark, odd_documents, no_documents):
    out = mix_to_targets(odd_documents)
    rows = out.collect()
    assert len(rows) == odd_documents.count() and out.columns.count("topic") == 1
    texts = {str(r["doc_id"]): r["text"] for r in odd_documents.where("doc_id is not null").collect()}
    for r in rows:
        if r["doc_id"] is not None:
            assert r["n_tokens"] == len(split_words(texts[str(r["doc_id"])]))
    empty = [r for r in rows if r["doc_id"] in (1, 2)]
    assert {(r["topic"], r["n_tokens"], r["probability"], r["picked"]) for r in empty} == {("empty", 0, 1.0, True)}
    assert mix_to_targets(no_documents).count() == 0
    assert mix_to_targets(odd_documents.where(F.col("doc_id") < 3)).count() == 2


def test_one_rare_cell_does_not_empty_the_pipeline(spark):
    rows = [(i, "one two three", "en", f"s{i % 4}") for i in range(8000)]
    schema = "doc_id long, text string, lang string, source string"
    rare = [(9001, "four five", "xx", "rare")]
    for extra in ([], rare):
        mixed = corpus_pipeline.mixing(spark, spark.createDataFrame(rows + extra, schema), "").collect()
        assert sum(r["n_tokens"] for r in mixed) >= 0.48 * 24_000
    assert {r["probability"] for r in mixed if r["source"] == "rare"} == {1.0}


def test_least_share_keeps_the_weights_of_cells_below_one(spark):
    rows = [(i, "one two three", "en", "big" if i % 10 else "small") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")

    def chances(share):
        found = mix_to_targets(docs, least_share=share).select("source", "probability").distinct().collect()
        return {r["source"]: r["probability"] for r in found}

    exact = chances(0.0)
    assert chances(0.1) == exact  # more stay than stated
    assert chances(0.8) == {"small": 1.0, "big": pytest.approx((0.8 - 0.1) / 0.9, abs=1e-8)}
    assert chances(1.0) == {"small": 1.0, "big": 1.0}
