import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm.queries import QUERIES
from ledgerlens.llm.toxicity import ToxicityModel, fit_toxicity, maximal_segments, score_toxicity

SF = "/root/testdata/sf0.01"


def best_then_sides(scores, low, high):
    best = None
    for i in range(low, high):
        total = 0.0
        for j in range(i, high):
            total += scores[j]
            if total > 0 and (best is None or total > best[2] + 1e-12):
                best = (i, j + 1, total)
    if best is None:
        return []
    return best_then_sides(scores, low, best[0]) + [best[:2]] + best_then_sides(scores, best[1], high)


def test_maximal_segments_by_definition():
    draw = np.random.default_rng(1)
    for _ in range(400):
        scores = draw.normal(size=draw.integers(0, 30)) - 0.2
        assert [s[:2] for s in maximal_segments(scores)] == best_then_sides(scores, 0, len(scores))
    assert maximal_segments(np.array([1.0, -5.0, 2.0, -1.0, 3.0])) == [(0, 1, 1.0), (2, 5, 4.0)]


def test_held_out_accuracy(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op10_toxic_segments"](spark, SF).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows.values())
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    wrong = [i for i, y in labels if rows[i]["held_out"] and not y and rows[i]["predicted"]]
    assert len(rows) == 1000 and len(wrong) <= 5


def made_up(spark, n=600):
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = draw.choices(words, k=120)
        toxic = i % 5 == 0
        if toxic:
            at = draw.randrange(100)
            text[at : at + 6] = draw.choices(["vileness", "nastily", "grotty"], k=6)
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_passages_and_scores(spark):
    docs, labels = made_up(spark)
    model = fit_toxicity(docs, labels, F.col("doc_id") % 3 != 0)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in score_toxicity(docs, model).collect():
        toxic = r["doc_id"] % 5 == 0
        assert (r["score"] >= 0.3) == toxic
        found = [texts[r["doc_id"]][p["start"] : p["end"]] for p in r["passages"]]
        assert len(found) == toxic
        assert all(set(f.split()) <= {"vileness", "nastily", "grotty"} for f in found)


def test_odd_rows(spark, odd_documents, no_documents):
    docs, labels = made_up(spark, 300)
    model = fit_toxicity(docs, labels, F.lit(True))
    rows = score_toxicity(odd_documents, model).collect()
    assert len(rows) == odd_documents.count()
    calm = model.probability(0.0)
    assert all(r["score"] == calm and r["passages"] == [] for r in rows if r["doc_id"] in (1, 2, 3, 4, 5))
    assert score_toxicity(no_documents, model).count() == 0
    nothing = labels.where("toxic = 5")
    flat = fit_toxicity(docs, nothing, F.lit(True))
    assert isinstance(flat, ToxicityModel) and score_toxicity(odd_documents, flat).count() == odd_documents.count()
    odd = labels.union(spark.createDataFrame([(None, 1), (3, None), (0, 1), (0, 0)], labels.schema))
    assert len(fit_toxicity(docs, odd, F.lit(True)).words) == len(model.words)
