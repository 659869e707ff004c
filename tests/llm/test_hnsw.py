"""Graph search against brute force over all vectors."""

import math

import numpy as np
import pytest
from llm_helpers import SMALL
from pyspark.sql import functions as F

from ledgerlens.llm.hnsw import LINKS, _layer_sizes, _unit, build_layers, cosines, nearest, scaled

SCHEMA = "vec_id long, embedding array<float>"


def by_fifty():
    return F.pmod("vec_id", F.lit(50)) == 0


def plain_nearest(rows, k=5):
    """{query id: [(vec_id, cosine)]} over every pair, in double precision."""
    vectors = {i: np.asarray(v, np.float64) for i, v in rows}
    out = {}
    for q in (i for i in vectors if i % 50 == 0):
        every = [
            (-float((v * vectors[q]).sum() / (math.sqrt((v * v).sum()) * math.sqrt((vectors[q] ** 2).sum()))), i)
            for i, v in vectors.items()
            if i != q and len(v) == len(vectors[q])
        ]
        out[q] = [(i, -s) for s, i in sorted(every)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("shard_rows", [100, 8192])
def test_recall_and_scores(spark, shard_rows):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    want = plain_nearest([(r["vec_id"], r["embedding"]) for r in table.collect()])
    got = found(nearest(table, by_fifty(), shard_rows=shard_rows))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    for q in want:
        scores = dict(want[q])
        assert all(abs(s - scores[i]) < 1e-12 for i, s in got[q] if i in scores)
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)


def test_recall_among_clusters_and_copies(spark):
    """A third exact copies of one vector, a third near copies of another, the rest apart."""
    rng = np.random.default_rng(5)
    hot, near = rng.normal(size=24), rng.normal(size=24)
    rows = []
    for i in range(1500):
        v = hot if i % 3 == 0 else near + rng.normal(size=24) * 1e-3 if i % 3 == 1 else rng.normal(size=24)
        rows.append((i, [float(x) for x in v.astype(np.float32)]))
    want = plain_nearest(rows)
    got = found(nearest(spark.createDataFrame(rows, SCHEMA), by_fifty(), shard_rows=600))
    assert [i for i, _ in got[0]] == [3, 6, 9, 12, 15]  # ties of exact copies: the smallest ids
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_layers_are_bounded_and_reachable():
    rng = np.random.default_rng(2)
    points = _unit(rng.normal(size=(3000, 16)))
    order, sizes = _layer_sizes(np.arange(3000))
    assert sorted(order) == list(range(3000)) and sizes[0] == 3000 and 100 < sizes[1] < 300
    layers = build_layers(points, sizes)
    assert [x.shape for x in layers] == [(s, LINKS if n else 2 * LINKS) for n, s in enumerate(sizes)]
    reached, edge = {0}, [0]
    while edge:
        edge = [j for i in edge for j in layers[0][i].tolist() if j >= 0 and j not in reached and not reached.add(j)]
    assert len(reached) >= 0.999 * 3000


def test_cosine_of_extreme_vectors():
    v = scaled(np.array([[1e300, 1e300], [1e-300, -1e-300], [3.0, 4.0]]))
    assert np.allclose(cosines(v, v[0]), [1, 0, 7 / (5 * math.sqrt(2))])


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [0.0, 0.0]),
        (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (100, [0.0, 0.0]),
        (9, [1.0, 0.0]), (9, [1.0, 0.0]), (150, [1.0, 0.0, 0.0]), (10, [-1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"rank": F.lit("x"), "score": F.lit(1), "shard": F.lit(3)})
    got = found(nearest(df, by_fifty()))
    assert set(got) == {0, 50}  # 150 meets no vector of its length, 100 is zero
    assert [i for i, _ in got[0]] == [1, 9, 2, 50, 10] and got[0][0][1] == 1.0
    assert [i for i, _ in got[50]] == [2, 0, 1, 9, 10]


def test_fewer_candidates_and_empty(spark):
    assert found(nearest(spark.createDataFrame([(0, [1.0]), (7, [-2.0])], SCHEMA), by_fifty())) == {0: [(7, -1.0)]}
    assert nearest(spark.createDataFrame([], SCHEMA), by_fifty()).collect() == []
    doubles = spark.createDataFrame([(0, [1e200, 0.0]), (7, [1e200, 1e200])], "vec_id long, embedding array<double>")
    ((i, s),) = found(nearest(doubles, by_fifty()))[0]
    assert i == 7 and abs(s - math.sqrt(0.5)) < 1e-15
