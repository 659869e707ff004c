"""Nearest neighbours over hierarchical navigable small-world graphs (operator 11).

Vectors are dealt to shards of bounded size by a hash of their id.  A task
builds its shard's graph: every distinct vector (exact copies are one node that
keeps all their ids) is a node of layer 0, an M-th of them of layer 1 and so on.
Points enter in batches, by a beam search of what stands and a comparison with
their batch; links are chosen by the rule that a neighbour must be nearer to
the point than to any neighbour already chosen.  A graph is one row of a
written table: vectors, ids and each layer's neighbour numbers as flat arrays.

Queries, in blocks, meet every shard's row by an equi-join on the shard; each
search descends the layers and widens at layer 0.  What is found is scored
anew in double precision on the original vectors, and the shards' results are
merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import arrow_rows, broadcast_if_small, mixed, written

NEAREST = 5
#: Links of a node in the upper layers; layer 0 has twice as many.
LINKS = 16
#: Width of the beam while building and while searching.
BUILD_WIDTH = 64
SEARCH_WIDTH = 128
DESCENT_WIDTH = 4
SHARD_ROWS = 8192
QUERY_BLOCK = 4096
#: Points or queries handled by one beam search.
BATCH = 256
#: Links to one node that enter a choice at a time.
NEW_AT_ONCE = 8

GRAPH_SCHEMA = "dim int, shard long, ids binary, starts binary, vectors binary, layers array<binary>"


def usable(vec_id: Column, vector: Column) -> Column:
    """Whether a row takes part: an id, and a vector of finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec_id.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Doubles times a power of two that brings the largest component near 1: no digit changes."""
    vectors = vectors.astype(np.float64)
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=-1, keepdims=True))[1])


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines of scaled vectors with a scaled query, in double precision."""
    lengths = np.sqrt((vectors * vectors).sum(axis=-1)) * np.sqrt((query * query).sum(axis=-1))
    return (vectors * query).sum(axis=-1) / lengths


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return (vectors / np.sqrt((vectors * vectors).sum(axis=-1, keepdims=True))).astype(np.float32)


# ---------------------------------------------------------------- graph


def beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes (numbers, similarities, nearest first; -1 and
    -inf where there are fewer) that a best-first walk over ``links`` finds for
    each query from its ``starts`` (-1: none)."""
    n, rows = len(points), np.arange(len(queries))
    ids = np.full((len(queries), width), -1)
    sims = np.full((len(queries), width), -np.inf, np.float32)
    open_ = np.zeros((len(queries), width), bool)
    visited = np.zeros((len(queries), n + 1), bool)
    visited[:, n] = True  # the place of -1

    def take(at: np.ndarray, nodes: np.ndarray) -> None:
        new = ~visited[at[:, None], nodes]
        visited[at[:, None], nodes] = True
        r, c = np.nonzero(new)
        found = np.full(nodes.shape, -np.inf, np.float32)
        found[r, c] = np.einsum("ij,ij->i", points[nodes[r, c]], queries[at[r]])
        every = np.concatenate((sims[at], found), axis=1)
        best = np.argpartition(-every, width - 1, axis=1)[:, :width]
        sims[at] = np.take_along_axis(every, best, 1)
        ids[at] = np.take_along_axis(np.concatenate((ids[at], np.where(new, nodes, -1)), axis=1), best, 1)
        open_[at] = np.take_along_axis(np.concatenate((open_[at], new), axis=1), best, 1)

    take(rows, starts)
    while True:
        waiting = np.where(open_[rows], sims[rows], -np.inf)
        best = waiting.argmax(axis=1)
        going = waiting[np.arange(len(rows)), best] > -np.inf
        rows, best = rows[going], best[going]
        if not len(rows):
            break
        open_[rows, best] = False
        take(rows, links[ids[rows, best]])
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def chosen(points: np.ndarray, nodes: np.ndarray, sims: np.ndarray, most: int, fill: bool) -> np.ndarray:
    """Per row at most ``most`` of its candidate ``nodes`` (nearest first by
    ``sims``, -1: none): those nearer to the row's point than to any chosen
    before, then with ``fill`` the nearest of the others; -1 after the last."""
    vectors = points[nodes]
    between = vectors @ vectors.transpose(0, 2, 1)
    taken = np.zeros(nodes.shape, bool)
    for j in range(nodes.shape[1]):
        hidden = (taken & (between[:, j] >= sims[:, j : j + 1])).any(axis=1)
        taken[:, j] = (nodes[:, j] >= 0) & ~hidden & (taken.sum(axis=1) < most)
    rank = np.where(taken, 0, np.where((nodes >= 0) & fill, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(nodes, order, 1), -1)


def _add_back_links(points: np.ndarray, links: np.ndarray, new: np.ndarray, first: int) -> None:
    """Hang the points ``first``, ``first`` + 1, ... on the nodes of their rows of ``new``;
    nodes with too many links choose among them."""
    most = links.shape[1]
    row, col = np.nonzero(new >= 0)
    node, point = new[row, col], first + row
    order = np.argsort(node, kind="stable")
    node, point = node[order], point[order]
    nodes, begin, count = np.unique(node, return_index=True, return_counts=True)
    for done in range(0, int(count.max(initial=0)), NEW_AT_ONCE):
        part = count > done
        at, width = nodes[part], min(NEW_AT_ONCE, int(count.max()) - done)
        place = (begin[part] + done)[:, None] + np.arange(width)
        fresh = np.where(place < (begin + count)[part][:, None], point[np.minimum(place, len(point) - 1)], -1)
        every = np.concatenate((links[at], fresh), axis=1)
        every = np.take_along_axis(every, np.argsort(every < 0, axis=1, kind="stable"), 1)
        full = (every >= 0).sum(axis=1) > most
        links[at[~full]] = every[~full, :most]
        if full.any():
            at, every = at[full], every[full]
            sims = np.where(every >= 0, np.einsum("ijk,ik->ij", points[every], points[at]), -np.inf)
            near = np.argsort(-sims, axis=1, kind="stable")
            links[at] = chosen(points, np.take_along_axis(every, near, 1), np.take_along_axis(sims, near, 1), most, False)


def _descended(points: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, down_to: int) -> np.ndarray:
    """Nodes to start from in layer ``down_to``: the nearest ones found in the layers above; the first node is always one."""
    starts = np.zeros((len(queries), 1), np.int64)
    for layer in range(len(layers) - 1, down_to, -1):
        found, _ = beam(points[: len(layers[layer])], layers[layer], queries, starts, DESCENT_WIDTH)
        starts = np.concatenate((np.zeros((len(queries), 1), np.int64), np.where(found == 0, -1, found)), axis=1)
    return starts


def build_layers(points: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    """Neighbour numbers of every layer (0 first); layer l holds the first ``sizes[l]`` points."""
    layers = [np.full((size, LINKS if level else 2 * LINKS), -1) for level, size in enumerate(sizes)]
    for level in range(len(sizes) - 1, -1, -1):
        links, a = layers[level], 1
        while a < sizes[level]:
            b = min(2 * a, a + BATCH, sizes[level])
            own = points[a:b]
            starts = _descended(points, layers, own, level)
            starts = np.where(starts < a, starts, -1)
            ids, sims = beam(points[:a], links[:a], own, starts, BUILD_WIDTH)
            mates = np.where(np.tri(b - a, k=-1, dtype=bool), own @ own.T, -np.inf)
            ids = np.concatenate((ids, np.where(mates > -np.inf, np.arange(a, b), -1)), axis=1)
            sims = np.concatenate((sims, mates), axis=1)
            near = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_WIDTH]
            picked = chosen(points, np.take_along_axis(ids, near, 1), np.take_along_axis(sims, near, 1), LINKS, True)
            links[a:b, : picked.shape[1]] = picked
            _add_back_links(points, links, picked, a)
            a = b
    return layers


def _layer_sizes(ids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """An order of the nodes with the higher ones first, and the layers' sizes; heights are drawn by a hash of the id."""
    draw = mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    height = np.floor(-np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) / np.log(LINKS)).astype(int)
    order = np.lexsort((draw, -height))
    return order, [int((height >= level).sum()) for level in range(height.max() + 1)]


def _build(kind: str, frame: pd.DataFrame) -> pd.DataFrame:
    """One shard's rows -> its graph as one row."""
    frame = frame.sort_values("vec_id", kind="stable")
    ids, rows = frame["vec_id"].to_numpy(), list(frame["vector"])
    again = ids[1:] == ids[:-1]
    if again.any():  # of rows that repeat an id the least vector counts
        least: dict[int, np.ndarray] = {}
        for i, v in zip(ids.tolist(), rows, strict=True):
            if i not in least or tuple(v) < tuple(least[i]):
                least[i] = v
        ids, rows = np.array(list(least), np.int64), list(least.values())
    vectors = np.ascontiguousarray(np.stack(rows).astype(kind))
    as_bytes = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, first, node = np.unique(as_bytes, return_index=True, return_inverse=True)
    order, sizes = _layer_sizes(ids[first])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_node = np.argsort(place[node], kind="stable")  # ids stay ascending within a node
    counts = np.bincount(place[node])
    vectors = vectors[first[order]]
    layers = build_layers(_unit(vectors), sizes)
    return pd.DataFrame({
        "dim": [int(frame["dim"].iloc[0])], "shard": [int(frame["shard"].iloc[0])],
        "ids": [ids[by_node].astype("<i8").tobytes()],
        "starts": [np.concatenate(([0], np.cumsum(counts))).astype("<i8").tobytes()],
        "vectors": [vectors.tobytes()], "layers": [[x.astype("<i4").tobytes() for x in layers]],
    })


def _search_rows(kind: str, k: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a graph and a block of queries -> each query's k nearest found in that shard."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            ids, starts = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.starts, "<i8")
            vectors = np.frombuffer(row.vectors, kind).reshape(len(starts) - 1, row.dim)
            layers = [
                np.frombuffer(x, "<i4").reshape(-1, LINKS if level else 2 * LINKS).astype(np.int64)
                for level, x in enumerate(row.layers)
            ]
            points = _unit(vectors)
            out = []
            for a in range(0, len(row.query_ids), BATCH):
                own, queries = row.query_ids[a : a + BATCH], scaled(np.stack(row.queries[a : a + BATCH]))
                units = _unit(queries)
                found, _ = beam(points, layers[0], units, _descended(points, layers, units, 0), SEARCH_WIDTH)
                for query_id, query, nodes in zip(own, queries, found, strict=True):
                    nodes = nodes[nodes >= 0]
                    scores = cosines(scaled(vectors[nodes]), query)
                    # a node's smallest ids are enough: one may be the query's own
                    hits = [
                        (-score, vec_id)
                        for node, score in zip(nodes.tolist(), scores.tolist(), strict=True)
                        for vec_id in ids[starts[node] : min(starts[node + 1], starts[node] + k + 1)].tolist()
                        if vec_id != query_id
                    ]
                    out.extend((query_id, vec_id, -score) for score, vec_id in sorted(hits)[:k])
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64"})


def shard_graphs(vectors: DataFrame, kind: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(vec_id, vector, dim) -> one row per shard with its graph; a written table."""
    dims = written(vectors.groupBy("dim").count().withColumn("shards", F.ceil(F.col("count") / shard_rows)), "dims")
    n_shards = dims.agg(F.coalesce(F.sum("shards"), F.lit(1))).first()[0]
    dealt = vectors.join(broadcast_if_small(dims.select("dim", "shards")), "dim")
    dealt = dealt.select("dim", F.pmod(F.xxhash64("vec_id"), "shards").alias("shard"), "vec_id", "vector")
    dealt = dealt.repartition(2 * n_shards, "dim", "shard")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        return _build(kind, frame)

    return written(dealt.groupBy("dim", "shard").applyInPandas(build, GRAPH_SCHEMA), "graphs")


def nearest(
    vectors: DataFrame, is_query: Column, k: int = NEAREST, shard_rows: int = SHARD_ROWS, column: str = "embedding"
) -> DataFrame:
    """(vec_id, ``column``) -> (query_id, rank, vec_id, score): for each row that
    is a query the k rows of largest cosine that the graphs give, itself left
    out; nearest first, ties by the smaller vec_id.

    Every usable row is indexed.  Rows without an id, and NULL, empty or zero
    vectors or such with a NULL or non-finite component, take no part.  Vectors
    meet those of their own length.  Of rows that repeat an id (and length) the
    one with the least vector counts.  Exact copies of a vector are one node, so
    all their ids compete and ties among them are exact.  Fewer candidates than
    k: all found.  Extra columns are ignored; an empty table gives no rows.
    """
    kind = "<f4" if vectors.schema[column].dataType.simpleString() == "array<float>" else "<f8"
    vector = F.col(column) if kind == "<f4" else F.col(column).cast("array<double>")
    rows = vectors.where(usable(F.col("vec_id"), F.col(column))).select(
        F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.size(column).alias("dim"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    graphs = shard_graphs(rows.drop("asks"), kind, shard_rows)
    queries = rows.where("asks").groupBy("dim", "vec_id").agg(F.min("vector").alias("vector"))
    queries = written(queries, "queries")
    n_blocks = -(-queries.count() // QUERY_BLOCK) or 1
    blocks = queries.groupBy("dim", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).alias("block")).agg(
        F.collect_list(F.struct("vec_id", "vector")).alias("q")
    )
    blocks = blocks.select("dim", "block", F.col("q.vec_id").alias("query_ids"), F.col("q.vector").alias("queries"))
    shards = graphs.select("dim", "shard")
    parts = 2 * max(1, shards.count())  # asked for by number, so that few bytes still go to many tasks
    dealt = written(blocks, "blocks").join(shards, "dim").repartition(parts, "dim", "shard")
    met = dealt.join(graphs.repartition(parts, "dim", "shard").hint("shuffle_hash"), ["dim", "shard"]).drop("block")
    with arrow_rows(vectors.sparkSession, 1):  # a row holds a graph and a block of queries
        found = met.mapInPandas(partial(_search_rows, kind, k), "query_id long, vec_id long, score double")
        found = written(found, "found")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return written(ranked.select("query_id", "rank", "vec_id", "score"), "nearest")
