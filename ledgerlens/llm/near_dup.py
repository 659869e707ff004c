"""Near-duplicate groups by a MinHash LSH forest (operator 4).

Every distinct shingle set gets one MinHash signature.  Each tree of the
forest is a sorted order of those signatures (tree ``t`` starts at its own
``BASE_DEPTH`` values and goes on through the others), held as one table
sorted by (tree, key).  Candidates are neighbours in an order whose longest
common prefix reaches the base depth.  The nearest neighbours are tried first
and their links contracted; in a crowded region (rows with a common base
prefix) these share longer prefixes, so the depth adapts to each region.
Regions that still hold several components are then searched whole, many small
ones in a task, large ones in slices: the rows outside the region's largest
component against all its rows.  So every pair of one region is in one
component or was compared.  All links are confirmed on full shingle sets, which
are written once in hash buckets of the id, so that joins move only the pairs
to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import NO_ID, arrow_rows, as_bytes, bucketed, chunks, id_and_bytes, id_back, mixed, shingle_sets, written
from ledgerlens.llm.graph import connected_components

TREES = 20
BASE_DEPTH = 4
KEY_DEPTH = 12
BLOCK = 8192
SMALL_REGION = 32
SLICE_SHINGLES = 1_000_000
#: Shingles of a bucket of the table of sets, and the most buckets (larger tables: larger buckets).
BUCKET_SHINGLES = 1_000_000
MOST_BUCKETS = 50_000
BATCH_ROWS = 500
_VALUES = TREES * BASE_DEPTH
_rng = np.random.default_rng(811)
_FACTORS = _rng.integers(0, 1 << 63, _VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, _VALUES, dtype=np.uint64)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit MinHash values, one row per non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), _VALUES), ">u2")
    for k in range(_VALUES):
        least = np.minimum.reduceat(flat * _FACTORS[k] + _SHIFTS[k], starts)
        out[:, k] = mixed(least) & np.uint64(0xFFFF)
    return out


def _fingerprint_rows(width: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in chunks(frames):
        sets = shingle_sets([as_bytes(t) for t in frame["text"]], width)
        full = [i for i, s in enumerate(sets) if len(s)]
        first, second = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        signature: list[bytes | None] = [None] * len(sets)
        if full:
            rows = _signatures([sets[i] for i in full])
            for i, row in zip(full, rows, strict=True):
                first[i] = mixed(sets[i]).sum(dtype=np.uint64).view(np.int64)
                second[i] = mixed(sets[i] ^ np.uint64(0x5BD1E995A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)
                signature[i] = row.tobytes()
        yield pd.DataFrame(
            {
                "doc_id": frame["doc_id"],
                "n_shingles": np.array([len(s) for s in sets], np.int64),
                "f1": first,
                "f2": second,
                "signature": signature,
            }
        )


def _set_rows(width: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in chunks(frames):
        sets = shingle_sets([as_bytes(t) for t in frame["text"]], width)
        yield pd.DataFrame({"id": frame["doc_id"], "shingles": [s.tobytes() for s in sets]})


def _depths(key: list[bytes], tree: np.ndarray, step: int) -> np.ndarray:
    """Common prefix of row i and row i + step, in signature values."""
    values = np.frombuffer(b"".join(key), ">u2").reshape(len(key), KEY_DEPTH)
    same = values[step:] == values[:-step]
    depth = np.cumprod(same, axis=1).sum(axis=1)
    return np.where(tree[step:] == tree[:-step], depth, 0)


def _adjacent(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows of one block of the order that share the base prefix with a
    neighbour, and the next row's id if it is one."""
    frame = frame.sort_values("pos").reset_index(drop=True)
    own = (frame["pos"] // BLOCK == frame["block"]).to_numpy()
    near = np.zeros(len(frame), bool)
    if len(frame) > 1:
        near[:-1] = _depths(list(frame["key"]), frame["tree"].to_numpy(), 1) >= BASE_DEPTH
    member = near | np.concatenate(([False], near[:-1]))
    frame["next_id"] = frame["id"].shift(-1, fill_value=0).where(near, frame["id"])
    frame["next_n"] = frame["n"].shift(-1, fill_value=0)
    return frame.loc[own & member, ["pos", "tree", "key", "id", "n", "next_id", "next_n"]]


def _near_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the order that may share the base prefix with a neighbour: those
    that do with the row before or behind in their batch, and those whose
    neighbour is not in it."""
    for frame in frames:
        if len(frame) > 1:
            pos = frame["pos"].to_numpy()
            shared = _depths(list(frame["key"]), frame["tree"].to_numpy(), 1) >= BASE_DEPTH
            shared |= np.diff(pos) != 1
            frame = frame[np.concatenate(([True], shared)) | np.concatenate((shared, [True]))]
        yield frame


def _uniting_links(
    percent: int, probes: tuple[np.ndarray, ...], rows: tuple[np.ndarray, ...]
) -> list[tuple[int, int]]:
    """Links between probes and rows, both (ids, components, sets as bytes), that
    join their components: each link unites two that no earlier one did."""
    links: list[tuple[int, int]] = []
    joined: dict[int, int] = {}

    def root(component: int) -> int:
        while component in joined:
            component = joined[component]
        return component

    ids, group, raw_sets = rows
    if not len(ids):
        return links
    sets = [np.frombuffer(x, np.uint64) for x in raw_sets]
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    for number, component, raw in zip(*probes, strict=True):
        own = np.frombuffer(raw, np.uint64)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        flag = np.zeros(len(known), np.int64)
        flag[at[known[at] == own]] = 1
        common = np.add.reduceat(flag[flat], starts)
        near = (100 * common >= percent * (len(own) + sizes - common)) & (group != component)
        near = np.flatnonzero(near)
        for i in near[np.unique(group[near], return_index=True)[1]]:
            a, b = root(int(component)), root(int(group[i]))
            if a != b:
                joined[max(a, b)] = min(a, b)
                links.append((int(number), int(ids[i])))
    return links


def _columns(frame: pd.DataFrame, taken: np.ndarray | slice) -> tuple[np.ndarray, ...]:
    return tuple(frame[c].to_numpy()[taken] for c in ("id", "component", "shingles"))


def _slice_links(percent: int, frame: pd.DataFrame) -> pd.DataFrame:
    """Links between a slice's probes and its rows."""
    probe = frame["probe"].to_numpy(bool)
    links = _uniting_links(percent, _columns(frame, probe), _columns(frame, ~probe))
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def _region_links(percent: int, frame: pd.DataFrame) -> pd.DataFrame:
    """Links of whole regions: the rows outside a region's largest component
    against all its rows."""
    frame = frame.sort_values(["tree", "prefix"], ignore_index=True)
    minor, rows = frame["minor"].to_numpy(bool), _columns(frame, slice(None))
    first = np.flatnonzero(~frame.duplicated(["tree", "prefix"]).to_numpy())
    links: list[tuple[int, int]] = []
    for start, stop in zip(first, [*first[1:], len(frame)], strict=True):
        region = [column[start:stop] for column in rows]
        links += _uniting_links(percent, [column[minor[start:stop]] for column in region], region)
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def _confirm(percent: int, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        kept = []
        for x, y in zip(frame["sa"], frame["sb"], strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            kept.append(100 * common >= percent * (len(x) + len(y) - common))
        yield frame.loc[np.array(kept, bool), ["a", "b"]]


def _in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows by position block, with the first row of a block also in the block
    before and the last row also in the one behind."""
    block = F.floor(F.col("pos") / size)
    offset = F.pmod("pos", F.lit(size))
    copies = F.array(
        block,
        F.when((offset == 0) & (block > 0), block - 1),
        F.when(offset == size - 1, block + 1),
    )
    return rows.withColumn("block", F.explode(F.array_compact(copies)))


def _ordered(signed: DataFrame) -> DataFrame:
    """All trees' rows with their position in the one order by (tree, key, id).

    Positions are read off the written, sorted files: the partition number and
    the row's place in it, plus the count of rows in earlier partitions (one
    number per partition reaches the driver).
    """
    rows = signed.select(
        "id", "n", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    ).selectExpr(
        "id", "n", "tree",
        f"substring(concat(signature, signature), {2 * BASE_DEPTH} * tree + 1, {2 * KEY_DEPTH}) AS key",
    )
    order = written(
        rows.orderBy("tree", "key", "id").withColumn("place", F.monotonically_increasing_id()), "forest"
    )
    parts = order.groupBy(F.shiftright("place", 33).alias("part")).count().orderBy("part").collect()
    starts, total = [], 0
    for part in parts:
        starts.append((part["part"], total))
        total += part["count"]
    start = order.sparkSession.createDataFrame(starts, "part long, start long")
    return (
        order.withColumn("part", F.shiftright("place", 33))
        .join(F.broadcast(start), "part")
        .withColumn("pos", F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1))
        .select("pos", "tree", "key", "id", "n")
    )


def _links(docs: DataFrame, signed: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links between representatives that connect every group."""

    def region_links(frame: pd.DataFrame) -> pd.DataFrame:
        return _region_links(percent, frame)

    def slice_links(frame: pd.DataFrame) -> pd.DataFrame:
        return _slice_links(percent, frame)

    near_rows = _ordered(signed).mapInPandas(_near_rows, "pos long, tree int, key binary, id long, n long")
    blocks = _in_blocks(near_rows, BLOCK)
    members = written(
        blocks.groupBy("block").applyInPandas(
            _adjacent, "pos long, tree int, key binary, id long, n long, next_id long, next_n long"
        ),
        "members",
    )
    near = (
        members.where("id <> next_id")
        .where(100 * F.least("n", "next_n") >= percent * F.greatest("n", "next_n"))
        .groupBy(F.least("id", "next_id").alias("a"), F.greatest("id", "next_id").alias("b"))
        .agg(F.count(F.lit(1)).alias("trees"))
    )
    near = written(near, "near")
    ends = near.select(F.col("a").alias("id"), F.struct("trees", "a", "b").alias("p")).union(
        near.select(F.col("b").alias("id"), F.struct("trees", "a", "b").alias("p"))
    )
    best = ends.groupBy("id").agg(F.max("p").alias("p")).select("p.a", "p.b").distinct()
    best = written(best, "best")

    wanted = written(members.select("id", "n").distinct(), "wanted")
    shingles = wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    wanted = wanted.select("id")
    texts = id_and_bytes(docs)
    sets = texts.join(wanted, texts["doc_id"] == wanted["id"], "left_semi").mapInPandas(
        partial(_set_rows, width), "id long, shingles binary"
    )
    sets = bucketed(sets, "sets", "id", min(MOST_BUCKETS, 1 + shingles // BUCKET_SHINGLES))

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
        full = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
        return written(full.mapInPandas(partial(_confirm, percent), "a long, b long"), "links")

    groups = connected_components(confirmed(best))
    more = _best_per_component(near.join(best, ["a", "b"], "left_anti"), groups)
    groups = connected_components(_stars(groups).union(confirmed(more)))
    rows = members.select("pos", "tree", "id", "n", F.substring("key", 1, 2 * BASE_DEPTH).alias("prefix"))
    rows = written(rows.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")
    same = ["tree", "prefix"]
    regions = (
        rows.groupBy(*same, "component")
        .agg(F.count(F.lit(1)).alias("size"), F.min("pos").alias("start"), F.max("n").alias("n"))
        .groupBy(*same)
        .agg(
            F.sum("size").alias("rows"),
            F.max("n").alias("widest"),
            F.count(F.lit(1)).alias("components"),
            F.min("start").alias("start"),
            F.max(F.struct("size", "component")).alias("main"),
        )
        .where("components > 1")
    )
    regions = written(regions, "regions")
    minor = (F.col("component") != F.col("main.component")).alias("minor")
    small = rows.join(regions.where(F.col("rows") <= SMALL_REGION), same).select(*same, "id", "n", "component", minor)
    small = written(small, "small")
    tasks = 1 + small.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // SLICE_SHINGLES
    dealt = small.drop("n").withColumn("task", F.pmod(F.xxhash64(*same), F.lit(tasks)))
    links = dealt.join(sets, "id").groupBy("task").applyInPandas(region_links, "a long, b long")
    links = _stars(groups).union(written(links.distinct(), "links"))

    per_slice = F.greatest(F.floor(SLICE_SHINGLES / F.col("widest")), F.lit(16))
    slices, probe_slices = F.ceil(F.col("rows") / per_slice), F.ceil((F.col("rows") - F.col("main.size")) / per_slice)
    large = rows.join(regions.where(F.col("rows") > SMALL_REGION), same)
    large = large.select(
        *same, "pos", "start", "id", "component", minor,
        per_slice.alias("per_slice"), slices.alias("slices"), probe_slices.alias("probe_slices"),
    )
    plain = large.withColumn("s", F.floor((F.col("pos") - F.col("start")) / F.col("per_slice"))).withColumn(
        "p", F.explode(F.sequence(F.lit(0), F.col("probe_slices") - 1))
    )
    probes = large.where("minor").withColumn("s", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    probes = probes.withColumn("p", F.pmod(F.xxhash64("id"), F.col("probe_slices")))
    columns = [*same, F.col("s").cast("long").alias("s"), F.col("p").cast("long").alias("p"), "id", "component"]
    both = plain.select(*columns, F.lit(False).alias("probe")).union(probes.select(*columns, F.lit(True)))
    found = (
        both.join(sets, "id")
        .groupBy(*same, "s", "p")
        .applyInPandas(slice_links, "a long, b long")
    )
    return links.union(written(found.distinct(), "links"))


def _stars(groups: DataFrame) -> DataFrame:
    return groups.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))


def _best_per_component(near: DataFrame, groups: DataFrame) -> DataFrame:
    """Of untried neighbours (a, b, trees), each component's pair into another
    one that is adjacent in most trees."""
    left = groups.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    right = groups.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    across = near.join(left, "a", "left").join(right, "b", "left")
    across = across.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")
    pair = F.struct("trees", "a", "b").alias("p")
    ends = across.select(pair, F.explode(F.array("ca", "cb")).alias("c"))
    return ends.groupBy("c").agg(F.max("p").alias("p")).select("p.a", "p.b").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Documents -> (doc_id, n_shingles, component_id, kept).

    Two documents are linked when 100 * |intersection| >= percent * |union| of
    their distinct ``width``-word shingles (A-Z lower-cased; fewer words: the
    whole sequence as one shingle).  ``component_id`` is the smallest doc_id
    reachable over links, ``kept`` marks that document.

    Empty or NULL texts have an empty set, link with nothing and are kept.
    Rows with a NULL doc_id are counted, link with nothing, have a NULL
    component_id and are kept.  Rows that repeat a doc_id are one document and
    all appear.  Extra columns are ignored.  An empty table gives no rows.
    """
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return _classes(docs, width, percent)


def _classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    prints = written(
        id_and_bytes(docs).mapInPandas(
            partial(_fingerprint_rows, width),
            "doc_id long, n_shingles long, f1 long, f2 long, signature binary",
        ),
        "prints",
    )
    same = ["n_shingles", "f1", "f2"]
    usable = prints.where((F.col("doc_id") != NO_ID) & (F.col("n_shingles") > 0))
    classes = written(
        usable.groupBy(*same).agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")), "classes"
    )
    links = _links(docs, classes.select("id", F.col("n_shingles").alias("n"), "signature"), width, percent)
    # a doc_id that is repeated with different texts ties its classes together
    repeated = usable.groupBy("doc_id").agg(
        F.count_distinct(*same).alias("sets")
    ).where("sets > 1")
    ties = (
        usable.join(repeated, "doc_id", "left_semi")
        .join(classes.select(*same, "id"), same)
        .select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    )
    groups = connected_components(links.union(ties))
    labels = written(
        classes.join(groups, "id", "left").select(*same, F.coalesce("component", "id").alias("component_id")), "labels"
    )
    component = F.coalesce("component_id", id_back(F.col("doc_id")))
    return (
        prints.select(F.when(F.col("doc_id") != NO_ID, F.col("n_shingles")).alias("own_n"), "doc_id", *same)
        .join(labels.withColumnRenamed("n_shingles", "own_n"), ["own_n", "f1", "f2"], "left")
        .select(
            id_back(F.col("doc_id")).alias("doc_id"),
            "n_shingles",
            component.alias("component_id"),
            F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )
