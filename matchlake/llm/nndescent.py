"""Embedding near-duplicates by NN-descent.

Each distinct vector keeps a list of its nearest neighbours in its label. The lists start from the leaves
of random-hyperplane trees, whose number follows from the recall asked for and the depth
that keeps leaves small, and are refined by neighbours-of-neighbours joins until a round
adds nothing. A list that is full of neighbours over the threshold is saturated and
grows until its last one falls below, so no link is cut off. A brute-force audit of some
vectors measures recall; while it is short, more trees are added. The links are the
list edges over the threshold.

Equal vectors are one node with a count. Leaves and blocks are dealt in tiles of bounded
size, so a family of near copies is spread over tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm._common import checkpointed, connected_components, partitions, sized

THRESHOLD = 0.98
#: Neighbours a list begins with.
NEIGHBOURS = 10
#: Vectors of a leaf, about, and of a tile of a larger leaf at most.
LEAF, TILE = 256, 1024
#: Share of links just over the threshold that the first trees find.
RECALL = 0.999
#: Vectors that the audit compares with all others of their label: so many that have links, and so many of all.
AUDIT = 64
#: Times that trees are doubled while recall is short; then labels are compared exactly, in tiles.
MORE_TREES = 3


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """(id, label, v): rows with an id and a vector that is not zero and all finite, in double precision."""
    v = F.col(vector_col).cast("array<double>")
    label = F.col(label_col) if label_col else F.lit(0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), v.alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices of unit vectors, in double precision."""
    return a @ b.T


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def trees_for(size: int, threshold: float = THRESHOLD, recall: float = RECALL, leaf: int = LEAF) -> tuple[int, int]:
    """(depth, trees): a pair at the threshold's angle shares a leaf of some tree with probability ``recall``."""
    depth = max(0, math.ceil(math.log2(max(1, size) / leaf)))
    together = (1 - math.acos(min(1.0, threshold)) / math.pi) ** depth
    return depth, 1 if together >= recall else math.ceil(math.log(1 - recall) / math.log(1 - together))


def lists_in(ids: np.ndarray, similar: np.ndarray, others: np.ndarray, k: int, threshold: float):
    """(a, b, s, r): each row's neighbour list, the k nearest, enlarged while the last is still over the threshold.

    r is the neighbour's place in the list.
    """
    a, b, s, r = [], [], [], []
    take = min(k, similar.shape[1])
    while True:
        part = np.argpartition(-similar, take - 1, axis=1)[:, :take] if take < similar.shape[1] else np.broadcast_to(np.arange(similar.shape[1]), similar.shape)
        value = np.take_along_axis(similar, part, axis=1)
        full = take < similar.shape[1]
        saturated = full & (value.min(axis=1) >= threshold) if take else np.zeros(len(ids), bool)
        done = ~saturated
        i, j = np.nonzero(done[:, None] & (value > -2))
        a.append(ids[i])
        b.append(others[part[i, j]])
        s.append(value[i, j])
        r.append(np.argsort(np.argsort(-value, axis=1, kind="stable"), axis=1)[i, j])
        if not saturated.any():
            return np.concatenate(a), np.concatenate(b), np.concatenate(s), np.concatenate(r)
        ids, similar = ids[saturated], similar[saturated]
        take = min(2 * take, similar.shape[1])


def _tile_lists(keyed: DataFrame, threshold: float, k: int) -> DataFrame:
    """Neighbour lists (a, b, s, r) within each key of ``keyed`` (key, id, v); a larger key is compared tile by tile."""
    spark = keyed.sparkSession
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("tiles >= 1")
    rows = keyed.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    # tile i meets tiles i, i+1, .., tiles-1: it is at home with itself and later ones, a visitor to earlier ones
    rows = rows.withColumn("pair", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least("tile", o).alias("x"), F.greatest("tile", o).alias("y")))))
    rows = rows.select("key", "pair.x", "pair.y", F.when(F.col("tile") == F.col("pair.x"), 0).otherwise(1).alias("side"), "id", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        v, ids, side = unit(_matrix(pdf["v"])), pdf["id"].to_numpy(), pdf["side"].to_numpy()
        left = np.flatnonzero(side == 0)
        right = left if pdf["x"].iat[0] == pdf["y"].iat[0] else np.flatnonzero(side == 1)
        parts = []
        if len(left) and len(right):
            similar = cosine(v[left], v[right])
            if right is left:
                np.fill_diagonal(similar, -9)
                parts.append(lists_in(ids[left], similar, ids[right], k, threshold))
            else:
                parts += [lists_in(ids[left], similar, ids[right], k, threshold), lists_in(ids[right], similar.T, ids[left], k, threshold)]
        a, b, s, r = (np.concatenate(x) for x in zip(*parts)) if parts else ([], [], [], [])
        return pd.DataFrame({"a": np.asarray(a, np.int64), "b": np.asarray(b, np.int64), "s": np.asarray(s, np.float64), "r": np.asarray(r, np.int64)})

    n = partitions(spark)
    return rows.repartition(n, "key", "x", "y").groupBy("key", "x", "y").applyInPandas(compare, "a long, b long, s double, r long")


def _trees(nodes: DataFrame, first: int, count: int, depths: dict, dim: int, seed: int = 17) -> DataFrame:
    """(key, id, v): each vector once for each tree, keyed by label, tree and leaf."""
    deepest = max(depths.values(), default=0)
    planes = np.random.default_rng(seed).standard_normal((first + count, max(1, deepest), dim))[first:]
    shared = nodes.sparkSession.sparkContext.broadcast((planes, depths))  # trees x depth x dimensions

    def leaves(batches):
        planes, depths = shared.value
        for pdf in batches:
            if not len(pdf):
                continue
            v = unit(_matrix(pdf["v"]))
            depth = pdf["label"].map(lambda x: depths.get(x, 0)).to_numpy()
            for t in range(count):
                code = np.zeros(len(pdf), np.int64)
                for level in range(planes.shape[1]):
                    code = np.where(level < depth, code * 2 + (v @ planes[t, level] > 0), code)
                yield pd.DataFrame({"key": [f"{lab}/{first + t}/{c}" for lab, c in zip(pdf["label"], code)], "id": pdf["id"].to_numpy(), "v": pdf["v"]})

    return nodes.mapInPandas(leaves, "key string, id long, v array<double>")


def _refined(lists: DataFrame, nodes: DataFrame, fresh: DataFrame, floor: float, k: int) -> DataFrame:
    """New (a, b, s, r) from neighbours of neighbours with at least one fresh edge, both over ``floor``.

    Only the first ``k`` places of a list are joined, so a family of m near copies gives
    about m k^2 pairs and not m^3. Two vectors within the threshold's angle of a third are at most twice that angle
    apart, so a middle vector that could tell of a link is over the floor.
    """
    near, new = (e.where((F.col("s") >= floor) & (F.col("r") < k)) for e in (lists, fresh))
    both = near.select(F.col("a").alias("m"), F.col("b").alias("z")).union(near.select(F.col("b").alias("m"), F.col("a").alias("z"))).distinct()
    some = new.select(F.col("a").alias("m"), F.col("b").alias("y")).union(new.select(F.col("b").alias("m"), F.col("a").alias("y"))).distinct()
    pairs = some.join(both, "m").where("y != z").select(F.least("y", "z").alias("a"), F.greatest("y", "z").alias("b")).distinct()
    known = lists.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(known, ["a", "b"], "left_anti")
    return _scored(pairs, nodes)


def _scored(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    left, right = nodes.select(F.col("id").alias("a"), F.col("v").alias("x")), nodes.select(F.col("id").alias("b"), F.col("v").alias("y"))

    def score(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "s": (unit(_matrix(pdf["x"])) * unit(_matrix(pdf["y"]))).sum(axis=1), "r": 0})

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(score, "a long, b long, s double, r long")


def _audit(nodes: DataFrame, links: DataFrame, count: int, threshold: float) -> float:
    """Share of the true links of some vectors, half of them such as have links, that ``links`` has."""
    any_of = lambda x: x.orderBy(F.xxhash64("id", F.lit("audit")), "id").limit(AUDIT)
    ends = any_of(links.select(F.col("a").alias("id")).union(links.select("b")).distinct())
    some = any_of(nodes).select("id", "label", "v").union(nodes.join(F.broadcast(ends), "id").select("id", "label", "v")).distinct().collect()
    if not some:
        return 1.0
    v, ids, labels = unit(np.array([r["v"] for r in some])), np.array([r["id"] for r in some]), [r["label"] for r in some]
    shared = nodes.sparkSession.sparkContext.broadcast((v, ids, labels))  # AUDIT vectors

    def true(batches):
        v, ids, labels = shared.value
        for pdf in batches:
            if len(pdf):
                similar = cosine(v, unit(_matrix(pdf["v"]))) >= threshold
                same = np.array([[x == y for y in pdf["label"]] for x in labels]) & (ids[:, None] != pdf["id"].to_numpy()[None, :])
                i, j = np.nonzero(similar & same)
                yield pd.DataFrame({"a": ids[i], "b": pdf["id"].to_numpy()[j]})

    wanted = nodes.mapInPandas(true, "a long, b long")
    wanted = wanted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = wanted.join(links.select("a", "b", F.lit(1).alias("have")), ["a", "b"], "left").agg(F.count("*"), F.count("have")).first()
    return found[1] / found[0] if found[0] else 1.0


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors link if their labels are equal and not null and their cosine is at least
    ``threshold``. n_links counts the other vectors linked directly, copies included;
    component_id is the smallest id reachable, kept tells whether it is the vector's own.
    Vectors that are null, zero, of another length than most, or hold null or non-finite
    components link with nothing, and so do rows without an id. Rows that repeat an
    id and vector are one vector. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, label_col).dropDuplicates(["id", "label", "v"])
    # vectors of different lengths cannot be compared: the length is part of the label
    rows = rows.withColumn("label", F.concat_ws(":", F.col("label").cast("string"), F.size("v").cast("string")))
    copies = checkpointed(rows.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    nodes = copies.select(F.col("rep").alias("id"), "label", "v", "copies")
    per = {r["label"]: r["n"] for r in nodes.groupBy("label").agg(F.count("*").alias("n")).collect()}
    empty = spark.createDataFrame([], "a long, b long, s double, r long")
    links, trees, depths = empty, 0, {}
    for dim in sorted({int(x.rsplit(":", 1)[1]) for x in per}):
        own = {x: n for x, n in per.items() if x.endswith(f":{dim}")}
        some = nodes.where(F.size("v") == dim)
        depths = {x: trees_for(n, threshold)[0] for x, n in own.items()}
        trees = max(trees_for(n, threshold)[1] for n in own.values())
        links = links.union(_links(some, depths, trees, dim, threshold, neighbours))
    links = checkpointed(links)
    counted = nodes.select("id", "copies")
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).union(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    degree = both.join(counted.select(F.col("id").alias("other"), "copies"), "other").groupBy("id").agg(F.sum("copies").alias("more"))
    groups = connected_components(links)
    of = counted.join(degree, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    of = of.select(F.col("id").alias("rep"), (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("component"))
    members = rows.select("id", "label", "v").join(copies.select("label", "v", "rep"), ["label", "v"]).join(of, "rep").select(F.col("id").alias("__id"), "n", "component")
    whole = vectors.select(F.col(id_col).cast("long").alias("id"))
    return whole.join(members.dropDuplicates(["__id"]), F.col("id") == F.col("__id"), "left").select(
        "id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"), (F.coalesce("component", "id") == F.col("id")).alias("kept")
    )


def _links(nodes: DataFrame, depths: dict, trees: int, dim: int, threshold: float, k: int) -> DataFrame:
    """Links (a, b, s), a < b, of vectors of one length: start, descend, audit, and again if recall is short."""
    floor = math.cos(min(math.pi / 2, 2 * math.acos(min(1.0, threshold))))
    ordered = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "s", "r").groupBy("a", "b").agg(F.max("s").alias("s"), F.min("r").alias("r"))
    lists = checkpointed(ordered(_tile_lists(_trees(nodes, 0, trees, depths, dim), threshold, k).where(F.col("s") >= floor)))
    for again in range(MORE_TREES + 1):
        fresh = lists
        while True:
            more = checkpointed(ordered(_refined(lists, nodes, fresh, floor, k)).where(F.col("s") >= floor))
            if not more.where(F.col("s") >= threshold).limit(1).count():
                break
            lists, fresh = checkpointed(lists.union(more)), more
        links = lists.where(F.col("s") >= threshold)
        if _audit(nodes, links, trees, threshold) >= RECALL:
            return links
        if again == MORE_TREES:
            exact = nodes.select(F.col("label").alias("key"), "id", "v")
            return ordered(_tile_lists(exact, threshold, k).where(F.col("s") >= threshold))
        more = _tile_lists(_trees(nodes, trees, trees, depths, dim), threshold, k).where(F.col("s") >= floor)
        lists, trees = checkpointed(ordered(lists.union(more))), 2 * trees
