"""Approximate nearest neighbours by inner product over balanced posting lists.

The index: centroids of balanced clusters, fitted on a bounded sample; every vector is posted to its
nearest centroid's list, and a vector near a boundary to several. A search finds the
lists near a query by a graph over the centroids that every task holds in
memory, keeps those whose distance is within a ratio of the nearest's, and scores their
members. The graph is walked where that meets few of many centroids; up to DIRECT of them one matrix product is
less work. The ratio is measured on the sample so that the neighbours asked for are
covered. Lists are laid together in shards of about CHUNK members, so a query goes once to each shard it has lists in;
shards and their queries are dealt in chunks of bounded size.

Largest inner product becomes least distance with one more component: sqrt(1 - |x|^2)
for a member, zero for a query, of vectors over the greatest norm.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchlake.llm._common import checkpointed, partitions, sized
from matchlake.llm.nndescent import _matrix, usable

#: Vectors that centroids, ratio and lists are fitted on, at most about (by a hash of the id).
FIT_VECTORS = 20_000
#: Vectors of a list, about; there are at most MOST_LISTS, larger data have larger lists.
LIST, MOST_LISTS = 256, 8192
#: A vector is also posted to centroids up to this ratio farther than its nearest.
BOUNDARY, REPLICAS = 1.1, 4
#: Share of the sample's true neighbours that the searched lists must cover; measured recall on whole tables is higher (README).
COVER = 0.93
#: Neighbours of a node of the centroid graph; nodes a walk keeps.
DEGREE, BEAM = 16, 64
#: Centroids of which all distances are taken at once instead of a walk.
DIRECT = 4096
#: Members and queries of a tile; fewer members, but LEAST_CHUNK, if that gives more tasks work.
CHUNK, QUERY_CHUNK, LEAST_CHUNK = 32_768, 32_768, 4096
#: Numbers of a matrix of scores, pairs that are scored exactly at a time, and columns that a bound is taken over.
SCORES, PAIRS, STRIDE = 4 << 20, 1 << 17, 32


def augmented(v: np.ndarray, norm: float) -> np.ndarray:
    v = v / norm
    rest = np.sqrt(np.maximum(0.0, 1 - (v * v).sum(axis=1)))
    return np.concatenate((v, rest[:, None]), axis=1)


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of the nearest centre of each row."""
    half, turned = (centres * centres).sum(axis=1).astype(np.float32) / 2, centres.T.astype(np.float32)
    step = max(1, SCORES // max(1, len(centres)))
    return np.concatenate([np.zeros(0, np.int64), *((half - x[at : at + step].astype(np.float32) @ turned).argmin(axis=1) for at in range(0, len(x), step))])


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T)


def balanced_centroids(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centres of clusters none of which has more than twice its share: larger ones are halved."""
    most = max(2, 2 * len(x) // max(1, lists))
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(6):
        own = closest(x, centres)
        size = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = total[size > 0] / size[size > 0, None]
    own = closest(x, centres)
    todo, out = [np.flatnonzero(own == c) for c in range(len(centres))], []
    while todo:
        part = todo.pop()
        spread = x[part].std(axis=0) if len(part) else np.zeros(1)
        if len(part) > most and spread.max() > 0:
            axis = int(spread.argmax())
            by = part[np.argsort(x[part, axis], kind="stable")]
            todo += [by[: len(by) // 2], by[len(by) // 2 :]]
        elif len(part):
            out.append(x[part].mean(axis=0))
    return np.array(out)


class CentroidGraph:
    """A navigable graph over the centroids: each one's nearest others and some far ones."""

    def __init__(self, centres: np.ndarray, rng: np.random.Generator):
        n = len(centres)
        self.centres, self.square = centres, (centres * centres).sum(axis=1)
        if n <= DIRECT:
            return
        degree = min(DEGREE, n)
        near = np.empty((n, degree), np.int64)
        for at in range(0, n, 1024):
            near[at : at + 1024] = np.argpartition(squared(centres[at : at + 1024], centres), degree - 1, axis=1)[:, :degree]
        self.links = np.concatenate((near, rng.integers(0, n, (n, 4))), axis=1)
        self.entry = rng.permutation(n)[: max(1, min(n, 2 * int(np.sqrt(n)) + 8))]

    def search(self, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of about the nearest ``beam`` centroids of each row, nearest first."""
        n, beam = len(q), min(beam, len(self.centres))
        if len(self.centres) <= DIRECT or beam * DEGREE >= len(self.centres):
            return self._direct(q, beam)
        qq = (q * q).sum(axis=1)

        def merge(ids, distance, expanded):
            order = np.lexsort((~expanded, ids), axis=1)  # an expanded entry before its double
            ids, distance, expanded = (np.take_along_axis(x, order, axis=1) for x in (ids, distance, expanded))
            double = np.concatenate((np.zeros((n, 1), bool), ids[:, 1:] == ids[:, :-1]), axis=1)
            distance = np.where(double, np.inf, distance)
            order = np.argsort(distance, axis=1, kind="stable")[:, :beam]
            return tuple(np.take_along_axis(x, order, axis=1) for x in (ids, distance, expanded | double))

        start = squared(q, self.centres[self.entry])
        ids = np.broadcast_to(self.entry, start.shape)
        ids, distance, expanded = merge(ids, start, np.zeros(ids.shape, bool))
        for _ in range(4 * beam):
            left = ~expanded & np.isfinite(distance)
            if not left.any():
                break
            at = np.argmax(left, axis=1)  # the nearest one not yet expanded
            rows = np.arange(n)
            more = self.links[ids[rows, at]]
            found = np.maximum(0.0, qq[:, None] + self.square[more] - 2 * np.einsum("nd,nkd->nk", q, self.centres[more]))
            found = np.where(left.any(axis=1)[:, None], found, np.inf)
            expanded[rows, at] = True
            ids, distance, expanded = merge(np.concatenate((ids, more), axis=1), np.concatenate((distance, found), axis=1), np.concatenate((expanded, ~np.isfinite(found)), axis=1))
        return ids, np.sqrt(distance)

    def _direct(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of all centroids."""
        ids, distance = np.empty((len(q), beam), np.int64), np.empty((len(q), beam))
        turned, square = self.centres.T.astype(np.float32), self.square.astype(np.float32)
        step = max(1, SCORES // len(self.centres))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            away = square - 2 * (part.astype(np.float32) @ turned)
            near = np.argpartition(away, beam - 1, axis=1)[:, :beam]
            own = np.take_along_axis(away, near, axis=1)
            order = np.argsort(own, axis=1, kind="stable")
            ids[at : at + step] = np.take_along_axis(near, order, axis=1)
            distance[at : at + step] = np.sqrt(np.maximum(0.0, np.take_along_axis(own, order, axis=1) + (part * part).sum(axis=1)[:, None]))
        return ids, distance


class Index:
    """Centroids with their graph, the greatest norm, and the ratio that prunes lists."""

    def __init__(self, sample: np.ndarray, rows: int, norm: float, k: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.norm, x = norm, augmented(sample, norm)
        lists = int(min(MOST_LISTS, max(1, rows // LIST), max(1, len(x) // 4)))
        self.graph = CentroidGraph(balanced_centroids(x, lists, rng), rng)
        self.ratio, self.beam = 1.0, min(BEAM, len(self.graph.centres))
        self._fit_ratio(sample, x, k, rng)

    def postings(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): the nearest list, and others within the boundary ratio whose centroid is nearer to the vector than to any list chosen before."""
        x = augmented(v, self.norm)
        ids, distance = self.graph.search(x, min(16, self.beam))
        centres = self.graph.centres
        keep = np.zeros(ids.shape, bool)
        keep[:, 0] = True
        for j in range(1, ids.shape[1]):
            may = (distance[:, j] <= distance[:, 0] * BOUNDARY) & (keep.sum(axis=1) < REPLICAS)
            rows = np.flatnonzero(may)
            for i in range(j):
                has = keep[rows, i]
                own = rows[has]
                if len(own):
                    gap = np.sqrt(((centres[ids[own, i]] - centres[ids[own, j]]) ** 2).sum(axis=1))
                    has[has] = gap < distance[own, j]
                    rows = rows[~has]
            keep[rows, j] = True
        row, at = np.nonzero(keep)
        return row, ids[row, at]

    def lists(self, q: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) to search: within the ratio of the nearest, and more until they have ``least`` members."""
        ids, distance = self.graph.search(np.concatenate((q / self.norm, np.zeros((len(q), 1))), axis=1), self.beam)
        real = np.isfinite(distance)
        held = np.cumsum(np.where(real, sizes[ids], 0), axis=1)
        keep = real & ((distance <= distance[:, :1] * self.ratio) | (np.concatenate((np.zeros((len(q), 1)), held[:, :-1]), axis=1) < least))
        row, at = np.nonzero(keep)
        short = np.flatnonzero(held[:, -1] < least)  # then every list
        if len(short):
            rest = ~np.isin(row, short)
            every = np.arange(len(self.graph.centres))
            return np.concatenate((row[rest], np.repeat(short, len(every)))), np.concatenate((ids[row, at][rest], np.tile(every, len(short))))
        return row, ids[row, at]

    def _fit_ratio(self, sample: np.ndarray, x: np.ndarray, k: int, rng: np.random.Generator) -> None:
        """The least ratio and beam that cover COVER of the true neighbours of some sample vectors."""
        some = rng.choice(len(sample), min(400, len(sample)), replace=False)
        score = sample[some] @ sample.T
        score[np.arange(len(some)), some] = -np.inf
        take = min(k, max(1, len(sample) - 1))
        best = np.argpartition(-score, take - 1, axis=1)[:, :take]
        q = np.concatenate((sample[some] / self.norm, np.zeros((len(some), 1))), axis=1)
        row, own = self.postings(sample)
        away = np.sqrt(squared(q, self.graph.centres))
        order = np.argsort(np.argsort(away, axis=1), axis=1)
        posted = np.full((len(sample), REPLICAS), -1)
        cut = np.searchsorted(row, np.arange(len(sample)))
        posted[row, np.arange(len(row)) - cut[row]] = own
        held = posted[best]  # query, neighbour, replica
        rows = np.arange(len(some))[:, None, None]
        ratio = np.where(held >= 0, away[rows, held] / np.maximum(away.min(axis=1), 1e-12)[:, None, None], np.inf).min(axis=2)
        place = np.where(held >= 0, order[rows, held], len(self.graph.centres)).min(axis=2)
        self.ratio = max(1.0, float(np.quantile(ratio, COVER, method="higher"))) * 1.001
        self.beam = int(min(len(self.graph.centres), max(self.beam, 1.25 * np.quantile(place, 0.995, method="higher") + 16)))


def nearest(queries: np.ndarray, query_ids: np.ndarray, members: np.ndarray, ids: np.ndarray, k: int, lists: list[tuple[int, int]] = (), wanted: np.ndarray | None = None):
    """(query no, id, score) of each query's k members of largest inner product, ties to the smaller id; not itself.

    lists: (start, stop) of the members' lists; wanted (query, list): those that a query searches, null: all. Of members that
    share an id the best counts. Members come out by single precision with room for its error, and are scored in double.
    """
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    # so many members that k others stay, whatever shares an id
    take = (k + 1) * int(np.unique(ids, return_counts=True)[1].max(initial=1))
    scale = max(np.abs(members).max(initial=0.0), 1e-300)
    small = (members / scale).astype(np.float32)
    most = np.sqrt((small.astype(np.float64) ** 2).sum(axis=1).max(initial=0.0))
    step = max(1, SCORES // max(1, len(members)))
    for at in range(0, len(queries), step):
        q = queries[at : at + step]
        unit = q / np.abs(q).max(axis=1, keepdims=True)
        unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        slack = (q.shape[1] + 16) * most * 2.0**-23
        own = None if wanted is None else wanted[at : at + step]
        i, j = _above(unit.astype(np.float32), small, take, np.float32(slack), lists, own)
        if len(i) > 64 * take * len(q):  # single precision tells too little
            i, j = _above(unit, members / scale, take, 1e-13 * most, lists, own)
        exact = np.concatenate([np.empty(0), *((q[i[p : p + PAIRS]] * members[j[p : p + PAIRS]]).sum(axis=1) for p in range(0, len(i), PAIRS))])  # the same sum wherever the pair meets
        other = query_ids[at + i] != ids[j]
        i, who, exact = i[other], ids[j[other]], exact[other]
        by = np.lexsort((-exact, who, i))  # the best of an id
        by = by[np.r_[True, (i[by][1:] != i[by][:-1]) | (who[by][1:] != who[by][:-1])]] if len(by) else by
        by = by[np.lexsort((who[by], -exact[by], i[by]))]
        i, who, exact = i[by], who[by], exact[by]
        keep = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((i[keep] + at, who[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _above(q: np.ndarray, members: np.ndarray, take: int, slack: float, lists: list[tuple[int, int]], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the scores that may be among a row's ``take`` greatest; lists that a row does not want are left out."""
    if wanted is None or wanted.mean() > 0.5:
        score = q @ members.T
        for n, (lo, hi) in enumerate(lists if wanted is not None else ()):
            if not wanted[:, n].all():
                score[~wanted[:, n], lo:hi] = -np.inf
    else:
        score = np.full((len(q), len(members)), -np.inf, q.dtype)
        for n, (lo, hi) in enumerate(lists):
            rows = np.flatnonzero(wanted[:, n])
            if len(rows):
                score[rows, lo:hi] = q[rows] @ members[lo:hi].T
    # a bound below the last one taken: of the peaks of groups of columns, if they are enough
    width = score.shape[1]
    groups = width // STRIDE
    if groups > 2 * take:
        peaks = score[:, : groups * STRIDE].reshape(len(score), STRIDE, groups).max(axis=1)
        last = -np.partition(-peaks, take - 1, axis=1)[:, take - 1]
    elif width > take:
        last = -np.partition(-score, take - 1, axis=1)[:, take - 1]
    else:
        last = np.full(len(score), -np.inf, score.dtype)
    # a row whose bound is -inf takes all it wants
    return np.nonzero((score >= (last - slack)[:, None]) & (score > -np.inf))


def fit(vectors: DataFrame, rows: int, norm: float, k: int) -> Index:
    """``vectors`` (id, v) of one length; a hash sample of about FIT_VECTORS rows reaches the driver."""
    share = min(1.0, FIT_VECTORS / max(1, rows))
    sample = vectors.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) < share * (1 << 20)).select("id", "v").limit(2 * FIT_VECTORS).collect()
    if not sample:
        sample = vectors.select("id", "v").limit(1000).collect()
    sample.sort(key=lambda r: r["id"])
    return Index(np.array([r["v"] for r in sample], np.float64), rows, norm, k)


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query``, its ``k`` nearest others.

    Nearness is the inner product in double precision, ties to the smaller id; fewer
    candidates: all of them. Vectors that are null, zero or hold null or
    non-finite components take no part, nor do rows without an id, and vectors of
    different lengths do not meet. Rows that share an id are one candidate (the one that scores
    best). Every vector is indexed. Other columns are ignored.
    """
    spark = vectors.sparkSession
    marked = usable(vectors.withColumn("__query", F.coalesce(is_query, F.lit(False))), id_col, vector_col, "__query")
    given = vectors.schema[vector_col].dataType.simpleString()
    kept = F.col("v").cast(given if given == "array<float>" else "array<double>")  # not wider than it came
    rows = checkpointed(marked.select("id", F.col("label").alias("query"), kept.alias("v"), F.size("v").alias("dim")))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    per = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("norm")).collect()
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in sorted(per, key=lambda r: r["dim"]):
        out = out.union(_search(rows.where(F.col("dim") == r["dim"]), r["n"], r["norm"], k))
    return out


def _search(rows: DataFrame, n: int, norm: float, k: int) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(fit(rows, n, norm, k))  # at most MOST_LISTS centroids, about

    def post(batches):
        for pdf in batches:
            if len(pdf):
                row, own = shared.value.postings(_matrix(pdf["v"]))
                yield pd.DataFrame({"list": own, "id": pdf["id"].to_numpy()[row], "v": pdf["v"].to_numpy()[row]})

    kind = dict(rows.dtypes)["v"]
    posted = checkpointed(rows.select("id", "v").mapInPandas(post, f"list long, id long, v {kind}"))
    sizes = posted.groupBy("list").agg(F.count("*").alias("n"))
    held = {r["list"]: r["n"] for r in sizes.collect()}  # one number a list
    counts = np.array([held.get(i, 0) for i in range(max(held) + 1)]) if held else np.zeros(1, np.int64)
    chunk = min(CHUNK, max(LEAST_CHUNK, n // partitions(spark)))
    shard_of = (np.cumsum(counts) - counts) // chunk
    first = np.searchsorted(shard_of, np.arange(shard_of[-1] + 1))  # a shard's first list
    counts, shard_of, first = (spark.sparkContext.broadcast(x) for x in (counts, shard_of, first))

    def look(batches):
        for pdf in batches:
            if len(pdf):
                index = shared.value
                sizes = np.zeros(len(index.graph.centres), np.int64)
                sizes[: len(counts.value)] = counts.value
                row, own = index.lists(_matrix(pdf["v"]), sizes, 2 * k + 1)
                there = sizes[own] > 0
                row, own = row[there], own[there]
                shard = shard_of.value[own]
                by = np.lexsort((own, shard, row))
                row, own, shard = row[by], own[by], shard[by]
                cuts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])]) if len(row) else np.empty(0, np.int64)
                asks = [x.astype(np.int32) for x in np.split(own, cuts[1:])] if len(cuts) else []
                yield pd.DataFrame({"shard": shard[cuts], "id": pdf["id"].to_numpy()[row[cuts]], "v": pdf["v"].to_numpy()[row[cuts]], "asks": asks})

    asked = checkpointed(rows.where("query").select("id", "v").mapInPandas(look, f"shard long, id long, v {kind}, asks array<int>"))
    shards = spark.createDataFrame([(i, int(x)) for i, x in enumerate(shard_of.value)], "list long, shard long")
    posted = posted.join(F.broadcast(shards), "list")  # at most MOST_LISTS rows, about
    # a list of more than a chunk makes a large shard
    tiles = posted.groupBy("shard").agg(F.ceil(F.count("*") / (2 * chunk)).cast("int").alias("vc")).join(asked.groupBy("shard").agg(F.ceil(F.count("*") / QUERY_CHUNK).cast("int").alias("qc")), "shard")
    tiles = checkpointed(tiles)
    work = tiles.agg(F.sum(F.col("vc") * F.col("qc"))).first()[0] or 0
    tiles = sized(tiles, 32)
    each = lambda side, own, other: (
        side.join(tiles, "shard").withColumn("mine", F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    )
    members = each(posted, "vc", "qc").select("shard", F.col("mine").alias("v_no"), F.col("theirs").alias("q_no"), F.array(F.col("list").cast("int")).alias("asks"), F.lit(False).alias("query"), "id", "v")
    queries = each(asked, "qc", "vc").select("shard", F.col("theirs").alias("v_no"), F.col("mine").alias("q_no"), "asks", F.lit(True).alias("query"), "id", "v")

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["query"].to_numpy(bool)
        if asks.all() or not asks.any():
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        low = first.value[pdf["shard"].iloc[0]]
        lists = np.concatenate(pdf["asks"][~asks].to_numpy()) - low
        by = np.argsort(lists, kind="stable")
        lists = lists[by]
        cuts = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
        wants = pdf["asks"][asks].to_numpy()
        wanted = np.zeros((len(wants), len(shard_of.value) - low), bool)
        wanted[np.repeat(np.arange(len(wants)), [len(x) for x in wants]), np.concatenate(wants) - low] = True
        who, v = pdf["id"].to_numpy(), pdf["v"]
        i, j, s = nearest(_matrix(v[asks]), who[asks], _matrix(v[~asks])[by], who[~asks][by], k, list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(lists)])), wanted[:, lists[cuts]])
        return pd.DataFrame({"query_id": who[asks][i], "vec_id": j, "score": s})

    found = members.union(queries).repartition(max(partitions(spark, 2 * n, 50_000), 2 * work), "shard", "v_no", "q_no").groupBy("shard", "v_no", "q_no").applyInPandas(score, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
