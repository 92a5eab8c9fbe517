"""Retrieval by cosine: many queries against a gallery, in tiles, with views and models fused."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a tile's two sides; a task holds one tile.
TILE = 4096


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_entities(queries: DataFrame, gallery: DataFrame, k: int | None = None, digits: int = 6) -> DataFrame:
    """(query_id, entity, item, score): each query's best ``k`` entities by their best item.

    queries (query_id, v), gallery (entity, item, v). An item with the query's id does
    not count. Scores are rounded; ties go to the smaller item and entity. Both sides are dealt
    into tiles of at most TILE rows, each pair of tiles is one matrix product, and only the tile's
    best k entities a query leave it, so nothing is broadcast and memory is bounded.
    Work is queries times gallery: exact search.
    """
    # one number a side: how many tiles
    nq, ng = (max(1, -(-df.count() // TILE)) for df in (queries, gallery))
    tile = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = queries.select(F.col("query_id").alias("id"), F.col("v").cast("array<double>").alias("v")).withColumn("qt", tile(nq)).withColumn("gt", F.explode(F.sequence(F.lit(0), F.lit(ng - 1))))
    g = gallery.select(F.col("item").alias("id"), "entity", F.col("v").cast("array<double>").alias("v")).withColumn("gt", tile(ng)).withColumn("qt", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "entity", "item", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.empty(0, float if c == "score" else np.int64) for c in columns})
        right = right.sort_values(["entity", "id"])
        entity, item = right["entity"].to_numpy(), right["id"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, entity[1:] != entity[:-1]])
        names = entity[cuts]
        vectors, out = np.stack(right["v"].to_numpy()), []
        for part in range(0, len(left), 256):
            own = left.iloc[part : part + 256]
            ids = own["id"].to_numpy()
            s = np.round(np.stack(own["v"].to_numpy()) @ vectors.T, digits)
            s[ids[:, None] == item[None, :]] = -np.inf
            best = np.maximum.reduceat(s, cuts, axis=1)
            where = np.empty(best.shape, np.int64)
            for j, (a, b) in enumerate(zip(cuts, np.r_[cuts[1:], len(item)])):
                where[:, j] = a + s[:, a:b].argmax(axis=1)
            order = np.argsort(-best, axis=1, kind="stable")[:, : k or len(names)]
            i = np.repeat(np.arange(len(ids)), order.shape[1])
            j = order.reshape(-1)
            keep = best[i, j] > -np.inf
            out.append(pd.DataFrame({"query_id": ids[i], "entity": names[j], "item": item[where[i, j]], "score": best[i, j]})[keep])
        return pd.concat(out)

    tiles = q.groupBy("qt", "gt").cogroup(g.groupBy("qt", "gt")).applyInPandas(product, "query_id long, entity long, item long, score double")
    best = tiles.groupBy("query_id", "entity").agg(F.max("score").alias("score"), F.min_by("item", F.struct(-F.col("score"), F.col("item"))).alias("item"))
    if k is None:
        return best.select("query_id", "entity", "item", "score")
    return top_rows(best, k).select("query_id", "entity", "item", "score")


def ranked(rows: DataFrame, by: str = "score", tie: str = "entity", key: str = "query_id", name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(F.desc(by), tie)))


def top_rows(rows: DataFrame, k: int, by: str = "score", tie: str = "entity", key: str = "query_id") -> DataFrame:
    return ranked(rows, by, tie, key).where(F.col("rank") <= k)


def best_by_entity(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """One row a (query, entity): its first hit of the greatest score; then the best ``limit``."""
    order = [F.desc("score"), *(["ord"] if "ord" in hits.columns else []), "item"]
    one = hits.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "entity").orderBy(*order))).where("_n = 1").drop("_n")
    return one if limit is None else top_rows(one, limit)


def merge_views(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """Two views' hits together, best of each entity."""
    return best_by_entity(first.unionByName(second), limit)


def split_full_crop(hits: DataFrame, is_crop: Column) -> DataFrame:
    """Best score of each entity by kind of view, and which kind won (the crop on a tie)."""
    both = hits.groupBy("query_id", "entity").agg(F.max(F.when(~is_crop, F.col("score"))).alias("full_score"), F.max(F.when(is_crop, F.col("score"))).alias("crop_score"))
    crop_wins = F.col("crop_score").isNotNull() & (F.col("full_score").isNull() | (F.col("crop_score") >= F.col("full_score")))
    return both.withColumn("score", F.greatest("full_score", "crop_score")).withColumn("best_view", F.when(crop_wins, "crop").otherwise("full"))


def fuse_models(primary: DataFrame, secondary: DataFrame, weight: float = 0.5) -> DataFrame:
    """Weighted mean of two models' best scores; an entity one of them lacks takes the other's for both."""
    a = primary.groupBy("query_id", "entity").agg(F.max("score").alias("p"))
    b = secondary.groupBy("query_id", "entity").agg(F.max("score").alias("s"))
    p, s = F.coalesce("p", "s"), F.coalesce("s", "p")
    return a.join(b, ["query_id", "entity"], "full").select("query_id", "entity", p.alias("primary_score"), s.alias("secondary_score"), ((1 - weight) * p + weight * s).alias("score"))


def rescore(candidates: DataFrame, queries: DataFrame, gallery: DataFrame) -> DataFrame:
    """Exact best score over all gallery rows of each candidate (query_id, entity).

    An entity's items are dealt into tiles of about TILE rows, the queries that ask for it into larger ones; each pair of
    tiles is one matrix product.
    """
    nq = max(1, -(-queries.count() // (4 * TILE)))
    v = F.col("v").cast("array<double>").alias("v")
    tiles = gallery.groupBy("entity").agg(F.ceil(F.count("*") / TILE).cast("int").alias("ng"))
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = candidates.select(F.col("query_id").alias("id"), "entity").distinct().join(queries.select(F.col("query_id").alias("id"), v), "id")
    q = asked.join(tiles, "entity").withColumn("qt", part(F.lit(nq))).withColumn("gt", every(F.col("ng"))).drop("ng")
    g = gallery.select("entity", F.col("item").alias("id"), v).join(tiles, "entity").withColumn("gt", part(F.col("ng"))).withColumn("qt", every(F.lit(nq))).drop("ng")

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "entity": np.empty(0, np.int64), "score": np.empty(0)})
        ids, item = left["id"].to_numpy(), right["id"].to_numpy()
        vectors, best = np.stack(right["v"].to_numpy()).T, np.empty(len(left))
        for part in range(0, len(left), 256):
            s = np.stack(left["v"].iloc[part : part + 256].to_numpy()) @ vectors
            s[ids[part : part + 256, None] == item[None, :]] = -np.inf
            best[part : part + 256] = s.max(axis=1)
        return pd.DataFrame({"query_id": ids, "entity": left["entity"].to_numpy(), "score": best})[best > -np.inf]

    found = q.groupBy("entity", "qt", "gt").cogroup(g.groupBy("entity", "qt", "gt")).applyInPandas(product, "query_id long, entity long, score double")
    # rounding keeps the order, so the greatest is rounded last
    return found.groupBy("query_id", "entity").agg(F.round(F.max("score"), 6).alias("score"))


def lsh_candidates(queries: DataFrame, gallery: DataFrame, dim: int, bits: int = 12, bands: int = 8, seed: int = 3) -> DataFrame:
    """(query_id, item) pairs that agree on the signs of ``bits`` random projections in some band.

    The way beyond exact tiles: an equi-join on band keys, then rescore.
    """
    planes = np.random.default_rng(seed).standard_normal((bands, bits, dim))

    def keys(v: Column) -> Column:
        band = lambda b: F.concat_ws("", F.lit(f"{b}:"), *[(dot(v, F.array(*[F.lit(float(x)) for x in planes[b, i]])) > 0).cast("int").cast("string") for i in range(bits)])
        return F.explode(F.array(*[band(b) for b in range(bands)]))

    q = queries.select("query_id", keys(F.col("v")).alias("band"))
    g = gallery.select("item", keys(F.col("v")).alias("band"))
    return q.join(g, "band").select("query_id", "item").distinct()
