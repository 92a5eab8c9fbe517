"""Entry points of the service, over many requests at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.functions import geometry as G
from matchlake.functions import tables as T
from matchlake.operators import decide, evaluate, feed, fusion, lexical, recommend, vector
from matchlake.sources.catalog import card  # noqa: F401
from matchlake.operators.lexical import search  # noqa: F401


def resolve(queries: DataFrame, gallery: DataFrame, texts: DataFrame | None = None, index: lexical.TextIndex | None = None, groups: DataFrame | None = None, mode: str = "combined") -> DataFrame:
    """(query_id, entity, probability, visual, rank, status): who each query is.

    queries (query_id, v), gallery (entity, item, v), texts (query_id, word, weight) read
    from the label with an index of the catalogue, groups (entity, group). Modes that read
    only the picture leave the text out; modes that read only the text rank by it.
    """
    if mode not in T.MODES:
        raise ValueError(f"unknown mode {mode}")
    by_text = mode.startswith("ocr") and texts is not None and index is not None
    told = scored = None
    if texts is not None and index is not None and not mode.startswith("image"):
        told = lexical.contributions(texts, index, lexical.resolve(texts.select("word").distinct(), index.idf))
        scored = lexical.evidence(told, index)
    if by_text:
        rows = decide.with_margin(scored.withColumn("score", F.col("coverage")))
        words = texts.groupBy("query_id").agg(F.countDistinct("word").alias("words"))
        return rows.join(words, "query_id").select("query_id", "entity", F.lit(None).cast("double").alias("probability"), F.lit(None).cast("double").alias("visual"), "rank", decide.text_status(F.col("score"), F.col("words")).alias("status"))
    visual = vector.top_entities(queries, gallery).select("query_id", "entity", F.col("score").alias("visual"))
    if scored is None:
        rows = decide.with_margin(visual.withColumnRenamed("visual", "score"))
        return rows.select("query_id", "entity", F.lit(None).cast("double").alias("probability"), F.col("score").alias("visual"), "rank", decide.visual_status(F.col("score"), F.col("margin")).alias("status"))
    candidates = fusion.candidate_union(visual.withColumnRenamed("visual", "score"), [scored])
    rows = candidates.join(visual, ["query_id", "entity"]).join(scored.withColumnRenamed("score", "text"), ["query_id", "entity"], "left")
    against = lexical.contradiction(told, groups, rows) if groups is not None else rows.select("query_id", "entity", F.lit(0.0).alias("contradiction"))
    rows = rows.join(against, ["query_id", "entity"]).withColumns({"sweetness": F.lit(0), "colour": F.lit(0), "year": F.lit(0), "photo": F.lit(0.0)})
    ranked = fusion.rank(fusion.features(rows))
    if groups is not None:
        ranked = fusion.sibling_override(ranked, told, groups)
    by = decide.by_query()
    lead = F.col("visual") - F.coalesce(F.max(F.when(F.col("rank") > 1, F.col("visual"))).over(by), F.lit(0.0))
    runner = F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("probability"))).over(by), F.lit(0.0))
    other = F.coalesce(F.max(F.when(F.col("rank") > 1, F.round("text", 3))).over(by), F.lit(0.0))
    text = F.round("text", 3)
    ranked = ranked.withColumn("_lead", lead).withColumn("_runner", runner).withColumn("_text", F.when(text > 0, (text - other) / text).otherwise(0.0))
    status = decide.fusion_status(F.col("probability"), F.col("_runner"), F.col("visual"), F.col("_lead"), F.col("_text"), F.round("coverage", 3))
    return ranked.select("query_id", "entity", "probability", "visual", "rank", status.alias("status"))


def top1(resolved: DataFrame) -> DataFrame:
    return resolved.where("rank = 1").select("query_id", "entity")


def rank_boxes(detections: DataFrame) -> DataFrame:
    """(image, box, priority, rank, ambiguous) of (image, box, score): bottles in a frame, best first."""
    rows = detections.where(G.box_usable(F.col("box"), F.col("score"))).withColumn("priority", F.round(G.box_priority(F.col("box"), F.col("score")), 4))
    kept = vector.ranked(evaluate.greedy_nms(rows), by="priority", tie="score", key="image")
    at = lambda k: F.max(F.when(F.col("rank") == k, F.struct("box", "priority", F.col("score").alias("confidence"))))
    pair = kept.groupBy("image").agg(at(1).alias("a"), at(2).alias("b"))
    return kept.join(pair.select("image", F.coalesce(G.ambiguous(F.col("a"), F.col("b")), F.lit(False)).alias("ambiguous")), "image")


def recent(events: DataFrame, catalog: DataFrame, limit: int = 12, key: str = "slug", ts: str = "created_at") -> DataFrame:
    """The newest distinct entities that the catalogue knows, 1 to 12 of them."""
    return feed.feed(feed.retained(events, ts), catalog, key, max(1, min(12, limit)), ts, over_fetch=2)


def alternatives(pairs: DataFrame, k: int = 3) -> DataFrame:
    return recommend.alternatives(pairs, k)


def recommend_for(requests: DataFrame, catalog: DataFrame, k: int = 8) -> DataFrame:
    return recommend.recommend(recommend.occasion_score(catalog, requests), k)


def health(**tables: DataFrame) -> DataFrame:
    return feed.health(**tables)
