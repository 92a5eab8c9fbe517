"""Candidates of several channels, the ranker's features, and order-dependent promotions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchlake.functions import tables as T
from matchlake.operators.decide import by_query, softmax


def candidate_union(visual: DataFrame, texts: list[DataFrame], visual_k: int = T.VISUAL_K, text_n: int = T.TEXT_N) -> DataFrame:
    """(query_id, entity, priority): the best of the picture, then of each text channel, that have a picture score.

    Channels hold (query_id, entity, score); an entity keeps the place where it came first.
    """
    channels = []
    for no, (rows, n) in enumerate([(visual, visual_k), *[(t, text_n) for t in texts]]):
        rank = F.row_number().over(by_query().orderBy(F.desc("score"), "entity"))
        channels.append(rows.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "entity", (F.lit(no * 1000) + F.col("rank")).alias("priority")))
    both = channels[0]
    for c in channels[1:]:
        both = both.unionByName(c)
    first = both.groupBy("query_id", "entity").agg(F.min("priority").alias("priority"))
    return first.join(visual.select("query_id", "entity"), ["query_id", "entity"], "left_semi")


def features(rows: DataFrame) -> DataFrame:
    """The 13 ranker features of (query_id, entity, visual, text, coverage, sweetness, colour, year, contradiction, photo).

    Missing text values count as 0. All equal best texts are leaders.
    """
    zero = rows.na.fill(0.0, [c for c in ("text", "coverage", "contradiction", "photo") if c in rows.columns])
    best, photo_best = F.max("text").over(by_query()), F.max("photo").over(by_query())
    place = F.row_number().over(by_query().orderBy(F.desc("text"), "entity"))
    second = F.coalesce(F.max(F.when(F.col("_place") == 2, F.col("text"))).over(by_query()), F.lit(0.0))
    gap = F.col("visual") - F.max("visual").over(by_query())
    share = lambda x, b: F.when(b > 0, x / b).otherwise(F.lit(0.0))
    leader = (F.col("text") >= best) & (best > 0)
    return zero.withColumn("_place", place).select(
        "query_id", "entity", "visual", "text", "coverage",
        gap.alias("visual_gap"), F.least(F.lit(0.0), gap + T.FAR_KNEE).alias("visual_far"), share(F.col("text"), best).alias("text_share"), F.log1p("text").alias("text_log"),
        F.col("coverage").alias("f_coverage"), F.col("sweetness").cast("double").alias("sweetness"), F.col("colour").cast("double").alias("colour"), F.col("year").cast("double").alias("year"),
        leader.cast("double").alias("text_leader"), share(F.col("contradiction"), best).alias("contradiction"), F.when(leader, (best - second) / best).otherwise(F.lit(0.0)).alias("text_margin"),
        share(F.col("photo"), photo_best).alias("photo_text_share"), F.log1p("photo").alias("photo_text_log"),
    )


def rank(featured: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """logit, probability (softmax over the query) and rank of featured candidates."""
    weights = weights or T.RANKER
    if list(weights) != list(T.RANKER):
        raise ValueError("the weights are for other features")
    logit = sum((F.col("f_coverage" if name == "coverage" else name) * w for name, w in weights.items()), F.lit(0.0))
    rows = featured.withColumn("logit", F.round(logit, 6))
    rows = rows.withColumn("probability", softmax(F.col("logit")))
    return rows.withColumn("rank", F.row_number().over(by_query().orderBy(F.desc("logit"), "entity")))


def sibling_override(ranked: DataFrame, contributed: DataFrame, groups: DataFrame) -> DataFrame:
    """Put a close sibling of the same group first if only it explains words of the label.

    Looks at ranks 2 and 3 of the given ranking; the first that qualifies wins. contributed
    (query_id, entity, word, value), groups (entity, group).
    """
    top = ranked.where("rank <= 3").join(groups, "entity")
    lead = top.where((F.col("rank") == 1) & F.col("group").isNotNull() & (F.col("group") != "")).select("query_id", F.col("entity").alias("lead"), F.col("visual").alias("lead_visual"), "group")
    pairs = top.where("rank > 1").select("query_id", "entity", "rank", "visual", "group").join(lead, ["query_id", "group"]).where(F.col("lead_visual") - F.col("visual") <= T.SIBLING_GAP)
    words = contributed.select("query_id", F.col("entity").alias("e"), "word", "value")
    own = pairs.join(words, "query_id").where((F.col("e") == F.col("entity")) | (F.col("e") == F.col("lead")))
    per = own.groupBy("query_id", "entity", "rank", "word").agg(F.max(F.when(F.col("e") == F.col("entity"), F.col("value"))).alias("o"), F.max(F.when(F.col("e") == F.col("lead"), F.col("value"))).alias("l"))
    sums = per.groupBy("query_id", "entity", "rank").agg(F.sum(F.when(F.col("l").isNull(), F.col("o")).otherwise(0.0)).alias("other_only"), F.sum(F.when(F.col("o").isNull(), F.col("l")).otherwise(0.0)).alias("lead_only"))
    won = sums.where((F.col("other_only") >= T.SIBLING_OWN) & (F.col("lead_only") < T.SIBLING_LEAD_SHARE)).groupBy("query_id").agg(F.min_by("entity", "rank").alias("winner"))
    rows = ranked.join(won, "query_id", "left").withColumn("promoted", F.coalesce(F.col("winner") == F.col("entity"), F.lit(False))).drop("winner")
    return rows.withColumn("rank", F.row_number().over(by_query().orderBy(F.desc("promoted"), "rank")))


def distinctive(ranked: DataFrame, markers: DataFrame, seen: DataFrame, gap: float = T.DISTINCTIVE_GAP) -> DataFrame:
    """Put a sibling first whose own markers the text names while it names none of the leader's own.

    ranked (query_id, entity, rank, visual), markers (entity, group, markers array), seen (query_id, words array).
    """
    top = ranked.where("rank <= 5").join(markers, "entity").join(seen, "query_id")
    lead = top.where("rank = 1").select("query_id", F.col("visual").alias("lv"), F.col("group").alias("lg"), F.col("markers").alias("lm"))
    other = top.where("rank > 1").join(lead, "query_id").where((F.col("lv") - F.col("visual") <= gap) & (F.col("group") == F.col("lg")))
    ok = F.arrays_overlap(F.array_except("markers", "lm"), "words") & ~F.arrays_overlap(F.array_except("lm", "markers"), "words")
    won = other.where(ok).groupBy("query_id").agg(F.min_by("entity", "rank").alias("winner"))
    rows = ranked.join(won, "query_id", "left").withColumn("promoted", F.coalesce(F.col("winner") == F.col("entity"), F.lit(False))).drop("winner")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("promoted"), "rank")))
