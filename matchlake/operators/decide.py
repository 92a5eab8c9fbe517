"""Margins and three-state decisions over ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchlake.functions import tables as T


def by_query() -> WindowSpec:
    """Rows of one query; made when asked for, since windows need a running session."""
    return W.partitionBy("query_id")


def harmonic(p: Column, r: Column) -> Column:
    """F1 of two values clamped to 0..1, to 4 digits; 0 if both are 0."""
    p, r = (F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) for x in (p, r))
    return F.when(p + r > 0, F.round(2 * p * r / (p + r), 4)).otherwise(F.lit(0.0))


def with_margin(rows: DataFrame, by: str = "score", tie: str = "entity") -> DataFrame:
    """rank and margin to the next candidate; a last one's margin is its own score."""
    order = by_query().orderBy(F.desc(by), tie)
    return rows.withColumn("rank", F.row_number().over(order)).withColumn("margin", F.round(F.col(by) - F.coalesce(F.lead(by).over(order), F.lit(0.0)), 4))


def pseudo_f1(rows: DataFrame, by: str = "score", tie: str = "entity", scale: float = T.PSEUDO_F1_SCALE) -> DataFrame:
    """(query_id, margin, f1_top1, f1_top5): similarity against the lead over the 2nd and 5th candidate.

    Scores are rounded to 4 digits before they are compared.
    """
    top = rows.withColumn("s", F.round(by, 4)).withColumn("rank", F.row_number().over(by_query().orderBy(F.desc(by), tie))).where("rank <= 5")
    one = top.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("s"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("s"))).alias("b"), F.min_by("s", -F.col("rank")).alias("e"))
    margin = F.round(F.col("a") - F.coalesce("b", F.lit(0.0)), 4)
    return one.select("query_id", margin.alias("margin"), harmonic(F.col("a"), margin / scale).alias("f1_top1"), harmonic(F.col("a"), (F.col("a") - F.col("e")) / scale).alias("f1_top5"))


def distinct_margin(rows: DataFrame, family: str, by: str = "score", tie: str = "entity") -> DataFrame:
    """(query_id, entity, score, margin): lead of the first candidate over the first not of its family."""
    order = by_query().orderBy(F.desc(by), tie)
    lead = rows.withColumn("rank", F.row_number().over(order)).withColumn("lead", F.first(family).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    other = F.max(F.when((F.col("rank") > 1) & ~F.col(family).eqNullSafe(F.col("lead")), F.col(by))).over(by_query())
    return lead.withColumn("margin", F.round(F.col(by) - F.coalesce(other, F.lit(0.0)), 4)).where("rank = 1").select("query_id", "entity", by, "margin")


def visual_match(score: Column, margin: Column, tie: Column | None = None, corroborated: Column | None = None) -> Column:
    v = T.VISUAL
    tie, corroborated = (F.lit(False) if x is None else x for x in (tie, corroborated))
    clear = (score >= v["threshold"]) & ((margin >= v["margin"]) | tie | corroborated | (score >= v["clear"]))
    return clear | ((score >= v["floor"]) & (margin >= v["floor_margin"]))


def visual_status(score: Column, margin: Column, tie: Column | None = None, corroborated: Column | None = None, usable: Column | None = None) -> Column:
    """matched / uncertain / unknown; a crop of no use vetoes a match that no text corroborates."""
    match = visual_match(score, margin, tie, corroborated)
    if usable is not None:
        match = match & (usable | (F.lit(False) if corroborated is None else corroborated))
    return F.when(match, "matched").when(score >= T.VISUAL["uncertain"], "uncertain").otherwise("unknown")


def batch_status(score: Column, margin: Column) -> Column:
    """The batch evaluator's rule, without the gap clause."""
    v = T.VISUAL
    return F.when((score >= v["threshold"]) & ((margin >= v["margin"]) | (score >= v["clear"])), "matched").when(score >= v["uncertain"], "uncertain").otherwise("unknown")


def share_leads(p: Column, runner: Column, least: float = T.FUSION["share"], gap: float = T.FUSION["share_gap"]) -> Column:
    return (p >= least - 1e-9) & (p - runner >= gap - 1e-9)


def fusion_status(probability: Column, runner: Column, visual: Column, visual_lead: Column, text_lead: Column | None = None, coverage: Column | None = None) -> Column:
    """The ranker's rule: a sure probability, or a lesser one with a lead in share, picture or text."""
    f = T.FUSION
    match = (probability >= f["match"]) | ((probability >= f["lead"]) & (visual_lead >= f["visual_lead"])) | share_leads(probability, runner)
    if text_lead is not None:
        match = match | ((probability >= f["match"]) & (text_lead >= f["text_lead"]) & (coverage >= f["text_coverage"]))
    return F.when(match, "matched").when((probability >= f["uncertain"]) | (visual >= f["uncertain_visual"]), "uncertain").otherwise("unknown")


def text_status(score: Column, useful_tokens: Column) -> Column:
    return F.when((score >= T.TEXT_MATCH) & (useful_tokens >= 2), "matched").when(score >= T.TEXT_UNCERTAIN, "uncertain").otherwise("unknown")


def softmax(logit: Column) -> Column:
    """Softmax over the rows of a query."""
    e = F.exp(logit - F.max(logit).over(by_query()))
    return e / F.sum(e).over(by_query())


def promote(rows: DataFrame, qualifies: Column, prefer: Column | None = None) -> DataFrame:
    """Move the qualifying row of each query to the front: the first by rank, or by ``prefer`` descending."""
    order = [F.desc(prefer)] if prefer is not None else []
    pick = F.row_number().over(W.partitionBy("query_id", "_q").orderBy(*order, "rank"))
    moved = rows.withColumn("_q", F.coalesce(qualifies, F.lit(False))).withColumn("_m", F.col("_q") & (pick == 1))
    again = F.row_number().over(by_query().orderBy(F.desc("_m"), "rank"))
    return moved.withColumn("rank", again).withColumn("promoted", F.col("_m")).drop("_q", "_m")


def lock_leader(rows: DataFrame, visual: str, delta: str, lead: float = T.LEADER_LOCK) -> DataFrame:
    """Keep a clear visual leader first unless a close sibling has much more text evidence."""
    order = by_query().orderBy(F.desc(visual), "entity")
    rows = rows.withColumn("_v", F.row_number().over(order)).withColumn("_top", F.max(visual).over(by_query()))
    second = F.max(F.when(F.col("_v") == 2, F.col(visual))).over(by_query())
    own = F.max(F.when(F.col("_v") == 1, F.col(delta))).over(by_query())
    rival = F.max(((F.col("_v") > 1) & (F.col(delta) - own >= T.OCR_SIBLING_DELTA) & (F.col("_top") - F.col(visual) <= T.OCR_SIBLING_GAP)).cast("int")).over(by_query())
    locked = (F.col("_top") - F.coalesce(second, F.lit(0.0)) >= lead) & (rival == 0)
    rows = rows.withColumn("locked", locked)
    return rows.withColumn("rank", F.row_number().over(by_query().orderBy(F.desc(F.col("locked") & (F.col("_v") == 1)), F.desc("score"), "entity"))).drop("_v", "_top")
