"""Boxes derived from events: overlaps, priorities, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlake.functions import geometry as G
from matchlake.operators import evaluate
from matchlake.plans.common import query, table

BOXES = """b AS (SELECT event_id, user_id AS image, (event_id * 7 % 60) / 100.0 AS x0, (event_id * 11 % 50) / 100.0 AS y0, (event_id * 7 % 60) / 100.0 + 0.05 + (event_id % 30) / 100.0 AS x1,
 least(1.0, (event_id * 11 % 50) / 100.0 + 0.15 + (event_id * 3 % 70) / 100.0) AS y1, (event_id * 13 % 100) / 100.0 AS score FROM events)"""


def boxes(spark, sf_dir):
    m = lambda a, n: F.pmod(F.col("event_id") * a, F.lit(n))
    x0, y0 = m(7, 60) / 100.0, m(11, 50) / 100.0
    box = F.array(x0, y0, x0 + 0.05 + m(1, 30) / 100.0, F.least(F.lit(1.0), y0 + 0.15 + m(3, 70) / 100.0))
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("image"), box.alias("box"), (m(13, 100) / 100.0).alias("score"))


@query(
    "iou_pairs",
    f"""WITH {BOXES}, p AS (SELECT a.image, a.event_id AS a, b.event_id AS b, greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i,
 (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s FROM b a JOIN b ON a.image = b.image AND a.event_id < b.event_id)
SELECT image, a, b, round(i / (s - i), 4) AS iou FROM p WHERE i / (s - i) > 0.72""",
)
def iou_pairs(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    left, right = rows.select("image", F.col("event_id").alias("a"), F.col("box").alias("p")), rows.select("image", F.col("event_id").alias("b"), F.col("box").alias("q"))
    pairs = left.join(right, "image").where("a < b").withColumn("iou", G.iou(F.col("p"), F.col("q")))
    return pairs.where("iou > 0.72").select("image", "a", "b", F.round("iou", 4).alias("iou"))


@query(
    "box_priority",
    f"""WITH {BOXES}, s AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM b) SELECT event_id, round(0.48 * least(1.0, sqrt(w * h) / 0.62) + 0.24 * (1 - least(1.0, abs((x0 + x1) / 2 - 0.5) / 0.5)) + 0.16 * least(greatest((y1 - 0.35) / 0.60, 0.0), 1.0) + 0.12 * score
 - CASE WHEN x0 < 0.015 OR x1 > 0.985 THEN 0.10 ELSE 0.0 END, 4) AS priority FROM s WHERE score >= 0.25 AND w >= 0.045 AND h >= 0.18 AND w * h BETWEEN 0.015 AND 0.92 AND h / w >= 1.12""",
)
def box_priority(spark, sf_dir):
    rows = boxes(spark, sf_dir).where(G.box_usable(F.col("box"), F.col("score")))
    return rows.select("event_id", F.round(G.box_priority(F.col("box"), F.col("score")), 4).alias("priority"))


@query("greedy_nms")
def greedy_nms(spark, sf_dir):
    rows = boxes(spark, sf_dir).where(G.box_usable(F.col("box"), F.col("score"))).withColumn("priority", F.round(G.box_priority(F.col("box"), F.col("score")), 4))
    return evaluate.greedy_nms(rows).select("image", "event_id", "priority")


@query(
    "quality_gate",
    f"""WITH {BOXES}, s AS (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM b), r AS (SELECT event_id, concat_ws(',', CASE WHEN w * h < 0.025 THEN 'tiny_region' END, CASE WHEN w / h < 0.32 AND w * h < 0.12 THEN 'narrow_fragment' END,
 CASE WHEN w / h > 5 AND w * h < 0.12 THEN 'thin_fragment' END, CASE WHEN w * h < 0.06 AND (y0 + y1) / 2 < 0.40 THEN 'small_upper_fragment' END) AS reasons FROM s) SELECT event_id, reasons, reasons = '' AS usable FROM r""",
)
def quality_gate(spark, sf_dir):
    reasons = F.array_join(G.crop_quality(F.col("box")), ",")
    return boxes(spark, sf_dir).select("event_id", reasons.alias("reasons"), (reasons == "").alias("usable"))


@query("shelf_regions", f"WITH {BOXES} SELECT event_id, round(greatest(x0 - 0.04, 0.0), 4) AS left_edge, round(greatest(y0 - 0.16, 0.0), 4) AS top_edge FROM b WHERE x1 - x0 < 0.48 AND (x1 - x0) * (y1 - y0) < 0.22")
def shelf_regions(spark, sf_dir):
    rows = boxes(spark, sf_dir).withColumn("region", G.shelf_region(F.col("box"))).where("region IS NOT NULL")
    return rows.select("event_id", F.round(F.col("region")[0], 4).alias("left_edge"), F.round(F.col("region")[1], 4).alias("top_edge"))
