"""Boxes (x0, y0, x1, y1), their overlaps and quality, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if the union is empty."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def crop_quality(b: Column) -> Column:
    """Why a crop in shares of the frame is of no use; empty: it is."""
    w, h = b[2] - b[0], b[3] - b[1]
    aspect = w / F.when(h > 0, h)
    size = w * h
    return F.array_compact(
        F.array(
            F.when(size < 0.025, "tiny_region"), F.when((aspect < 0.32) & (size < 0.12), "narrow_fragment"), F.when((aspect > 5) & (size < 0.12), "thin_fragment"),
            F.when((size < 0.06) & ((b[1] + b[3]) / 2 < 0.40), "small_upper_fragment"),
        )
    )


def shelf_region(b: Column) -> Column:
    """The padded region of a small label among others; null for a frame-sized one."""
    w, h = b[2] - b[0], b[3] - b[1]
    pad = F.array(b[0] - 0.04, b[1] - 0.16, b[2] + 0.04, b[3] + 0.03)
    return F.when((w < 0.48) & (w * h < 0.22), F.transform(pad, lambda v: clamp(v, 0.0, 1.0)))


def box_usable(b: Column, score: Column) -> Column:
    """Detector boxes, in shares of the frame, that can be a bottle."""
    w, h = b[2] - b[0], b[3] - b[1]
    return (score >= 0.25) & (w >= 0.045) & (h >= 0.18) & (w * h).between(0.015, 0.92) & (h / w >= 1.12)


def box_priority(b: Column, score: Column) -> Column:
    """Weighted size, centrality, lowness and confidence, less a penalty at the frame's edge."""
    size = F.least(F.lit(1.0), F.sqrt(area(b)) / 0.62)
    centre = 1 - F.least(F.lit(1.0), F.abs((b[0] + b[2]) / 2 - 0.5) / 0.5)
    low = clamp((b[3] - 0.35) / 0.60, 0.0, 1.0)
    edge = F.when((b[0] < 0.015) | (b[2] > 0.985), 0.10).otherwise(0.0)
    return 0.48 * size + 0.24 * centre + 0.16 * low + 0.12 * score - edge


def ambiguous(first: Column, second: Column) -> Column:
    """Whether two ranked boxes (structs of box, priority, confidence) are comparable."""
    a, b = first["box"], second["box"]
    return (area(b) >= area(a) * 0.68) & (first["priority"] - second["priority"] <= 0.11) & (F.abs(first["confidence"] - second["confidence"]) <= 0.22)


def shoelace(points: Column) -> Column:
    """Area of a polygon given as an array of points."""
    n = F.size(points)
    term = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(points, i)[0] * F.get(points, F.pmod(i + 1, n))[1] - F.get(points, F.pmod(i + 1, n))[0] * F.get(points, i)[1])
    return F.abs(F.aggregate(term, F.lit(0.0), lambda s, x: s + x)) / 2


def remap(points: Column, x0: Column, y0: Column, sx: Column, sy: Column) -> Column:
    """Points of a crop in the whole frame."""
    return F.transform(points, lambda p: F.array(x0 + p[0] * sx, y0 + p[1] * sy))


def crop_rectangle(b: Column, pad: float, skip: float = 0.94) -> Column:
    """A box grown by ``pad`` on each side within the frame; null if that is nearly all of it."""
    w, h = b[2] - b[0], b[3] - b[1]
    grown = F.array(clamp(b[0] - w * pad, 0.0, 1.0), clamp(b[1] - h * pad, 0.0, 1.0), clamp(b[2] + w * pad, 0.0, 1.0), clamp(b[3] + h * pad, 0.0, 1.0))
    return F.when(area(grown) <= skip, grown)
