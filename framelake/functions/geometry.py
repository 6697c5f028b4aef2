"""Boxes [x1, y1, x2, y2] and landmarks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bbox_area(box: Column) -> Column:
    """Zero for null, empty and inverted boxes."""
    return F.coalesce(F.greatest(F.lit(0.0), (box[2] - box[0]).cast("double")) * F.greatest(F.lit(0.0), (box[3] - box[1]).cast("double")), F.lit(0.0))


def bbox_iou(one: Column, two: Column) -> Column:
    w = F.greatest(F.lit(0), F.least(one[2], two[2]) - F.greatest(one[0], two[0])).cast("double")
    h = F.greatest(F.lit(0), F.least(one[3], two[3]) - F.greatest(one[1], two[1])).cast("double")
    return F.when(one.isNull() | two.isNull() | (w * h <= 0), 0.0).otherwise(w * h / (bbox_area(one) + bbox_area(two) - w * h))


def clip_bbox(box: Column, width: Column, height: Column) -> Column:
    """The box inside the image, or null if nothing is left."""
    inside = lambda x, n: F.greatest(F.lit(0), F.least(x, n - 1)).cast("int")
    x1, y1, x2, y2 = inside(box[0], width), inside(box[1], height), inside(box[2], width), inside(box[3], height)
    return F.when((x2 > x1) & (y2 > y1), F.array(x1, y1, x2, y2))


def detection_scale(width: Column, height: Column, max_side: int) -> Column:
    return F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest(width, height))


def rescale_bbox(box: Column, scale: Column) -> Column:
    """From the scaled image back to the original, rounding half to even."""
    return F.transform(box, lambda v: F.rint(v / scale).cast("int"))


def rescale_landmarks(landmarks: Column, scale: Column) -> Column:
    return F.transform_values(landmarks, lambda _, p: F.transform(p, lambda v: v / scale))


def square_crop_box(box: Column, height: Column, width: Column, crop_scale: float = 1.3) -> Column:
    """A square around the box, `crop_scale` times its longer side, as far as the image allows; null for invalid input."""
    h, w = height.cast("double"), width.cast("double")
    x1, y1, x2, y2 = (box[k].cast("double") for k in range(4))
    side = F.least(F.greatest(x2 - x1, y2 - y1) * max(1.0, crop_scale), F.least(w, h))
    left = F.least(F.greatest(F.lit(0.0), (x1 + x2) / 2 - side / 2), F.greatest(F.lit(0.0), w - side))
    top = F.least(F.greatest(F.lit(0.0), (y1 + y2) / 2 - side / 2), F.greatest(F.lit(0.0), h - side))
    c1 = F.greatest(F.lit(0), F.least(F.floor(left), F.floor(w) - 1)).cast("int")
    c2 = F.greatest(F.lit(0), F.least(F.floor(top), F.floor(h) - 1)).cast("int")
    c3 = F.greatest(c1 + 1, F.least(F.ceil(left + side), F.floor(w))).cast("int")
    c4 = F.greatest(c2 + 1, F.least(F.ceil(top + side), F.floor(h))).cast("int")
    return F.when((h > 0) & (w > 0) & (x2 > x1) & (y2 > y1), F.array(c1, c2, c3, c4))


def _between(a: Column, b: Column, t: Column) -> Column:
    return (1 - t) * a + t * b


def lerp_bbox(one: Column, two: Column, t: Column) -> Column:
    """The box between two, rounding half to even."""
    return F.zip_with(one, two, lambda a, b: F.rint(_between(a.cast("double"), b.cast("double"), t)).cast("int"))


def lerp_landmarks(one: Column, two: Column, t: Column) -> Column:
    return F.map_zip_with(one, two, lambda _, a, b: F.zip_with(a, b, lambda x, y: _between(x, y, t)))
