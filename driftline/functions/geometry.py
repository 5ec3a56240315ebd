"""Boxes as arrays ``[x0, y0, x1, y1]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _side(box: Column, low: int) -> Column:
    return F.greatest(box[low + 2] - box[low], F.lit(0.0))


def area(box: Column) -> Column:
    return _side(box, 0) * _side(box, 1)


def _shared(a: Column, b: Column, low: int) -> Column:
    return F.greatest(F.least(a[low + 2], b[low + 2]) - F.greatest(a[low], b[low]), F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    return _shared(a, b, 0) * _shared(a, b, 1)


def overlap_of_first(a: Column, b: Column) -> Column:
    """Intersection over the area of ``a``; 0 for an empty box."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def overlap_of_smaller(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 if either box is empty."""
    small = F.least(area(a), area(b))
    return F.when(small > 0, intersection(a, b) / small).otherwise(0.0)


def horizontal_overlap(a: Column, b: Column) -> Column:
    small = F.least(_side(a, 0), _side(b, 0))
    return F.when(small > 0, _shared(a, b, 0) / small).otherwise(0.0)


def valid(box: Column) -> Column:
    """Four numbers in [0, 1] that span an area."""
    inside = F.forall(box, lambda x: x.isNotNull() & (x >= 0) & (x <= 1))
    return F.coalesce((F.size(box) == 4) & inside & (box[2] > box[0]) & (box[3] > box[1]), F.lit(False))


def normalized(box: Column, width: Column, height: Column) -> Column:
    """Absolute coordinates as shares of the page, clamped to [0, 1]."""
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.array(unit(box[0] / width), unit(box[1] / height), unit(box[2] / width), unit(box[3] / height))


def profile(box: Column) -> Column:
    """Width, height, area, sides ratio, and whether a box is nearly the whole page; zeros for one that is none."""
    good = lambda c: F.round(F.when(valid(box), c).otherwise(0.0), 6)
    w, h = _side(box, 0), _side(box, 1)
    full = valid(box) & ((area(box) >= 0.9) | ((w >= 0.95) & (h >= 0.95)))
    return F.struct(good(w).alias("width"), good(h).alias("height"), good(area(box)).alias("area"), F.when(valid(box), F.round(w / h, 4)).otherwise(0.0).alias("aspect_ratio"), full.alias("is_near_full_page"))


def sane(box: Column, min_width: float = 0.02, min_height: float = 0.02, min_area: float = 0.0005, max_area: float = 0.95, near_full: float = 0.9) -> Column:
    """Whether a box can be a table's: valid, neither too small nor nearly the whole page; with the reason if not."""
    p = profile(box)
    reason = (
        F.when(~valid(box), "invalid_bbox")
        .when(p["width"] < min_width, "bbox_too_narrow")
        .when(p["height"] < min_height, "bbox_too_short")
        .when(p["area"] < min_area, "bbox_area_too_small")
        .when(p["area"] > max_area, "bbox_area_too_large")
        .when((p["area"] >= near_full) | ((p["width"] >= near_full) & (p["height"] >= near_full)), "bbox_near_full_page")
        .when((p["width"] / p["height"] > 20) | (p["height"] / p["width"] > 20), "extreme_aspect_ratio")
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def proof_box(box: Column) -> Column:
    """A box as four numbers if it is valid, else null."""
    numbers = F.transform(box, lambda x: x.cast("double"))
    return F.when(valid(numbers), numbers)
