"""Boxes are structs ``left, top, width, height`` in shares of the page, origin at the top left."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<left:double,top:double,width:double,height:double>"
#: How far a target may stick out of its crop.
EPSILON = 1e-3


def box(left, top, width, height) -> Column:
    cols = [c if isinstance(c, Column) else F.lit(float(c)) for c in (left, top, width, height)]
    return F.struct(*[c.cast("double").alias(n) for c, n in zip(cols, ("left", "top", "width", "height"), strict=True)])


FULL_PAGE = (0.0, 0.0, 1.0, 1.0)


def full_page() -> Column:
    return box(*FULL_PAGE)


def right(b: Column) -> Column:
    return b["left"] + b["width"]


def bottom(b: Column) -> Column:
    return b["top"] + b["height"]


def rules(b: Column) -> dict[str, Column]:
    """What a box must be, by name, in order. The right and lower edges may exceed 1."""
    return {
        "corner": (b["left"] >= 0) & (b["left"] <= 1) & (b["top"] >= 0) & (b["top"] <= 1),
        "extent": (b["width"] > 0) & (b["height"] > 0),
        "size": (b["width"] <= 1) & (b["height"] <= 1),
    }


def is_valid(b: Column) -> Column:
    """Corner within the page, extents within (0, 1]; NULL is not valid."""
    return F.coalesce(reduce(and_, rules(b).values()), F.lit(False))


def overlaps(a: Column, b: Column) -> Column:
    """A common area; touching edges have none."""
    return (F.least(right(a), right(b)) - F.greatest(a["left"], b["left"]) > 0) & (F.least(bottom(a), bottom(b)) - F.greatest(a["top"], b["top"]) > 0)


def contains(outer: Column, inner: Column, epsilon: float = EPSILON) -> Column:
    return (inner["left"] >= outer["left"] - epsilon) & (inner["top"] >= outer["top"] - epsilon) & (right(inner) <= right(outer) + epsilon) & (bottom(inner) <= bottom(outer) + epsilon)


def union_box(b: Column) -> Column:
    """Aggregate: the smallest box around all of a group's; NULL without boxes or without extent."""
    low, high, up, down = F.min(b["left"]), F.max(right(b)), F.min(b["top"]), F.max(bottom(b))
    return F.when((high > low) & (down > up), box(low, up, high - low, down - up))


def union_of(boxes: Column) -> Column:
    """The same for an array of boxes."""
    low, up = F.array_min(F.transform(boxes, lambda b: b["left"])), F.array_min(F.transform(boxes, lambda b: b["top"]))
    high, down = F.array_max(F.transform(boxes, right)), F.array_max(F.transform(boxes, bottom))
    return F.when((high > low) & (down > up), box(low, up, high - low, down - up))


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def from_bottom_left(x: Column, y: Column, w: Column, h: Column) -> Column:
    """From a box with its origin at the bottom left: clamped to the page and flipped; NULL without extent."""
    left, high, low, up = _unit(x), _unit(x + w), _unit(y), _unit(y + h)
    return F.when((high > left) & (up > low), box(left, 1 - up, high - left, up - low))


def from_quad(xs: Column, ys: Column) -> Column:
    """From four corners (arrays, origin at the bottom left): the box around them, flipped and clamped; NULL without extent."""
    left, high = _unit(F.array_min(xs)), _unit(F.array_max(xs))
    up, low = _unit(1 - F.array_max(ys)), _unit(1 - F.array_min(ys))
    return F.when((high > left) & (low > up), box(left, up, high - left, low - up))


def crop_local(b: Column, crop: Column, width, height) -> list[Column]:
    """``x0, y0, x1, y1`` of a box in pixels of the crop."""
    x0, y0 = crop["left"] * width, crop["top"] * height
    return [b["left"] * width - x0, b["top"] * height - y0, right(b) * width - x0, bottom(b) * height - y0]


def resized(width: Column, height: Column, limit: int) -> tuple[Column, Column]:
    """Sizes of an image whose long edge is brought down to ``limit`` (half to even)."""
    scale = F.lit(float(limit)) / F.greatest(width, height)
    fit = lambda n: F.when(F.greatest(width, height) > limit, F.bround(n * scale).cast("long")).otherwise(n.cast("long"))
    return fit(width), fit(height)
