"""Boxes (structs x1, y1, x2, y2; origin top left) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrove.functions.text import iou  # noqa: F401  (one definition for all)

_SIDES = ("x1", "y1", "x2", "y2")
POINTS = 72.0


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*(F.lit(v).alias(k) if not isinstance(v, Column) else v.alias(k) for k, v in zip(_SIDES, (x1, y1, x2, y2))))


def width(b: Column) -> Column:
    return b.x2 - b.x1


def height(b: Column) -> Column:
    return b.y2 - b.y1


def area(b: Column) -> Column:
    return width(b) * height(b)


def center_x(b: Column) -> Column:
    return (b.x1 + b.x2) / 2


def center_y(b: Column) -> Column:
    return (b.y1 + b.y2) / 2


def row_height(b: Column) -> Column:
    return F.greatest(F.lit(1.0), height(b))


def scaled(b: Column, fx, fy=None) -> Column:
    fy = fx if fy is None else fy
    return box(b.x1 * fx, b.y1 * fy, b.x2 * fx, b.y2 * fy)


def pixels_to_points(b: Column, dpi: Column) -> Column:
    return scaled(b, POINTS / dpi)


def points_to_pixels(b: Column, dpi: Column) -> Column:
    """Whole pixels, cut off."""
    return box(*((b[k] * dpi / POINTS).cast("int") for k in _SIDES))


def from_polygon(xs: Column, ys: Column) -> Column:
    """Box around a polygon's corners, given as two arrays."""
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def flipped(b: Column, page_h: Column) -> Column:
    """From an origin at the bottom left to one at the top left, sides in order."""
    a, c = page_h - b.y1, page_h - b.y2
    return box(F.least(b.x1, b.x2), F.least(a, c), F.greatest(b.x1, b.x2), F.greatest(a, c))


def cropped(b: Column, pad: Column, image_w: Column, image_h: Column) -> Column:
    """A pixel box with a margin, inside the image."""
    return box(F.greatest(F.lit(0), b.x1 - pad), F.greatest(F.lit(0), b.y1 - pad), F.least(image_w, b.x2 + pad), F.least(image_h, b.y2 + pad))


def _overlap(a: Column, b: Column) -> Column:
    w, h = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def share_inside(a: Column, b: Column) -> Column:
    """Share of ``a`` that lies in ``b``."""
    return _overlap(a, b) / F.greatest(F.lit(1e-9), area(a))


def overlaps(a: Column, b: Column, least: float = 0.2) -> Column:
    """The common part is at least this share of the smaller box."""
    o = _overlap(a, b)
    return (o > 0) & (o >= least * F.greatest(F.lit(1e-9), F.least(area(a), area(b))))


def x_overlap_ratio(a: Column, b: Column) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    return F.when(w <= 0, 0.0).otherwise(w / F.greatest(F.lit(1.0), F.least(width(a), width(b))))


def y_overlap(a: Column, b: Column, slop: float = 0.0) -> Column:
    return F.least(a.y2, b.y2) + slop > F.greatest(a.y1, b.y1)


def contains_center(outer: Column, b: Column, pad: float = 4.0) -> Column:
    return center_x(b).between(outer.x1 - pad, outer.x2 + pad) & center_y(b).between(outer.y1 - pad, outer.y2 + pad)


def near_figure(b: Column, figure: Column, gap: float = 15.0, share: float = 0.3) -> Column:
    """A share inside the figure, or right below it with so much of its width under it."""
    across = F.greatest(F.lit(0.0), F.least(b.x2, figure.x2) - F.greatest(b.x1, figure.x1)) >= share * F.greatest(F.lit(1e-6), width(b))
    return (share_inside(b, figure) >= share) | (across & b.y1.between(figure.y2 - 2, figure.y2 + gap))


def caption_near(caption: Column, figure: Column, gap: float = 80.0) -> Column:
    """Above or below the figure within a gap, over a common width."""
    below = caption.y1.between(figure.y2 - 5, figure.y2 + gap)
    above = (caption.y2 <= figure.y1 + 5) & (figure.y1 - caption.y2 <= gap)
    return (F.least(caption.x2, figure.x2) >= F.greatest(caption.x1, figure.x1)) & (below | above)


def caption_gap(caption: Column, figure: Column) -> Column:
    return F.greatest(F.lit(0.0), caption.y1 - figure.y2, figure.y1 - caption.y2)


def figure_fault(b: Column, page_w: Column, page_h: Column) -> Column:
    """Why a box is no figure: too_large, full_page, too_small, bad_aspect; null for a valid one."""
    w, h = width(b), height(b)
    ratio = w / F.greatest(h, F.lit(1.0))
    size = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    return (
        F.when(size > 0.6 * F.greatest(page_w * page_h, F.lit(1.0)), "too_large").when((w > 0.9 * page_w) & (h > 0.9 * page_h), "full_page")
        .when((w < 50) | (h < 50), "too_small").when((ratio < 0.15) | (ratio > 7), "bad_aspect")
    )


def is_corner_logo(b: Column, page_w: Column, page_h: Column) -> Column:
    """A small mark in a corner, or a squarish one near a side in the top or bottom band."""
    w, h = width(b), height(b)
    corner = ((b.x1 < 72) | (b.x2 > page_w - 72)) & ((b.y1 < 90) | (b.y2 > page_h - 90))
    band = (center_y(b) < 0.28 * page_h) | (center_y(b) > 0.78 * page_h)
    side = (b.x1 < 0.22 * page_w) | (b.x2 > 0.78 * page_w)
    square = (w / F.greatest(h, F.lit(1.0))).between(0.65, 1.55)
    return (w >= 8) & (h >= 8) & (((w < 100) & (h < 100) & corner) | ((w < 150) & (h < 150) & square & band & side))


def is_body_blocker(text: Column, b: Column, page_w: Column) -> Column:
    """Long or wide text that ends a paragraph, not a label inside a figure."""
    return (F.regexp_count(text, F.lit(r"\p{L}")) >= 15) | (width(b) >= 0.40 * page_w)


def crop_ok(b: Column, method: Column, image_w: Column, image_h: Column) -> Column:
    """Ten pixels each way inside the image; merged fragments also within 72 and 22 hundredths of it."""
    c = cropped(b, F.lit(0), image_w, image_h)
    fits = (height(c) <= 0.22 * image_h) & (width(c) <= 0.72 * image_w)
    return b.isNotNull() & (width(c) >= 10) & (height(c) >= 10) & ((method != "span_fragment_merge") | fits)
