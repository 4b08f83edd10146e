"""Boxes in points as Column predicates and expressions. A box is x, y, w, h."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import points


@dataclass(frozen=True)
class Box:
    """Names of the four columns of a box, with an optional prefix or suffix."""

    x: str = "x"
    y: str = "y"
    w: str = "w"
    h: str = "h"

    @staticmethod
    def suffixed(suffix: str) -> Box:
        return Box(*(f"{c}{suffix}" for c in "xywh"))


def overlap_x(a: Box, b: Box) -> Column:
    """Half-open on both sides: touching boxes don't overlap."""
    return (F.col(a.x) < F.col(b.x) + F.col(b.w)) & (F.col(b.x) < F.col(a.x) + F.col(a.w))


def overlap(a: Box, b: Box) -> Column:
    """Overlap on both axes."""
    return overlap_x(a, b) & (F.col(a.y) < F.col(b.y) + F.col(b.h)) & (F.col(b.y) < F.col(a.y) + F.col(a.h))


def polygon_box(command: Column) -> Column:
    """Struct x, y, w, h around the points of a draw command; null without points.

    Coordinates are unsigned inches: a point with a negative one is no match and is left out (G1).
    """
    pattern = r"svg:x: ([0-9.]+in), svg:y: ([0-9.]+in)"
    xs, ys = (F.filter(F.transform(F.regexp_extract_all(command, F.lit(pattern), F.lit(k)), points), lambda v: v.isNotNull()) for k in (1, 2))
    box = F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))
    return F.when((F.size(xs) > 0) & (F.size(ys) > 0), box)


# The thresholds of the predicates and the band below, in points and in shares of a page.


def is_figure(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    """Large enough to wrap text around: no rule, logo or footer decoration."""
    logo = (y < 80) & (w < page_w * 0.45) & (h < 90)
    return (w * h >= page_w * page_h * 0.08) & (h >= 8) & ~logo & ~(y > page_h - 90)


def is_footer(y: Column, w: Column, h: Column, page_h: Column) -> Column:
    """In the lowest part of the page, wide and low."""
    return (y > page_h - 90) & (w >= 70) & (h <= 80)


def is_full_page(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, within: float = 2.0) -> Column:
    """Within a tolerance of the page's box."""
    return (F.abs(x) <= within) & (F.abs(y) <= within) & (F.abs(w - page_w) <= within) & (F.abs(h - page_h) <= within)


def x_band(x: Column, width: float = 12.0) -> Column:
    """Number of the band nearest to x; halves go up, also below zero."""
    return F.floor(x / width + 0.5)
