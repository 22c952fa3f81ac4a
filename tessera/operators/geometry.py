"""Rectangles (l, t, r, b), vectors and views as functions on tables and columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def L() -> Column:  # noqa: N802
    return F.col("l")


def T() -> Column:  # noqa: N802
    return F.col("t")


def R() -> Column:  # noqa: N802
    return F.col("r")


def B() -> Column:  # noqa: N802
    return F.col("b")


def contains_point(x: float, y: float, closed: bool = True) -> Column:
    """Whether a rectangle holds a point; one of whole numbers does not hold its right and lower border."""
    if closed:
        return (L() <= x) & (R() >= x) & (T() <= y) & (B() >= y)
    return (L() <= x) & (R() > x) & (T() <= y) & (B() > y)


def contains_in(left: float, top: float, right: float, bottom: float) -> Column:
    """Whether a rectangle lies whole in another one, borders included."""
    return (L() >= left) & (T() >= top) & (R() <= right) & (B() <= bottom)


def overlaps(left: float, top: float, right: float, bottom: float) -> Column:
    """Whether two rectangles have an area in common; touching borders do not count."""
    return (L() < right) & (R() > left) & (T() < bottom) & (B() > top)


def clipped(rects: DataFrame, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """The parts of rectangles that lie in another one; those that have none are left out."""
    seen = rects.where(overlaps(left, top, right, bottom))
    return seen.withColumns({"l": F.greatest(L(), F.lit(left)), "t": F.greatest(T(), F.lit(top)), "r": F.least(R(), F.lit(right)), "b": F.least(B(), F.lit(bottom))})


def grown(rects: DataFrame, x: float, y: float | None = None) -> DataFrame:
    y = x if y is None else y
    return rects.withColumns({"l": L() - x, "t": T() - y, "r": R() + x, "b": B() + y})


def centre() -> tuple[Column, Column]:
    return (L() + R()) / 2, (T() + B()) / 2


def diagonal() -> Column:
    return F.sqrt((R() - L()) * (R() - L()) + (B() - T()) * (B() - T()))


def normal(rects: DataFrame) -> DataFrame:
    """Rectangles with their borders in order."""
    return rects.withColumns({"l": F.least(L(), R()), "t": F.least(T(), B()), "r": F.greatest(L(), R()), "b": F.greatest(T(), B())})


def is_normal() -> Column:
    return (L() <= R()) & (T() <= B())


def aligned(rects: DataFrame, anchors: list[tuple[str, int, int]]) -> DataFrame:
    """The upper left corner of each rectangle for each anchor (name, halves of the width, halves of the height)."""
    table = F.array(*[F.struct(F.lit(n).alias("anchor"), F.lit(x).alias("ax"), F.lit(y).alias("ay")) for n, x, y in anchors])
    each = rects.withColumn("_a", F.explode(table)).select("*", "_a.*").drop("_a")
    return each.withColumns({"l": L() - (R() - L()) * F.col("ax") / 2, "t": T() - (B() - T()) * F.col("ay") / 2}).drop("ax", "ay")


def bounds(rects: DataFrame) -> DataFrame:
    """The rectangle around all; without any, an empty one. Rectangles with a border that is no number are passed over."""
    odd = F.isnan("l") | F.isnan("t") | F.isnan("r") | F.isnan("b")
    around = rects.where(~odd).agg(*(f(c).alias(c) for f, c in ((F.min, "l"), (F.min, "t"), (F.max, "r"), (F.max, "b"))))
    return around.select(*(F.coalesce(c, F.lit(0.0)).alias(c) for c in "ltrb"))


def middle(rects: DataFrame) -> DataFrame:
    """The mean of the rectangles' centres; without any, the origin."""
    x, y = centre()
    return rects.agg(F.coalesce(F.avg(x), F.lit(0.0)).alias("x"), F.coalesce(F.avg(y), F.lit(0.0)).alias("y"))


def rotated(x: Column, y: Column, angle: float) -> tuple[Column, Column]:
    c, s = math.cos(angle), math.sin(angle)
    return x * c - y * s, x * s + y * c


def length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def unit(x: Column, y: Column) -> tuple[Column, Column]:
    """A vector of length one; the null vector stays."""
    size = length(x, y)
    return F.when(size == 0, 0.0).otherwise(x / size), F.when(size == 0, 0.0).otherwise(y / size)


def to_world(x: Column, y: Column, scale: float, ox: float, oy: float) -> tuple[Column, Column]:
    """A point of the display in the world that a view with this scale and offset shows."""
    return (x - ox) / scale, (y - oy) / scale


def fitted(rects: DataFrame, width: float, height: float) -> DataFrame:
    """The zoom and offsets with which a display shows each rectangle whole and in its middle."""
    wide = (R() - L()) / (B() - T()) > width / height
    zoomed = rects.withColumn("zoom", F.when(wide, width / (R() - L())).otherwise(height / (B() - T())))
    x, y = centre()
    return zoomed.withColumns({"ox": width / 2 - x * F.col("zoom"), "oy": height / 2 - y * F.col("zoom")})


def moved_by(rects: DataFrame, chosen: DataFrame, key: str, dx: float, dy: float) -> DataFrame:
    """All rectangles; those whose key is in ``chosen`` are moved."""
    marked = rects.join(chosen.select(F.col(key)).distinct().withColumn("_chosen", F.lit(1)), key, "left")
    way = lambda d: F.when(F.col("_chosen").isNull(), 0.0).otherwise(d)
    return marked.withColumns({"l": L() + way(dx), "r": R() + way(dx), "t": T() + way(dy), "b": B() + way(dy)}).drop("_chosen")


def stretch(x: Column, y: Column, start_x: Column, start_y: Column, cx: float, cy: float, least: float = 1.0) -> Column:
    """By how much a drag from a start to a point makes something larger around a middle."""
    return length(x - cx, y - cy) / F.greatest(F.lit(least), length(start_x - cx, start_y - cy))


def between(start: Column, end: Column, share: Column) -> Column:
    return start + (end - start) * share
