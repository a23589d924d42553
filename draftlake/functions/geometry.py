"""Plane geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def place(x: Column, y: Column, at: str = "") -> tuple[Column, Column]:
    """A block's point in the world: less the base, scaled, turned (if by more than 0.001 degrees), moved.

    The instance is in columns base_x, base_y, at_x, at_y, scale_x, scale_y, turn after the prefix `at`.
    """
    c = lambda n: F.col(f"{at}{n}")
    dx, dy = (x - c("base_x")) * c("scale_x"), (y - c("base_y")) * c("scale_y")
    angle = F.radians(c("turn"))
    turned = F.abs(c("turn")) > 0.001
    wx = F.when(turned, dx * F.cos(angle) - dy * F.sin(angle)).otherwise(dx)
    wy = F.when(turned, dx * F.sin(angle) + dy * F.cos(angle)).otherwise(dy)
    return wx + c("at_x"), wy + c("at_y")


def orientation(dx: Column, dy: Column) -> Column:
    """The direction of a line in degrees, folded to [0, 180)."""
    a = F.degrees(F.atan2(dy, dx))
    a = F.when(a < 0, a + 180).otherwise(a)
    return F.when(a >= 180, a - 180).otherwise(a)


def turn_between(a: Column, b: Column) -> Column:
    """The smaller angle between two orientations."""
    d = F.abs(a - b)
    return F.when(d > 90, 180 - d).otherwise(d)


def nearest(v: Column) -> Column:
    """The nearest whole number as a double, halves away from zero: what F.round gives, which goes through decimal text for every value."""
    r = F.rint(v) + F.lit(0.0)  # halves to the even number, and no negative zero; v - r is exact
    return F.when((v > 0) & (v - r == 0.5), r + 1).when((v < 0) & (v - r == -0.5), r - 1).otherwise(r)


def round6(v: Column) -> Column:
    """To six places, halves away from zero."""
    return nearest(v * 1e6) / 1e6
