"""Extents of drawings, and the drawings that have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.functions.geometry import place

#: Columns in which point-like rows carry what they cover: a centre and a reach in both axes, in block units.
BOX = ["min_x", "min_y", "max_x", "max_y"]


def reach_boxes(placed_points: DataFrame) -> DataFrame:
    """placed_points (x, y, reach and a placement) with the world box around each: reach grows with the instance's scale in x."""
    x, y = place(F.col("x"), F.col("y"))
    reach = F.coalesce(F.col("reach"), F.lit(0.0)) * F.abs("scale_x")
    rows = placed_points.withColumns({"_x": x, "_y": y, "_r": reach})
    return rows.withColumns({"min_x": F.col("_x") - F.col("_r"), "min_y": F.col("_y") - F.col("_r"), "max_x": F.col("_x") + F.col("_r"), "max_y": F.col("_y") + F.col("_r")}).drop("_x", "_y", "_r")


def points_of(entities: DataFrame) -> DataFrame:
    """The points (x, y, reach) by which each entity widens the extents, from the columns of the entities table.

    Lines have their ends; circles and arcs their centre with the radius; ellipses their centre with the major axis;
    polylines, splines and solids their points; texts and points their place. Hatches do not count.
    """
    point = lambda x, y, r=None: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), (F.lit(0.0) if r is None else r).cast("double").alias("reach"))
    each = lambda c: F.transform(c, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), F.lit(0.0).alias("reach")))
    kind = F.col("type")
    points = (
        F.when(kind == "LINE", F.array(point("x1", "y1"), point("x2", "y2")))
        .when(kind.isin("CIRCLE", "ARC"), F.array(point("cx", "cy", F.col("radius"))))
        .when(kind == "ELLIPSE", F.array(point("cx", "cy", F.hypot("major_x", "major_y"))))
        .when(kind.isin("LWPOLYLINE", "POLYLINE"), each("vertices"))
        .when(kind == "SPLINE", each("control_points"))
        .when(kind == "SOLID", each("corners"))
        .when(kind.isin("TEXT", "MTEXT", "POINT"), F.array(point("x1", "y1")))
    )
    return entities.withColumn("_p", F.explode(points)).withColumns({"x": F.col("_p.x"), "y": F.col("_p.y"), "reach": F.col("_p.reach")}).drop("_p")


def extents(boxes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The box around all boxes of a drawing (or of each group `by`); what is not a number does not count."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    return boxes.groupBy(*(by or ["drawing_id"])).agg(F.min(clean("min_x")).alias("min_x"), F.min(clean("min_y")).alias("min_y"), F.max(clean("max_x")).alias("max_x"), F.max(clean("max_y")).alias("max_y"))


def cropped(boxes: DataFrame, crops: DataFrame) -> DataFrame:
    """boxes with the view of `crops` (drawing_id, crop: "min_x,min_y,max_x,max_y") where there is one. Geometry stays as it is."""
    parts = F.split("crop", ",")
    known = crops.where(F.size(parts) == 4).select("drawing_id", *[F.expr(f"try_cast(trim(get(split(crop, ','), {i})) AS double)").alias(f"_{c}") for i, c in enumerate(BOX)])
    whole = known.where(" AND ".join(f"_{c} IS NOT NULL" for c in BOX))
    rows = boxes.join(whole, "drawing_id", "left")
    return rows.select("drawing_id", *[F.coalesce(f"_{c}", c).alias(c) for c in BOX])


def split_empty(boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): a drawing without width or without height has nothing to show."""
    good = F.coalesce((F.col("max_x") > F.col("min_x")) & (F.col("max_y") > F.col("min_y")), F.lit(False))
    return boxes.where(good), boxes.where(~good).select("drawing_id", F.lit("empty drawing or nothing to draw").alias("reason"))
