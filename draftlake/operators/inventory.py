"""What drawings hold: layers with their counts, and one summary row for each drawing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.functions.style import with_rgb
from draftlake.functions.units import with_units


def layer_info(layers: DataFrame, entities: DataFrame) -> DataFrame:
    """Each declared layer with its colour (by absolute index), whether it is visible (not frozen), and its top-level entities, hidden ones too."""
    counts = entities.groupBy("drawing_id", F.col("layer").alias("name")).agg(F.count("*").alias("n"))
    rows = layers.join(counts, ["drawing_id", "name"], "left").withColumn("_index", F.abs("color").cast("int"))
    rows = with_rgb(rows, "_index")
    return rows.select("drawing_id", "layer_seq", "name", "r", "g", "b", ((F.col("flags").bitwiseAND(1)) == 0).alias("visible"), F.coalesce("n", F.lit(0)).cast("long").alias("entity_count"))


def drawing_info(drawings: DataFrame, boxes: DataFrame, entities: DataFrame, blocks: DataFrame) -> DataFrame:
    """Units, extents, number of top-level entities, and the names of blocks that are not the drawing's own, in their order."""
    counts = entities.groupBy("drawing_id").agg(F.count("*").alias("entity_count"))
    named = blocks.where("name <> '' AND NOT startswith(name, '*')")
    names = named.groupBy("drawing_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("block_seq", "name"))), lambda s: s["name"]).alias("block_names"))
    rows = with_units(drawings).join(boxes, "drawing_id", "left").join(counts, "drawing_id", "left").join(names, "drawing_id", "left")
    return rows.select("drawing_id", "unit_name", "mm_per_unit", "min_x", "min_y", "max_x", "max_y", F.coalesce("entity_count", F.lit(0)).alias("entity_count"), F.coalesce("block_names", F.array().cast("array<string>")).alias("block_names"))
