"""Block expansion: where every block of every drawing stands, to ten levels of nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.functions.geometry import place
from draftlake.storage import BROADCAST_ROWS, cut_lineage, side_table, stored

MAX_DEPTH = 10
#: Instances of a drawing beyond which it is not expanded: a block that inserts itself k times has k to the tenth power.
MOST_INSTANCES = 50_000_000
IDENTITY = {"base_x": 0.0, "base_y": 0.0, "at_x": 0.0, "at_y": 0.0, "scale_x": 1.0, "scale_y": 1.0, "turn": 0.0}
#: The block name of entities that stand in the drawing itself.
TOP = ""


def latest_blocks(blocks: DataFrame) -> DataFrame:
    """One row for each (drawing_id, name): of several blocks of one name the last counts."""
    return blocks.groupBy("drawing_id", "name").agg(F.max_by(F.struct("base_x", "base_y"), "block_seq").alias("b")).select("drawing_id", "name", "b.*")


def instances(drawings: DataFrame, inserts: DataFrame, blocks: DataFrame, layers: list[str] | None = None, dimensions: str = "identity") -> DataFrame:
    """Every occurrence of a block: drawing_id, block_name, path, draw_order (the same as numbers, which sort as things are drawn), depth, base_x, base_y, at_x, at_y, scale_x, scale_y, turn, bypass.

    drawings: drawing_id. inserts: drawing_id, block_name (TOP or the block that holds it), entity_seq, type (INSERT or
    DIMENSION), layer, visible, ref_block, ins_x, ins_y, scale_x, scale_y, rot_deg. blocks: drawing_id, block_seq, name, base_x, base_y.

    The drawing itself is the instance of block TOP. Scales multiply and turns add up (this is not the composition of
    affine maps). A block that does not exist is dropped. With `layers`, an insert on another layer is not followed.
    A dimension stands at identity whatever it is nested in, and beneath it layers do not count (`bypass`); with
    dimensions="skip" it is not followed. Each level is stored; the loop ends with the first empty level. Inserts of the drawings themselves, mostly nearly
    all, meet the first level only.
    """
    usable = inserts.where("visible AND ref_block IS NOT NULL")
    if dimensions == "skip":
        usable = usable.where("type = 'INSERT'")
    known = latest_blocks(blocks).select("drawing_id", F.col("name").alias("ref_block"), F.col("base_x").alias("_bx"), F.col("base_y").alias("_by"))
    usable = usable.join(known, ["drawing_id", "ref_block"]).select("drawing_id", "block_name", "entity_seq", "type", "layer", "ref_block", "ins_x", "ins_y", F.col("scale_x").alias("_sx"), F.col("scale_y").alias("_sy"), "rot_deg", "_bx", "_by")
    usable = stored(usable, "inserts")
    top, inner = usable.where(F.col("block_name") == TOP), usable
    if blocks.where(F.col("name") == TOP).isEmpty():  # a block of that name would have the drawing's inserts
        inner = usable.where(F.col("block_name") != TOP)
    inner = F.broadcast(inner) if inner.count() <= BROADCAST_ROWS else inner
    columns = ["drawing_id", "block_name", "path", "draw_order", "depth", *IDENTITY, "bypass"]
    drawings = side_table(drawings.select("drawing_id"), "drawings")
    level = drawings.select("drawing_id", F.lit(TOP).alias("block_name"), F.lit("").alias("path"), F.array().cast("array<bigint>").alias("draw_order"), F.lit(0).alias("depth"), *[F.lit(v).alias(k) for k, v in IDENTITY.items()], F.lit(False).alias("bypass"))
    found = level
    for depth in range(MAX_DEPTH):
        rows = level.join(inner if depth else top, ["drawing_id", "block_name"])
        if layers:
            rows = rows.where(F.col("bypass") | F.col("layer").isin(layers))
        x, y = place(F.col("ins_x"), F.col("ins_y"))
        dim = F.col("type") == "DIMENSION"
        at = {"base_x": F.col("_bx"), "base_y": F.col("_by"), "at_x": x, "at_y": y, "scale_x": F.col("scale_x") * F.col("_sx"), "scale_y": F.col("scale_y") * F.col("_sy"), "turn": F.col("turn") + F.col("rot_deg")}
        level = stored(
            rows.select(
                "drawing_id",
                F.col("ref_block").alias("block_name"),
                F.concat("path", F.lit("/"), F.col("entity_seq").cast("string")).alias("path"),
                F.concat("draw_order", F.array(F.col("entity_seq").cast("long"))).alias("draw_order"),
                (F.col("depth") + 1).alias("depth"),
                *[F.when(dim, IDENTITY[k]).otherwise(v).alias(k) for k, v in at.items()],
                (F.col("bypass") | dim).alias("bypass"),
            ),
            "instances",
        )
        if level.isEmpty():
            break
        found = found.unionByName(level)
    return found.select(*columns)


def instance_counts(drawings: DataFrame, inserts: DataFrame, blocks: DataFrame, layers: list[str] | None = None, dimensions: str = "identity") -> DataFrame:
    """(drawing_id, instances: how many rows `instances` would give it, as a double) without expanding anything.

    The rows of each level are blocks with the number of ways that lead to them, not instances: at most two for each block and level (below
    dimensions layers do not count).
    """
    usable = inserts.where("visible AND ref_block IS NOT NULL")
    if dimensions == "skip":
        usable = usable.where("type = 'INSERT'")
    known = blocks.select("drawing_id", F.col("name").alias("ref_block")).distinct()
    on = F.col("layer").isin(layers) if layers else F.lit(True)
    edges = usable.join(known, ["drawing_id", "ref_block"]).groupBy("drawing_id", "block_name", "ref_block", on.alias("_on"), (F.col("type") == "DIMENSION").alias("_dim")).agg(F.count("*").cast("double").alias("_k"))
    edges = cut_lineage(edges)
    level = drawings.select("drawing_id", F.lit(TOP).alias("block_name"), F.lit(False).alias("bypass"), F.lit(1.0).alias("n"))
    found = level.select("drawing_id", "n")
    for _ in range(MAX_DEPTH):
        rows = level.join(edges, ["drawing_id", "block_name"]).where("_on OR bypass")
        level = cut_lineage(rows.groupBy("drawing_id", F.col("ref_block").alias("block_name"), (F.col("bypass") | F.col("_dim")).alias("bypass")).agg(F.sum(F.col("n") * F.col("_k")).alias("n")))
        if level.isEmpty():
            break
        found = found.unionByName(level.select("drawing_id", "n"))
    return found.groupBy("drawing_id").agg(F.sum("n").alias("instances"))


def split_large(drawings: DataFrame, inserts: DataFrame, blocks: DataFrame, most: float = MOST_INSTANCES) -> tuple[DataFrame, DataFrame]:
    """(drawings that may be expanded, rejects: drawing_id, reason) by the number of their instances."""
    counts = cut_lineage(instance_counts(drawings.select("drawing_id"), inserts, blocks))
    large = counts.where(F.col("instances") > most)
    reason = F.concat(F.lit("too many block instances: "), F.format_string("%.0f", "instances"))
    return drawings.join(large, "drawing_id", "left_anti"), large.select("drawing_id", reason.alias("reason"))


def placed(entities: DataFrame, where: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """Visible entities (drawing_id, block_name, layer, visible, ...) once for each instance of their block, with its placement."""
    own = entities.where("visible").drop("ref_block", "ins_x", "ins_y", "scale_x", "scale_y", "rot_deg")  # those of inserts
    rows = own.join(where, ["drawing_id", "block_name"])
    return rows.where(F.col("bypass") | F.col("layer").isin(layers)) if layers else rows


def split_top(entities: DataFrame, where: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(own, nested, there): visible entities that stand in the drawings themselves, with the placement that these have, and those to be `placed` at the
    instances `there`. What stands in a drawing itself, mostly nearly all, thus meets no instances. `own` is not restricted to any drawings."""
    seen = entities.where("visible")
    own = seen.where(F.col("block_name") == TOP).drop("ref_block", "ins_x", "ins_y", "scale_x", "scale_y", "rot_deg")
    own = own.withColumns({"path": F.lit(""), "draw_order": F.array().cast("array<bigint>"), **{k: F.lit(v) for k, v in IDENTITY.items()}})
    of_drawings = blocks.where(F.col("name") == TOP).isEmpty()  # a block of that name would have what stands in the drawing
    return own, seen.where(F.col("block_name") != TOP) if of_drawings else seen, where.where("depth > 0")
