"""Helpers that several operators share: prefix sums, joins with hot keys, names of components, column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.operators.graph import components
from draftlake.storage import discard, new_path, shared_dir, stored

__all__ = ["WORD", "apart", "components", "discard", "join_by", "new_path", "prefix_sums", "shared_dir", "smallest_of_component", "stored", "utf8_size"]

#: What separates words: the ASCII white space that bytes.split() uses too.
WORD = r"[^\x20\x09-\x0D]+"


def apart(df: DataFrame, new: list[str]) -> DataFrame:
    """df with those of its columns renamed to input_<name> that would clash with columns an operator adds."""
    taken = {c.lower() for c in df.columns}
    for c in df.columns:
        if c.lower() in {n.lower() for n in new}:
            name = f"input_{c}"
            while name.lower() in taken:
                name = f"input_{name}"
            taken.add(name.lower())
            df = df.withColumnRenamed(c, name)
    return df


def utf8_size(text: Column) -> Column:
    """Bytes of the text in UTF-8; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, index: str, value: str, keys: list[str] | None = None, block: int = 128, levels: int = 3) -> DataFrame:
    """df with `before`: the sum of `value` over the rows of smaller `index` (of the same keys).

    In levels: within blocks of consecutive indices, then over the totals of blocks in the same way; the last level's
    totals are fewer than the rows by the block's size to the power of the levels, and no other window holds more than a block.
    """
    keys = keys or []
    if levels == 0:
        over = Window.partitionBy(*keys).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("before", F.coalesce(F.sum(value).over(over), F.lit(0)).cast("long"))
    number = f"_block{levels}"
    rows = df.withColumn(number, F.floor(F.col(index) / block).cast("long"))
    inside = Window.partitionBy(*keys, number).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, number).agg(F.sum(value).alias("_total"))
    bases = prefix_sums(totals, number, "_total", keys, block, levels - 1).select(*keys, number, F.col("before").alias("_base"))
    rows = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return rows.join(bases, [*keys, number]).withColumn("before", (F.col("_base") + F.col("_inside")).cast("long")).drop(number, "_inside", "_base")


def join_by(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined with a table of one row for each key, whose column n says how many of the rows have it (dropped).

    Keys of a thousandth of all rows or more are a thousand at most: they are broadcast, so that no task gets all rows of one. The others are shuffled.
    """
    marked = table.withColumn("_hot", F.col(n) * 1000 >= table.agg(F.sum(n)).scalar()).drop(n)
    hot, others = F.broadcast(marked.where("_hot").drop("_hot")), marked.where("NOT _hot").drop("_hot")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(others, key))


def smallest_of_component(nodes: DataFrame, joined: DataFrame, name: str) -> DataFrame:
    """nodes (node, n: rows that it stands for, and a column `name`) with the smallest `name` of their component in its place.

    joined: (node, component) of the nodes that have links, as `components` gives it; a node without links keeps its own.
    """
    linked = joined.join(nodes.select("node", F.col(name).alias("_own")), "node")
    least = linked.groupBy("component").agg(F.min("_own").alias("_least"), F.count("*").alias("_n"))
    found = join_by(joined, least, "component", "_n").select("node", "_least")
    return nodes.join(found, "node", "left").withColumn(name, F.when(F.col("_least").isNotNull(), F.col("_least")).otherwise(F.col(name))).drop("_least")
