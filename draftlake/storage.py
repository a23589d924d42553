"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side table that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder if all of Spark runs on this machine; an error on a cluster,
    whose executors would each write to a disk of their own."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        context.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there: its lineage ends here, and lost executors cost no rework."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def side_table(df: DataFrame, name: str) -> DataFrame:
    """df, stored, as the side of joins that large tables need not be dealt for: broadcast up to BROADCAST_ROWS, beyond that joined as any other table."""
    kept = stored(df, name)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that `stored` made and that nothing reads any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
