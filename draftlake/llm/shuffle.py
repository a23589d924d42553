"""Sharding by a two-pass external shuffle.

Pass one scatters the records to buckets that fit in memory, by a seeded hash of id and text. Pass two gives every bucket a
Fisher-Yates shuffle and writes it. A bucket that is much larger than meant (very long texts, or rows that are equal) is
shuffled in pieces that fit in memory; a seeded hash says which piece a row is in. The buckets one after the other are the shuffled corpus; shard i of n holds its
rows from floor(i*N/n) to floor((i+1)*N/n), so that counts differ by one at most (law `rows`).

Defined cases: a null or empty text is a record of one byte (its end); equal rows share a bucket
and are each kept; rows of one doc_id are dealt by their texts, and so are rows without doc_id; a very long text is a record like any other (its bucket is larger by it); an empty table gives empty shards; clashing columns of the input
become input_<name>.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftlake.llm.common import apart, new_path, prefix_sums, utf8_size


PIECE = 4  # times bucket_bytes: what a task holds at once


def _permute(seed: int, bucket: int, piece: int, doc_ids: list, texts: list):
    """Row numbers in shuffled order; the order in which the rows arrived does not matter."""
    import numpy as np

    order = sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i] is not None, doc_ids[i], zlib.crc32((texts[i] or "").encode()), texts[i] is not None))
    np.random.default_rng([seed, bucket, piece]).shuffle(order := np.array(order, dtype="int64"))  # Fisher-Yates
    return order


def shuffle(docs: DataFrame, seed: int = 11, bucket_bytes: int = 16 << 20) -> DataFrame:
    """docs with `position`, from 0 without gaps, in shuffled order."""
    docs = apart(docs, ["position", "_bucket", "_key", "_base"])
    size = docs.agg(F.sum(utf8_size(F.col("text")) + 1)).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    keyed = docs.withColumns({"_bucket": F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(buckets)), "_key": F.xxhash64("doc_id", "text", F.lit(seed))})
    counts = keyed.groupBy("_bucket").agg(F.count("*").alias("_rows"))
    bases = prefix_sums(counts, "_bucket", "_rows").select("_bucket", F.col("before").alias("_base"))
    names = docs.columns

    def write_order(batches):
        import numpy as np
        import pyarrow as pa

        here, held, done, piece = None, [], 0, 0

        def out():
            nonlocal done, piece
            rows = pa.Table.from_batches(held)
            order = _permute(seed, here[0], piece, rows["doc_id"].to_pylist(), rows["text"].to_pylist())
            position = pa.array(here[1] + done + np.arange(len(order), dtype="int64"))
            done, piece = done + len(order), piece + 1
            held.clear()
            yield from rows.select(names).take(pa.array(order)).append_column("position", position).to_batches(max_chunksize=2000)

        for batch in batches:
            number, base = batch.column("_bucket").to_numpy(), batch.column("_base").fill_null(-1).to_numpy()
            starts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            for i, j in zip(starts, starts[1:], strict=False):
                if i == j:
                    continue
                if held and (here[0] != number[i] or sum(b.nbytes for b in held) > PIECE * bucket_bytes):
                    yield from out()
                if here is None or here[0] != number[i]:
                    here, done, piece = (int(number[i]), int(base[i])), 0, 0
                    i += 1  # the row that says where the bucket begins
                if i < j:
                    held.append(batch.slice(i, j - i))
        if held:
            yield from out()

    # a bucket's base is its first row: a join could leave the rows of a bucket in several tasks, or shuffle texts twice
    dealt = keyed.unionByName(bases, allowMissingColumns=True).repartition("_bucket").sortWithinPartitions("_bucket", F.col("_base").asc_nulls_last(), "_key")
    return dealt.mapInArrow(write_order, T.StructType([*docs.schema.fields, T.StructField("position", T.LongType())]))


def write_shards(docs: DataFrame, shards: int = 8, path: str | None = None, **options) -> str:
    """Writes the shuffled docs as Parquet, partitioned by `shard` and in order of `slot`; returns the path."""
    docs = apart(docs, ["shard", "slot"])
    path = path or new_path(docs.sparkSession, "shards")
    total = max(1, docs.count())
    rows = shuffle(docs, **options)
    shard = F.expr(f"CAST(((position + 1) * {shards} - 1) DIV {total} AS INT)")
    rows = rows.withColumn("shard", shard).withColumn("slot", F.expr(f"position - (CAST(shard AS BIGINT) * {total}) DIV {shards}")).drop("position")
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return path


def read_shards(spark, path: str, schema: T.StructType) -> DataFrame:
    docs = apart(spark.createDataFrame([], schema), ["position", "shard", "slot"]).schema
    return spark.read.schema(T.StructType([*docs.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])).parquet(path)
