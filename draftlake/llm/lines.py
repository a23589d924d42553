"""Line dedup with two Bloom filters.

1. Every task marks the hashes of its lines (each once a document) in two filters: seen once, and seen twice. Filters are cut into segments of
   2^16 bits, of which a task sends the marked positions only; merging a segment, a bit that two tasks have seen is seen twice.
2. The merged filter of what was seen twice is broadcast. Its size follows the number of lines and ends at MOST_BITS; beyond some 10^9 lines
   more lines are suspected in vain, and the rest works as before.
3. Only lines that the filter suspects leave their documents, as 128 bits of hash: exact aggregates count their documents and choose the one
   that keeps them. Their line numbers go back to the documents, whose texts are shuffled once.

Lines are split, stripped, lower-cased and hashed by expressions; numpy sets and tests bits.

Defined cases: a null or empty text is one empty line, and a null text stays null; documents without doc_id come before all others and are told
apart by their texts, so that equal ones count once; rows of one doc_id count as one document; the document that keeps a line keeps all that it
has of it; equal rows give equal rows; a very long text is read whole, and a long line leaves it as a hash; an empty table gives no rows;
clashing columns of the input become input_<name>.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftlake.llm.common import apart, join_by, stored

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Bits of a filter for each line, bounds of its size, bits of a segment, and hashes that a task holds until it sends their positions.
BITS_A_LINE, LEAST_BITS, MOST_BITS, SEGMENT_BITS, HELD = 16, 1 << 16, 1 << 30, 16, 1 << 20
NO_ID = -(1 << 63)
UPPER, LOWER, SPACE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " \t\n\x0b\f\r"
NEW = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())]


def long_lines(text: Column, least_chars: int) -> Column:
    """array<struct<line, key>>: number and stripped text of each line that is long enough."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    bare = F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.btrim(x, F.lit(SPACE)).alias("key")))
    return F.filter(bare, lambda x: F.char_length(x.key) >= least_chars)


def keyed_lines(text: Column, least_chars: int) -> Column:
    """array<struct<line, a, b>>: number and 128 bits of hash of each line that is long enough, as lower case of A to Z."""

    def low(key: Column) -> Column:
        return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))

    lowered = F.transform(long_lines(text, least_chars), lambda x: F.struct(x.line.alias("line"), low(x.key).alias("key")))  # once for both hashes
    return F.transform(lowered, lambda x: F.struct(x.line.alias("line"), F.xxhash64(x.key).alias("a"), F.xxhash64(F.lit(1), x.key).alias("b")))


def filter_bits(lines: int) -> int:
    """The size of a filter, a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (lines * BITS_A_LINE - 1).bit_length()))


def positions(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    h = hashes.view(np.uint64)
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def marked(hashes: np.ndarray, bits: int) -> list[tuple[int, bytes, bytes]]:
    """(segment, positions seen once, positions seen twice), positions as 16-bit numbers."""
    first, second = positions(hashes, bits)
    found, counts = np.unique(np.concatenate([first, second[first != second]]), return_counts=True)
    segment, place, twice = found >> np.uint64(SEGMENT_BITS), found.astype("<u2"), counts > 1
    begin = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(found) else np.array([], int)
    return [(int(segment[i]), place[i:j][~twice[i:j]].tobytes(), place[i:j][twice[i:j]].tobytes()) for i, j in zip(begin, np.r_[begin[1:], len(found)], strict=True)]


def merged(rows):
    """(segment, bits seen twice) of marked positions (segment, once, twice) in order of segment."""
    here, once, twice = None, None, None
    for segment, single, double in rows:
        if segment != here:
            if here is not None:
                yield here, np.packbits(twice).tobytes()
            here, once, twice = segment, np.zeros(1 << SEGMENT_BITS, bool), np.zeros(1 << SEGMENT_BITS, bool)
        at = np.frombuffer(single, "<u2")
        twice[at] |= once[at]
        once[at] = True
        at = np.frombuffer(double, "<u2")
        twice[at] = once[at] = True
    if here is not None:
        yield here, np.packbits(twice).tobytes()


def suspected(hashes: np.ndarray, seen_twice: np.ndarray) -> np.ndarray:
    """Whether the filter holds both bits of each hash."""
    hit = np.ones(len(hashes), bool)
    for at in positions(hashes, len(seen_twice) * 8):
        at = at.astype(np.int64)
        hit &= (seen_twice[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return hit


def seen_twice(hashes: DataFrame, bits: int) -> np.ndarray:
    """The filter of the hashes (one column of arrays, each hash once in an array) that stand in two arrays or more: `bits` bits, packed."""

    def mark(batches):
        import pyarrow as pa

        def sent(held):
            rows = marked(np.concatenate(held), bits)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2)]], ["segment", "once", "twice"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            n += len(held[-1])
            if n >= HELD:
                yield sent(held)
                held, n = [], 0
        if n:
            yield sent(held)

    def merge(batches):
        import pyarrow as pa

        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        for segment, found in merged(rows):
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([found], pa.binary())], ["segment", "bits"])

    parts = hashes.mapInArrow(mark, "segment int, once binary, twice binary")
    whole = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, bits binary")
    out, width = np.zeros(bits >> 3, np.uint8), 1 << (SEGMENT_BITS - 3)
    for segment, found in whole.collect():  # MOST_BITS at most
        out[segment * width : (segment + 1) * width] = np.frombuffer(found, np.uint8)
    return out


def suspects(rows: DataFrame, filter_: np.ndarray) -> DataFrame:
    """rows (_id, _row, _lines) of which lines are suspected, with these lines only."""
    shared = rows.sparkSession.sparkContext.broadcast(filter_)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("_lines")
            flat = lists.flatten()
            hit = suspected(flat.field("a").to_numpy(zero_copy_only=False), shared.value)
            if not hit.any():
                continue
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))[hit]
            some, counts = np.unique(owner, return_counts=True)
            kept = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), flat.filter(pa.array(hit)))
            part = batch.select(["_id", "_row", "_lone"]).take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*part.columns, kept], ["_id", "_row", "_lone", "_lines"])

    return rows.mapInArrow(run, rows.schema)


def dropped(found: DataFrame, least_docs: int) -> DataFrame:
    """(_id, _row, _gone: line numbers) of the suspected lines that least_docs documents have and that another document keeps."""
    each = found.select("_id", "_row", "_lone", F.inline("_lines"))
    keys = each.groupBy("a", "b").agg(F.count_distinct("_id", "_lone").alias("_docs"), F.max("_id").alias("_keeper"), F.max("_lone").alias("_lone_keeper"), F.count("*").alias("_n"))
    confirmed = stored(keys.where(F.col("_docs") >= least_docs).drop("_docs"), "lines")
    keeps = (F.col("_id") == F.col("_keeper")) & ((F.col("_id") != NO_ID) | (F.col("_lone") == F.col("_lone_keeper")))
    return join_by(each, confirmed, ["a", "b"], "_n").where(~keeps).groupBy("_id", "_row").agg(F.collect_list("line").alias("_gone"))


def _cut_out(docs: DataFrame, columns: list[T.StructField]) -> DataFrame:
    names = [f.name for f in columns]

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch, texts, counts, lost, digests = whole.slice(at, 1000), [], [], [], []
                for text, gone in zip(batch.column("text").cast(pa.large_binary()), batch.column("_gone"), strict=True):
                    raw, drop = text.as_py(), set(gone.as_py() or ())
                    left = raw or b""
                    counts.append(left.count(b"\n") + 1)
                    if drop:
                        left = b"\n".join([x for i, x in enumerate(left.split(b"\n")) if i not in drop])
                    texts.append(None if raw is None else left)
                    lost.append(len(drop))
                    digests.append(hashlib.sha256(left).hexdigest())
                arrays = [pa.array(texts, pa.binary()).cast(pa.string()) if n == "text" else batch.column(n) for n in names]
                arrays += [pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names + [f.name for f in NEW])

    return docs.mapInArrow(run, T.StructType([*columns, *NEW]))


def dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """docs, their texts without lines that least_docs documents have, save in the one of largest doc_id; with n_lines (before), n_dropped and kept_sha256."""
    if least_docs < 2:
        raise ValueError("a line repeats in two documents at least")
    docs = apart(docs, [f.name for f in NEW] + ["_id", "_row", "_lone", "_lines", "_gone"])
    row = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "_row": row})
    lines = keyed_lines(F.col("text"), least_chars)
    total = docs.agg(F.sum(F.size(long_lines(F.col("text"), least_chars)))).first()[0] or 0
    filter_ = seen_twice(docs.select(F.array_distinct(F.transform(lines, lambda x: x.a)).alias("_h")), filter_bits(total))
    lone = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))
    rows = keyed.select("_id", "_row", lone.alias("_lone"), lines.alias("_lines"))  # no filter by size: it would evaluate the lines twice
    found = stored(suspects(rows, filter_), "suspects")
    gone = dropped(found, least_docs)
    return _cut_out(keyed.join(gone, ["_id", "_row"], "left"), docs.schema.fields)
