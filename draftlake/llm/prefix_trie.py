"""The trie of conversation prefixes, from padded matrices of turn ids.

1. A turn's id is 128 bits of digest of its role and text; texts go no further. A conversation's ids in order, joined, are its path: bytes
   that sort like the sequence, a prefix before what goes on from it.
2. Paths are dealt to shards by range, with the conversation's id as the last key, so that thousands of equal paths spread over shards, and
   sorted there. Blocks of CELLS cells at most become padded matrices of turn numbers: numpy's lexsort orders the rows; going from column
   to column, the mask of rows that differ from the row before is or-ed with that column's changes, and marks where nodes start;
   reduceat aggregates rows to nodes at every depth. From the deepest nodes up, children add to their parents.
3. Nodes on the path of a block's first or last row may go on in a neighbour. They leave the block as two paths with partial aggregates. The
   paths of all blocks, two for each CELLS cells, make one more matrix, in which the same function sums partial aggregates.
   Conversations that end in such a node leave blocks as joined ids, which are digested in order as one stream.

Defined cases: rows of one turn number stand in the order of their ids; rows without conv_id belong to no conversation and make no node; a null
role or text is empty; repeated rows are turns of their own; a conversation whose base is missing begins with its own turns, and may have none, which
makes it a member of the root only; turns of any length count whole; the ids of one conversation (16 bytes a turn) fit a task; an empty table has
no nodes, not even the root; only conv_id, turn, role and text are read, so that other columns may have any name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import join_by, stored

GROUP, HEADS = 100, 6
#: Cells of a matrix, and ids that are joined at a time.
CELLS, CHUNK = 1 << 21, 1 << 16
WIDTH, NO_ENDS, FAR = 16, hashlib.sha256(b"").hexdigest(), (1 << 63) - 1
SUMS = ("n", "children", "leaves", "saved")


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (turn, id, chars) in order) of every conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    ident = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", ident.alias("id"), F.char_length(text).alias("chars")).alias("_t"))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    dealt = rows.withColumn("_base", base).repartition("_base")  # conversations of a base are together, for both steps that follow
    return dealt.groupBy("_base", "conv_id").agg(F.array_sort(F.collect_list("_t")).alias("turns"))


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """(conv_id, path: ids of all turns, chars of each): every conversation with its base's first turns before those of its own that follow."""
    own = sequences(turns)
    bases = own.where("conv_id = _base").select("_base", F.slice("turns", 1, heads - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = F.when(h > 0, F.slice(F.coalesce("_head", F.array().cast(own.schema["turns"].dataType)), 1, F.greatest(h, F.lit(1)))).otherwise(F.array().cast(own.schema["turns"].dataType))
    all_turns = F.concat(head, F.slice("turns", h + 1, F.size("turns")))
    path = F.unhex(F.array_join(F.transform("_all", lambda t: t.id), ""))
    return own.join(bases, "_base", "left").select("conv_id", all_turns.alias("_all")).select("conv_id", path.alias("path"), F.transform("_all", lambda t: t.chars).alias("chars"))


@dataclass
class Paths:
    """Sequences and what each brings to the nodes on its path: single values, or a value for each depth from 0 on."""

    path: list[bytes]
    chars: list[np.ndarray]
    least: list
    weights: dict[str, list] = field(default_factory=dict)
    order: np.ndarray | None = None

    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of turns, -1 beyond a path's end; lengths), rows sorted."""
        sizes = np.array([len(p) // WIDTH for p in self.path], np.int64)
        flat = np.frombuffer(b"".join(self.path), np.dtype([("a", ">u8"), ("b", ">u8")]))
        a, b = flat["a"].astype(np.uint64), flat["b"].astype(np.uint64)
        by = np.lexsort((b, a))
        new = np.r_[True, (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1])] if len(by) else np.zeros(0, bool)
        numbers = np.empty(len(by), np.int32)
        numbers[by] = np.cumsum(new) - 1
        matrix = self.padded(numbers, sizes, -1, np.int32)
        order = self.order if self.order is not None else np.zeros(len(sizes), np.int64)
        rows = np.lexsort((order, *matrix.T[::-1]))
        return matrix, sizes, rows

    @staticmethod
    def padded(flat: np.ndarray, sizes: np.ndarray, fill, dtype) -> np.ndarray:
        out = np.full((len(sizes), int(sizes.max(initial=0))), fill, dtype)
        out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
        return out


@dataclass
class Depth:
    """The nodes of one depth: a row of each, its parent's number among those one depth higher, and aggregates."""

    row: np.ndarray
    parent: np.ndarray
    chars: np.ndarray
    least: np.ndarray
    sums: dict[str, np.ndarray]
    open: np.ndarray
    ends: dict[int, list[int]]


def depths(paths: Paths, closed: bool) -> tuple[list[Depth], int, int]:
    """The nodes of the paths, depth by depth, and the numbers of the first and the last path. Unless `closed`, nodes that hold the first or
    the last path are open: their children that are not open have been added to them, and they to nothing."""
    matrix, sizes, rows = paths.matrix()
    chars = Paths.padded(np.concatenate([*paths.chars, np.zeros(0, np.int64)]), sizes, 0, np.int64)[rows]
    matrix, sizes = matrix[rows], sizes[rows]
    ids = [paths.least[i] for i in rows] if paths.weights else np.array(paths.least, np.int64)[rows]
    first, last = 0, len(rows) - 1
    live, node = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    out: list[Depth] = []

    def values(name: str, d: int) -> np.ndarray:
        if name in paths.weights:
            return np.array([paths.weights[name][rows[r]][d] for r in live], np.int64)
        return np.full(len(live), 1 if name == "n" else 0, np.int64)

    for d in range(matrix.shape[1] + 1):
        if d:
            stay = sizes[live] >= d
            live, node = live[stay], node[stay]
            column = matrix[live, d - 1]
            change = np.r_[True, (node[1:] != node[:-1]) | (column[1:] != column[:-1])]  # the mask so far, or-ed with this column's changes
        else:
            change = np.arange(len(live)) == 0
        starts = np.flatnonzero(change)
        parent, node = node[starts], np.cumsum(change) - 1
        least = np.array([ids[r][d] for r in live], np.int64) if paths.weights else ids[live]
        ends: dict[int, list[int]] = {}
        if not paths.weights:
            last_here = np.flatnonzero(sizes[live] == d)
            for i, k in zip(last_here.tolist(), node[last_here].tolist(), strict=True):
                ends.setdefault(k, []).append(int(ids[live[i]]))
        is_open = np.zeros(len(starts), bool)
        if not closed:
            for end in (first, last):
                if sizes[end] >= d:
                    is_open[node[np.searchsorted(live, end)]] = True
        sums = {name: np.add.reduceat(values(name, d), starts) for name in SUMS}
        out.append(Depth(rows[live[starts]], parent, chars[live[starts], d - 1] if d else np.zeros(len(starts), np.int64), np.minimum.reduceat(least, starts), sums, is_open, ends))
    for d in range(len(out) - 1, -1, -1):
        here, s = out[d], out[d].sums
        done = ~here.open
        s["leaves"] = np.where(done & (s["children"] == 0), 1, s["leaves"])
        s["saved"] = np.where(done, s["saved"] + (s["n"] - 1) * here.chars, s["saved"])
        if d:
            above = out[d - 1].sums
            for name, add in (("children", np.ones(len(done), np.int64)), ("leaves", s["leaves"]), ("saved", s["saved"])):
                np.add.at(above[name], here.parent[done], add[done])
    return out, int(rows[first]), int(rows[last])


def digest_ids(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def key_of(path: bytes, depth: int) -> bytes:
    """Names a node by its path."""
    return hashlib.blake2b(path[: depth * WIDTH], digest_size=16).digest()


NODE = "conv_id long, depth long, parent_conv_id long, parent_key binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SHARD = f"{NODE}, path binary, chars array<int>, least array<long>, {', '.join(f'{n} array<long>' for n in SUMS)}, ends_key binary, ends_first long, ends string"


def block_rows(paths: Paths):
    """What a block sends on: its closed nodes, two paths with the aggregates of open ones, and the conversations that end in these."""
    found, first, last = depths(paths, closed=False)
    sums = {end: {name: [] for name in ("least", *SUMS)} for end in (first, last)}
    for d, here in enumerate(found):
        numbers = np.flatnonzero(~here.open).tolist()
        columns = [here.sums[n].tolist() for n in SUMS]
        for k in numbers:
            up = int(here.parent[k])
            above = found[d - 1]
            known = not above.open[up]
            yield {
                "conv_id": int(here.least[k]), "depth": d, "parent_conv_id": int(above.least[up]) if known else None, "parent_key": None if known else key_of(paths.path[here.row[k]], d - 1),
                "n_convs": columns[0][k], "n_children": columns[1][k], "n_leaves": columns[2][k], "saved_tokens": columns[3][k], "ends_sha256": digest_ids(here.ends[k]) if k in here.ends else NO_ENDS,
            }
        for k in np.flatnonzero(here.open).tolist():
            path = paths.path[here.row[k]]
            told = False
            for end in dict.fromkeys((first, last)):
                if len(paths.path[end]) >= d * WIDTH and paths.path[end][: d * WIDTH] == path[: d * WIDTH]:
                    sums[end]["least"].append(int(here.least[k]) if not told else FAR)
                    for name in SUMS:
                        sums[end][name].append(int(here.sums[name][k]) if not told else 0)
                    told = True
            ids = here.ends.get(k, [])
            for i in range(0, len(ids), CHUNK):
                yield {"ends_key": key_of(path, d), "ends_first": ids[i], "ends": ",".join(map(str, ids[i : i + CHUNK]))}
    for end, columns in sums.items():
        yield {"path": paths.path[end], "chars": paths.chars[end].tolist(), **columns}


def batches_of(rows, schema, size: int = 5000):
    """Arrow batches of dictionaries."""
    import pyarrow as pa

    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _shards(spark, paths: DataFrame, cells: int) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(SHARD)

    def run(batches):
        schema = to_arrow_schema(kind)
        held, width = ([], [], []), 0

        def sent():
            return batches_of(block_rows(Paths(held[0], held[1], held[2], order=np.array(held[2]))), schema)

        for batch in batches:
            for path, chars, conv in zip(batch.column("path").to_pylist(), batch.column("chars"), batch.column("conv_id").to_pylist(), strict=True):
                wide = max(width, len(path) // WIDTH, 1)
                if held[0] and wide * (len(held[0]) + 1) > cells:
                    yield from sent()
                    held, wide = ([], [], []), max(len(path) // WIDTH, 1)
                width = wide
                for column, value in zip(held, (path, chars.values.to_numpy(zero_copy_only=False).astype(np.int64), conv), strict=True):
                    column.append(value)
        if held[0]:
            yield from sent()

    return paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(run, kind)


def _recombined(parts: DataFrame) -> DataFrame:
    """(key and NODE without ends_sha256) of the nodes of the paths that blocks sent: two for each block, in one matrix."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string("key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")

    def run(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        paths = Paths([r["path"] for r in rows], [np.array(r["chars"], np.int64) for r in rows], [r["least"] for r in rows], {n: [r[n] for r in rows] for n in SUMS})
        found, _, _ = depths(paths, closed=True)

        def nodes():
            for d, here in enumerate(found):
                for k in range(len(here.row)):
                    s = [int(here.sums[n][k]) for n in SUMS]
                    yield {
                        "key": key_of(paths.path[here.row[k]], d), "conv_id": int(here.least[k]), "depth": d, "parent_conv_id": int(found[d - 1].least[here.parent[k]]) if d else None,
                        "n_convs": s[0], "n_children": s[1], "n_leaves": s[2], "saved_tokens": s[3],
                    }

        yield from batches_of(nodes(), to_arrow_schema(kind))

    return parts.select("path", "chars", "least", *SUMS).repartition(1).mapInArrow(run, kind)


def _ends(chunks: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the joined ids of a node, which come in order and are held a chunk at a time."""

    def run(batches):
        import pyarrow as pa

        here, digest = None, None
        for batch in batches:
            out = []
            for key, ids in zip(batch.column("ends_key").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if key != here:
                    if here is not None:
                        out.append((here, digest.hexdigest()))
                    here, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([x for _, x in out], pa.string())], ["key", "ends_sha256"])
        if here is not None:
            yield pa.RecordBatch.from_arrays([pa.array([here], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["key", "ends_sha256"])

    dealt = chunks.select("ends_key", "ends_first", "ends").repartition("ends_key").sortWithinPartitions("ends_key", "ends_first")
    return dealt.mapInArrow(run, "key binary, ends_sha256 string")


def nodes(turns: DataFrame, cells: int = CELLS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node of the rebuilt conversations."""
    spark = turns.sparkSession
    parts = stored(_shards(spark, rebuilt(turns), cells), "trie")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = stored(_recombined(parts.where("path IS NOT NULL")), "boundaries")
    ended = top.join(_ends(parts.where("ends_key IS NOT NULL")), "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    inside = parts.where("depth IS NOT NULL")
    names = top.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent"), F.col("n_children").alias("_n"))
    hung = join_by(inside.where("parent_key IS NOT NULL").drop("parent_conv_id"), names, "parent_key", "_n").withColumnRenamed("_parent", "parent_conv_id")
    return ended.select(columns).unionByName(inside.where("parent_key IS NULL").select(columns)).unionByName(hung.select(columns))
