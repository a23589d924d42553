"""Embedding near-duplicates by product quantisation.

Vectors of unit length go to coarse inverted lists; what is left of each after its list's centre is coded by
subspace. Every vector searches the lists of its nearest centres. Inside a list, table lookups give the exact distance
from the searching vector to the decoded ones; since a decoded vector lies at a known distance from the vector itself, the
triangle inequality says which of them can be near enough, and no near one is lost. The exact cosine, in double
precision, decides. A pair counts if either of its vectors searches the other's list.

Vectors of each length have an index of their own, fitted to a bounded sample (SAMPLE rows of smallest hash in all, LEAST_SAMPLE of a
length at least); every row is indexed and every row searches. Lists grow with the root of the rows, to MOST_LISTS; many
lists are found in two levels, so that fitting and assigning cost little more. Equal vectors are one class from the start,
known by 128 bits of hash. Lists larger than LIST_ROWS are split, and so are their searchers, so that no task holds a whole hot
list; a task gives counts and a spanning forest of its links, not pairs.

Defined cases: vectors that are null, empty or zero, or that hold null or non-finite components link with nothing; a row without
vec_id links and counts like any other, but never names a component, so that one of such rows alone has none (null), and is not kept; vectors of different lengths do not link; components may be as large or small as doubles
go, as a vector is divided by its largest one first; equal rows each get a row, and so do rows of one vec_id; ties do not
arise, as no order decides; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import components, discard, join_by, smallest_of_component, stored

SAMPLE, LEAST_SAMPLE = 32_768, 256
MOST_LISTS = 8192
LIST_ROWS = 4096


@dataclass(frozen=True)
class Index:
    centres: np.ndarray  # lists x dimensions
    books: np.ndarray  # subspaces x codes x dimensions of one
    probes: int

    def __post_init__(self):
        assert self.centres.shape[1] == self.books.shape[0] * self.books.shape[2]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = _nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, a, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def lists_for(rows: int) -> int:
    """About as many lists as the root of the rows."""
    return int(min(MOST_LISTS, max(1, rows**0.5)))


def _centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of x; many are found in two levels: centres of the parts of a coarser division, in proportion to their rows."""
    if k <= 256:
        return _kmeans(x, k, rng)
    coarse = _kmeans(x, int(k**0.5), rng)
    part = _nearest(x, coarse)
    own = [x[part == i] for i in range(len(coarse))]
    return np.concatenate([_kmeans(rows, max(1, round(k * len(rows) / len(x))), rng) for rows in own if len(rows)])


def fit(sample: np.ndarray, lists: int, probes: int = 16, codes: int = 64, seed: int = 5) -> Index:
    """An index of so many lists (no more than a quarter of the sample, or one) from a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    centres = _centres(sample, min(lists, max(1, len(sample) // 4)), rng)
    rest = sample - centres[_nearest(sample, centres)]
    parts = max(p for p in (8, 4, 2, 1) if dims % p == 0)
    books = [_kmeans(rest[:, i : i + dims // parts], codes, rng) for i in range(0, dims, dims // parts)]
    return Index(centres, np.stack(books), min(probes, len(centres)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; the largest component goes first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    """An Arrow list column without nulls, whose lists are of one length."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def encode(x: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lists to search, own one first; codes of the residual; distance to the decoded vector)."""
    distance = (index.centres**2).sum(axis=1) - 2 * x @ index.centres.T
    if index.probes < len(index.centres):
        some = np.argpartition(distance, index.probes - 1, axis=1)[:, : index.probes]
    else:
        some = np.broadcast_to(np.arange(len(index.centres)), distance.shape)
    order = np.take_along_axis(distance, some, axis=1).argsort(axis=1, kind="stable")
    near = np.take_along_axis(some, order, axis=1)
    rest = x - index.centres[near[:, 0]]
    width = index.books.shape[2]
    codes = np.stack([_nearest(rest[:, i * width : (i + 1) * width], b) for i, b in enumerate(index.books)], axis=1).astype(np.uint8)
    decoded = np.concatenate([b[codes[:, i]] for i, b in enumerate(index.books)], axis=1)
    return near.astype(np.int32), codes, np.sqrt(((rest - decoded) ** 2).sum(axis=1))


def search(own: int, members: dict, searchers: dict, index: Index, cosine: float):
    """(counts of the searchers, counts of the members, edges as positions) in one part of one list.

    Members and searchers: node, size, x, near, and of members codes and error. A member is counted too when it does not search
    the list of the searcher, for then it will not find the pair itself.
    """
    count_s, count_m = np.zeros(len(searchers["node"]), np.int64), np.zeros(len(members["node"]), np.int64)
    parent = {}
    edges = []

    def find(a):
        while parent.setdefault(a, a) != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    width = index.books.shape[2]
    reach = np.sqrt(2 - 2 * cosine) + members["error"] + 1e-9
    for i in range(0, len(count_s), 128):
        x = searchers["x"][i : i + 128]
        rest = x - index.centres[own]
        distance = np.zeros((len(x), len(count_m)))
        for k, book in enumerate(index.books):
            table = ((rest[:, None, k * width : (k + 1) * width] - book[None]) ** 2).sum(axis=2)
            distance += table[:, members["codes"][:, k]]
        q, m = np.nonzero(distance <= reach**2)
        for j in range(0, len(q), 1 << 15):
            a, b = q[j : j + (1 << 15)], m[j : j + (1 << 15)]
            ok = np.einsum("ij,ij->i", x[a], members["x"][b]) >= cosine
            a, b = a[ok] + i, b[ok]
            other = searchers["node"][a] != members["node"][b]
            a, b = a[other], b[other]
            np.add.at(count_s, a, members["size"][b])
            unseen = (members["near"][b] != searchers["near"][a, 0][:, None]).all(axis=1)
            np.add.at(count_m, b[unseen], searchers["size"][a[unseen]])
            for s, t in zip(searchers["node"][a].tolist(), members["node"][b].tolist(), strict=True):
                p, r = find(s), find(t)
                if p != r:
                    parent[p] = r
                    edges.append((s, t))
    return count_s, count_m, edges


def _indexes(rows: DataFrame, probes: int, lists: int | None) -> dict[int, Index]:
    """An index for each length of the vectors (embedding)."""
    lengths = {r[0]: r[1] for r in rows.groupBy(F.size("embedding")).count().collect()}  # one row for each length
    found = {}
    for dims, n in lengths.items():
        some = max(LEAST_SAMPLE, SAMPLE * n // sum(lengths.values()))
        sample = rows.where(F.size("embedding") == dims).orderBy(F.xxhash64("embedding"), "node").limit(some).select("embedding").toArrow()  # bounded
        found[dims] = fit(unit(_matrix(sample["embedding"].combine_chunks())), lists or lists_for(n), probes)
    return found


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, probes: int = 16, list_rows: int = LIST_ROWS, lists: int | None = None) -> DataFrame:
    """(vec_id, n_links: other vectors linked directly, component_id, kept) for every row of vectors (vec_id, embedding)."""
    spark, v = vectors.sparkSession, F.col("embedding")
    broken = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = v.isNotNull() & ~broken & F.exists("embedding", lambda c: c != 0)
    rows = vectors.select("vec_id", F.transform("embedding", lambda c: c.cast("double") + 0.0).alias("embedding"))
    rows = rows.withColumn("key", F.when(F.coalesce(whole, F.lit(False)), F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b"))))
    rows = stored(rows, "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("component_id"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    shared = spark.sparkContext.broadcast(_indexes(classes, probes, lists))  # MOST_LISTS centres and 64 codes at most, for each length

    def add_codes(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column("embedding")
            sizes = column.value_lengths().to_numpy()
            for dims in np.unique(sizes).tolist():
                at = pa.array(np.flatnonzero(sizes == dims))
                x = unit(_matrix(column.take(at)))
                near, codes, error = encode(x, shared.value[dims])
                columns = [batch.column("node").take(at), batch.column("n").take(at), pa.array(np.full(len(x), dims, np.int32)), pa.array(list(x), pa.list_(pa.float64()))]
                columns += [pa.array(list(near), pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "size", "dims", "x", "near", "codes", "error"])

    schema = "node long, size long, dims int, x array<double>, near array<int>, codes binary, error double"
    coded = stored(classes.select("embedding", "node", "n").mapInArrow(add_codes, schema), "codes")
    own, asked = coded.withColumn("list", F.element_at("near", 1)), coded.withColumn("list", F.explode("near"))
    split = lambda df, name: df.groupBy("dims", "list").agg(F.ceil(F.count("*") / list_rows).cast("int").alias(name))
    parts = F.broadcast(split(own, "member_parts").join(split(asked, "search_parts"), ["dims", "list"]))  # a row for each list
    spread = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    groups, columns = ["dims", "list", "m", "s"], ["node", "size", "x", "near"]
    members = own.join(parts, ["dims", "list"]).withColumn("m", spread(1, F.col("member_parts"))).withColumn("s", every(F.col("search_parts")))
    searchers = asked.join(parts, ["dims", "list"]).withColumn("s", spread(2, F.col("search_parts"))).withColumn("m", every(F.col("member_parts")))

    def find(key, mine, theirs):
        import pyarrow as pa

        def read(t):
            near = np.asarray(t["near"].combine_chunks().flatten()).reshape(t.num_rows, -1)
            return {"node": t["node"].to_numpy(), "size": t["size"].to_numpy(), "x": _matrix(t["x"].combine_chunks()), "near": near}

        none = pa.Table.from_pydict({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        if not mine.num_rows or not theirs.num_rows:
            return none
        codes = np.frombuffer(b"".join(mine["codes"].to_pylist()), np.uint8).reshape(mine.num_rows, -1)
        members, searchers = read(mine) | {"codes": codes, "error": mine["error"].to_numpy()}, read(theirs)
        count_s, count_m, edges = search(key[1].as_py(), members, searchers, shared.value[key[0].as_py()], cosine)
        node = np.r_[searchers["node"][count_s > 0], members["node"][count_m > 0]]
        n = np.r_[count_s[count_s > 0], count_m[count_m > 0]]
        a, b = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
        return pa.Table.from_pydict({"node": pa.array(np.r_[node, a]), "links": pa.array(np.r_[n, np.zeros(len(a), np.int64)]), "other": pa.array(np.r_[node, b])})

    searchers = searchers.select(*[F.col(c).alias(c) for c in [*groups, *columns]])  # columns of their own: both sides come from one table
    met = members.select(*groups, *columns, "codes", "error").groupBy(*groups).cogroup(searchers.groupBy(*groups))
    found = stored(met.applyInArrow(find, "node long, links long, other long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    nodes = smallest_of_component(classes.select("node", "key", "n", "component_id"), joined, "component_id").join(counts, "node", "left")
    named = nodes.select("key", "n", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    named = stored(named, "named")
    discard(coded, found)
    linked = join_by(rows.where("key IS NOT NULL").select("vec_id", "key"), named, "key", "n").select("vec_id", "n_links", "component_id")
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
