"""SimHash near-duplicates, found by BK-trees.

Equal fingerprints are one class from the start. Two fingerprints within the radius differ in at most that many of
`blocks` blocks of bits, so they agree on some blocks - radius of them: every choice of that many blocks is one shard
key. Each shard (one choice and one value) is a BK-tree, in which children hang at their Hamming distance from the
parent and a search follows only the edges within the radius. A tree over all documents has no proven bound on its
size, so trees go to their shard's rows instead of being broadcast. A shard gives a spanning forest of its links, at
most one edge for each fingerprint, never all pairs; the forests are joined by connected components.

Defined cases: text without words (null, empty, white space) has fingerprint zero and links like any other; a very long
text is read whole, its shingles some thousands at a time; equal rows each get a row; rows without doc_id link too but never
name a component unless all of it lacks one; an empty table gives no rows; only doc_id and text are read, so that other columns
may have any name.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.llm.common import components, discard, join_by, smallest_of_component, stored

RADIUS = 4
#: With six blocks, shard keys are pairs of blocks of 10 or 11 bits, two million values for each of 15 choices. More blocks, and longer
#: keys, are taken where a key would have more fingerprints than SHARD_ROWS on average.
LEAST_BLOCKS, SHARD_ROWS = 6, 500
#: near_copies: the trees' radius (at Jaccard 0.8 the mean distance is 9.7, its deviation 2.9), bands, and MinHashes in each: at 0.8, 0.02 % of pairs share none.
WIDE_RADIUS, BANDS, BAND_ROWS = 22, 28, 6
#: near_copies: counters of the shingles' frequencies, which only set the order of prefixes (16 MB, broadcast).
SLOTS = 1 << 22


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64 bits, each set if it is set in over half the XXH64 of the shingles (repeats count)."""
    import numpy as np
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return digest(b" ".join(found), seed)
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1
    ends = np.cumsum(sizes) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(found) - words + 1].tolist()
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)], dtype=np.uint64)
    bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        bits += np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fingerprint as a signed long)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = [fingerprint(t.as_py(), words) for t in batch.column("text")]
            signed = [x - (1 << 64) if x >> 63 else x for x in values]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed, pa.int64())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint long")


class BKTree:
    """Integers by Hamming distance."""

    def __init__(self, radius: int):
        self.radius, self.root = radius, None

    def near(self, x: int) -> list[int]:
        """What the tree holds within the radius of x: only the edges that the triangle inequality allows are followed."""
        found, radius, todo = [], self.radius, [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            d = (value ^ x).bit_count()
            if d <= radius:
                found.append(value)
            for k, child in children.items():
                if d - radius <= k <= d + radius:
                    todo.append(child)
        return found

    def insert(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        value, children = self.root
        while (d := (value ^ x).bit_count()) in children:
            value, children = children[d]
        if d:
            children[d] = (x, {})

    def add(self, x: int) -> list[int]:
        """Adds x; returns what the tree already held within the radius of it."""
        near = self.near(x)
        self.insert(x)
        return near


class Links:
    """A spanning forest of the links within `radius` between the values added, all of one shard.

    The tree holds pivots. A value within half the radius of a pivot is in its ball, linked to it, and so to all of its ball. Other
    balls are near enough only if their pivots are within the radius and a half; those of the value's own component need no look,
    so many values near each other cost a search among few pivots each and not all their pairs.
    """

    def __init__(self, radius: int):
        self.radius, self.half = radius, radius // 2
        self.tree, self.balls, self.parent = BKTree(radius + self.half), {}, {}

    def find(self, p: int) -> int:
        while self.parent[p] != p:
            self.parent[p] = self.parent[self.parent[p]]
            p = self.parent[p]
        return p

    def add(self, x: int):
        """Yields the new links of x."""
        near = sorted(self.tree.near(x), key=lambda p: (p ^ x).bit_count())
        if near and (near[0] ^ x).bit_count() <= self.half:
            own = near[0]
            if own == x:
                return
            self.balls[own].append(x)
            yield x, own
        else:
            own = x
            self.tree.insert(x)
            self.balls[x], self.parent[x] = [x], x
        for p in near:
            if self.find(p) != self.find(own):
                y = next((y for y in self.balls[p] if (y ^ x).bit_count() <= self.radius), None)
                if y is not None:
                    self.parent[self.find(p)] = self.find(own)
                    yield x, y


def masks(blocks: int, radius: int) -> list[int]:
    """The bits of each shard key."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def shard_links(rows, radius: int):
    """rows: Arrow batches of (shard, key, fingerprint) in order of shard and key. Yields edges of spanning forests."""
    import numpy as np
    import pyarrow as pa

    found, here, mask64 = None, None, (1 << 64) - 1
    for batch in rows:
        shard, key, prints = (batch.column(i).to_numpy() for i in range(3))
        starts = np.r_[0, np.flatnonzero((shard[1:] != shard[:-1]) | (key[1:] != key[:-1])) + 1, len(shard)]
        a, b = [], []
        for i, j in zip(starts, starts[1:], strict=False):
            if i == j:
                continue
            if here != (shard[i], key[i]):
                here, found = (shard[i], key[i]), None
                if j - i == 1 and j < len(shard):
                    continue
            if found is None:
                found = Links(radius)
            for x in prints[i:j].tolist():
                for v, w in found.add(x & mask64):
                    a.append(v - (1 << 64) if v >> 63 else v)
                    b.append(w - (1 << 64) if w >> 63 else w)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = LEAST_BLOCKS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all that lie within the radius."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(blocks, radius)]
    key = lambda i, m: F.struct(F.lit(i).alias("shard"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key"))
    keyed = prints.select(F.explode(F.array(*[key(i, m) for i, m in enumerate(signed)])).alias("k"), "fingerprint").select("k.shard", "k.key", "fingerprint")
    dealt = keyed.repartition("shard", "key").sortWithinPartitions("shard", "key", "fingerprint")
    return dealt.mapInArrow(lambda it: shard_links(it, radius), "a long, b long")


def blocks_for(prints: int, radius: int = RADIUS) -> int:
    """The fewest blocks, LEAST_BLOCKS or more, of which a shard key's bits leave SHARD_ROWS fingerprints to a key, were they spread evenly."""
    return next((b for b in range(max(LEAST_BLOCKS, radius + 1), 16) if prints <= SHARD_ROWS << (b - radius) * 64 // b), 16)


def classes(docs: DataFrame, words: int = 4, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(doc_id, fingerprint: long, component_id: the smallest doc_id that links reach) for every row of docs."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")), "classes")
    joined = components(links(distinct, radius, blocks or blocks_for(distinct.count(), radius)))
    nodes = distinct.select(F.col("fingerprint").alias("node"), "component_id", "n")
    named = stored(smallest_of_component(nodes, joined, "component_id").withColumnRenamed("node", "fingerprint"), "components")
    return join_by(prints, named, "fingerprint", "n").select("doc_id", "fingerprint", "component_id")


def hex16(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def shingle_set(text: str | None, words: int):
    """Sorted distinct XXH64 of the shingles; a text of fewer words is one shingle, one without words has none."""
    import numpy as np
    import xxhash

    found = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    shingles = [b" ".join(found[i : i + words]) for i in range(max(len(found) - words, 0) + 1)] if found else []
    return np.unique(np.fromiter((digest(x, 42) for x in shingles), dtype=np.uint64, count=len(shingles)))


def sketch(shingles, factors):
    """The fingerprint of a set of shingles and the keys of its bands."""
    import numpy as np
    import xxhash

    bits, least = np.zeros(64, dtype=np.int64), np.full(len(factors), (1 << 64) - 1, dtype=np.uint64)
    for i in range(0, len(shingles), 1 << 10):
        part = shingles[i : i + (1 << 10)]
        bits += np.unpackbits(part.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (part[:, None] * factors[None, :]).min(axis=0))
    fingerprint = np.packbits(bits * 2 > len(shingles)).view(">u8").astype(np.uint64).view(np.int64)[0]
    return fingerprint, [xxhash.xxh64_intdigest(b.tobytes()) for b in least.reshape(BANDS, BAND_ROWS)]


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, node: a hash of the shingle set, size, fingerprint, bands) for every row of docs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        factors = np.random.default_rng(42).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        signed = lambda values: pa.array(np.array(values, dtype=np.uint64).view(np.int64))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingle_set(t.as_py(), words) for t in batch.column("text")]
                made = [sketch(x, factors) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), batch.column("text_key"), signed([xxhash.xxh64_intdigest(x.tobytes()) for x in sets]), pa.array([len(x) for x in sets], pa.int32()), pa.array([f for f, _ in made], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1) * BANDS, pa.int32()), signed([b for _, bands in made for b in bands])),
                    ],
                    ["doc_id", "text_key", "node", "size", "fingerprint", "bands"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, node long, size int, fingerprint long, bands array<long>")


class Stars:
    """Pairs to check first among the nodes of one band's shard, at most one for each node, and the pivots of the shard.

    A node goes to the ball of a pivot within the radius whose size allows the similarity, and is paired with the nearest by fingerprint of
    the ball's last few nodes; without such a pivot it becomes one. The tree holds pivots only, so that very many near nodes cost one short
    search each. What these pairs do not connect is left to the shards by rare shingle.
    """

    LAST = 8

    def __init__(self, percent: int):
        self.percent, self.tree, self.pivots, self.latest = percent, BKTree(WIDE_RADIUS), {}, None

    def add(self, value: int, size: int, node: int):
        """(pair, to be checked?) for the node, None for the first one of the shard."""
        near = sorted(self.tree.near(value), key=lambda y: (y ^ value).bit_count())
        for y in near:
            for n, ball in self.pivots[y]:
                if min(n, size) * 100 >= max(n, size) * self.percent:
                    fits = [m for m in ball if (m[0] ^ value).bit_count() <= WIDE_RADIUS and min(m[1], size) * 100 >= max(m[1], size) * self.percent]
                    other = min(fits, key=lambda m: (m[0] ^ value).bit_count())[2]
                    if len(ball) > self.LAST:
                        ball.pop(1)  # the pivot itself stays
                    ball.append((value, size, node))
                    return node, other, True
        self.tree.insert(value)
        self.pivots.setdefault(value, []).append((size, [(value, size, node)]))
        before, self.latest = self.latest, node
        return None if before is None else (node, before, False)


class Across:
    """Pairs of other labels among the nodes that have one shingle in their prefixes, added by size.

    A pair needs a shingle that is in the prefix of the larger and in the (shorter) indexed prefix of the smaller one, with enough of both sets
    left from there on. Trees hold the nodes that are indexed, one for each label: nodes of one component are never compared.
    """

    def __init__(self, percent: int, forest: bool):
        self.percent, self.forest, self.trees, self.parent = percent, forest, {}, {}

    def find(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def add(self, value: int, size: int, node: int, label: int, place: int):
        """Yields the nodes to compare with this one: all, or, for a forest, one for each two components."""
        percent = self.percent
        for name, (tree, held) in self.trees.items():
            if name == label or (self.forest and self.find(name) == self.find(label)):
                continue
            fits = (
                other
                for y in tree.near(value)
                for n, other, at in held[y]
                if n * 100 >= size * percent and min(size - place, n - at) * (100 + percent) >= (size + n) * percent
            )
            for other in fits:
                yield other
                if self.forest:
                    self.parent[self.find(name)] = self.find(label)
                    break
        if place < indexed(size, percent):
            tree, held = self.trees.setdefault(label, (BKTree(WIDE_RADIUS), {}))
            tree.insert(value)
            held.setdefault(value, []).append((size, node, place))


def prefix(size: int, percent: int) -> int:
    """How many of a set's first elements (in one order for all sets) hold one of any set of this similarity or more and of no greater size."""
    return size - -(-size * percent // 100) + 1


def indexed(size: int, percent: int) -> int:
    """As prefix, against sets of no smaller size."""
    return size - -(-2 * size * percent // (100 + percent)) + 1


def by_shard(rows, keys: int, start, add):
    """rows: Arrow batches in order of their first `keys` columns. For each shard of two rows or more, add(start(), *the other columns) yields
    (a, b, check); a shard of one row in the middle of a batch is passed over."""
    import numpy as np

    here, state = None, None
    for batch in rows:
        columns = [batch.column(i).to_numpy() for i in range(batch.num_columns)]
        n, change = batch.num_rows, np.zeros(max(batch.num_rows - 1, 0), dtype=bool)
        for c in columns[:keys]:
            change |= c[1:] != c[:-1]
        starts = np.r_[0, np.flatnonzero(change) + 1, n]
        pairs = []
        for i, j in zip(starts.tolist(), starts[1:].tolist(), strict=False):
            if i == j:
                continue
            key = tuple(c[i] for c in columns[:keys])
            if here != key:
                here, state = key, None
                if j - i == 1 and j < n:
                    continue
            state = state or start()
            for row in zip(*(c[i:j].tolist() for c in columns[keys:]), strict=True):
                pairs.extend(add(state, *row))
                if len(pairs) >= 1 << 16:
                    yield _pairs_batch(pairs)
                    pairs = []
        yield _pairs_batch(pairs)


def _pairs_batch(pairs):
    import numpy as np
    import pyarrow as pa

    found = np.array([(min(a, b), max(a, b)) for a, b, _ in pairs], dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array([c for _, _, c in pairs], pa.bool_())], ["a", "b", "check"])


def _star(stars: Stars, value: int, size: int, node: int):
    pair = stars.add(value & ((1 << 64) - 1), size, node)
    return [pair] if pair else []


def stars(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, check) of nodes (node, size, fingerprint, bands) that share a band. All nodes of a shard are connected by them; those
    with `check` may be similar, the others only say that both are in one shard."""
    keyed = nodes.select(F.posexplode("bands").alias("band", "key"), "fingerprint", "size", "node")
    dealt = keyed.repartition("band", "key").sortWithinPartitions("band", "key", "fingerprint")
    found = dealt.mapInArrow(lambda it: by_shard(it, 2, lambda: Stars(percent), _star), "a long, b long, check boolean")
    return found.groupBy("a", "b").agg(F.max("check").alias("check"))


def unresolved(nodes: DataFrame) -> DataFrame:
    """The nodes (node, bands, label) that share a band with one of another label."""
    keyed = nodes.select(F.posexplode("bands").alias("band", "key"), "node", "label")
    mixed = keyed.groupBy("band", "key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high")
    return keyed.join(mixed, ["band", "key"], "left_semi").select("node").distinct()


def shingle_counts(sets: DataFrame):
    """Counts of shingles, as an array of SLOTS sums over the shingles of equal lowest bits."""

    import numpy as np

    def run(batches):
        import pyarrow as pa

        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            found = batch.column(0).flatten().to_numpy() & (SLOTS - 1)
            np.add.at(total, found, 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["slot", "n"])

    table = sets.select("shingles").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SLOTS, dtype=np.uint32)
    counts[table["slot"].to_numpy()] = np.minimum(table["n"].to_numpy(), (1 << 32) - 1)
    return counts


def rare_first(sets: DataFrame, counts, percent: int) -> DataFrame:
    """(token, size, node, place) for the prefix of each set (node, shingles), the rarest shingles first. What has a slot to itself meets nothing."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            columns = []
            for node, found in zip(batch.column("node").to_pylist(), batch.column("shingles"), strict=True):
                found = found.values.to_numpy()
                often = shared.value[found & (SLOTS - 1)]
                first = np.lexsort((found, often))[: prefix(len(found), percent)]
                place = np.flatnonzero(often[first] > 1)
                columns.append((found[first[place]], np.full(len(place), len(found), np.int32), np.full(len(place), node, np.int64), place.astype(np.int32)))
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], ["token", "size", "node", "place"])

    return sets.mapInArrow(run, "token long, size int, node long, place int")


def _across(found: Across, size: int, value: int, node: int, label: int, place: int):
    return [(node, other, True) for other in found.add(value & ((1 << 64) - 1), size, node, label, place)]


def across(tokens: DataFrame, nodes: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs (a, b) of nodes (node, fingerprint, label) with other labels that prefixes (token, size, node, place) and fingerprints allow."""
    keyed = tokens.join(nodes.select("node", "fingerprint", "label"), "node").select("token", "size", "fingerprint", "node", "label", "place")
    dealt = keyed.repartition("token").sortWithinPartitions("token", "size", "node")
    found = dealt.mapInArrow(lambda it: by_shard(it, 1, lambda: Across(percent, forest), _across), "a long, b long, check boolean")
    return found.select("a", "b").distinct()


def whole_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles) for nodes (node, text_key), from the texts of docs: sets of all documents would take more room than their texts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sets = [shingle_set(t.as_py(), words).view(np.int64) for t in part.column("text")]
                ends = pa.array(np.r_[0, np.cumsum([len(x) for x in sets])], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], ["node", "shingles"])

    texts = docs.select(F.xxhash64("text").alias("text_key"), "text").dropDuplicates(["text_key"])
    return texts.join(nodes, "text_key").select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs with `holds`: whether the Jaccard similarity of the whole sets is so many per cent at least."""
    side = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"_{k}"))
    both = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (both * (100 + percent) >= (F.size("_a") + F.size("_b")) * percent).alias("holds"))


def near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, component_id: the smallest doc_id that pairs of that similarity reach) for every row of docs.

    Nodes are distinct sets of shingles. Those that share a band are paired sparsely and checked on whole sets. Nodes whose bands hold more than
    one component then meet in shards by rare shingle, where trees give pairs between components: a forest of them, and once those are
    checked all that are left. The prefixes lose no pair of the similarity.
    """
    rows = stored(sketches(docs, words), "sketches")
    nodes = stored(rows.groupBy("node").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("text_key", "size", "fingerprint", "bands")]), "nodes")
    first = stored(stars(nodes, percent), "stars")
    near = stored(nodes.drop("component_id", "n").join(first.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi"), "near")
    sets = stored(whole_sets(docs, near.select("node", "text_key"), words), "sets")
    found = stored(checked(first.where("check").select("a", "b"), sets, percent), "checked")
    joined = components(found.where("holds").select("a", "b"))
    labelled = lambda rows: rows.join(joined, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    left = stored(near.join(unresolved(labelled(near)), "node", "left_semi"), "left")
    if not left.isEmpty():
        open_sets = sets.join(left.select("node"), "node", "left_semi")
        tokens = stored(rare_first(open_sets, shingle_counts(open_sets), percent), "prefixes")
        for forest in (True, False):
            more = across(tokens, labelled(left), percent, forest).join(found.select("a", "b"), ["a", "b"], "left_anti")
            found = stored(found.union(checked(more, sets, percent)), "checked")
            joined = components(found.where("holds").select("a", "b"))
        discard(tokens)
    discard(first, near, sets, left)
    named = stored(smallest_of_component(nodes.select("node", "component_id", "n"), joined, "component_id"), "components")
    return join_by(rows.select("doc_id", "node"), named, "node", "n").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class, as `keep_first` chooses it."""
    return keep_first(docs, classes(docs, **options))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one document of each component (doc_id, component_id), the one of smallest doc_id.

    Of several rows with one doc_id one stays, that of least text hash. Rows without doc_id can't be told apart by it and stay.
    """
    gone = found.where("doc_id IS NOT NULL AND NOT doc_id <=> component_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    one = left.where("doc_id IS NOT NULL").withColumn("_rank", F.row_number().over(first)).where("_rank = 1").select(*docs.columns)
    return one.unionByName(left.where("doc_id IS NULL"))
