"""Substring dedup by suffix automata and matching statistics.

A window is `length` consecutive words. A word goes if it is covered by a window whose words also start in a document
of smaller doc_id. The reference is the corpus itself, and an automaton of it has no bound that would allow a
broadcast, so the reference is cut into shards by content, and documents meet the shards that can hold their windows:

1. Winnowing picks an anchor for every window: the k-gram of least hash among those in it. Equal windows have equal
   anchors. Anchors that stand in one document only cannot be part of a repeat; the others are told to their documents,
   with the first document that has them.
2. Documents emit segments, the words of neighbouring windows whose anchors are in the same shard, to that shard: it
   belongs to the anchors' first document, or to a share of its anchors where they stand in many places, so that shards are
   bounded; equal segments of a batch leave it once, with the list of their places. Windows with anchors of more than HOT
   documents are dealt by their own words and settled by equality of the window, for whose words no automaton is needed: so a
   common line does not gather all its contexts in one.
3. The segments of a shard make one suffix automaton, built in ascending order of doc_id, with the smallest doc_id of
   each state. Segments stream through it; where the match is as long as a window, its state says which document had the
   window first.
4. Spans go back to their documents and the words in them are cut out. Texts are shuffled once; both joins use it.

`remove_known` is the same for a bounded reference set: automata of its shards are broadcast, with a check of the size.

Defined cases: a null text has no words; a null doc_id counts as larger than any other (which are below 2^62), and rows without one do not
remove each other's words, nor do rows of one doc_id; rows without one are told apart by their texts, so that they are spread like others; a very long text is read whole; a text without removed words stays byte for byte; equal rows give
equal rows; clashing columns of the input become input_<name>.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftlake.llm.common import apart, stored

LENGTH, GRAM, HOT = 13, 6, 1000
#: Places of anchors in a shard, about; each stands for some ten words.
SHARD_ENTRIES = 10_000
#: Documents without doc_id have numbers from here on, by their texts. Between themselves none is earlier than another.
NO_ID = 1 << 62
#: Words of a reference that remove_known broadcasts at most, and words of one automaton.
KNOWN_WORDS, SHARD_WORDS = 1_000_000, 50_000


class SuffixAutomaton:
    """All substrings of the added word sequences; each state knows the first one that had its words."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def _state(self, length: int, link: int, first: int, after: dict) -> int:
        self.next.append(after)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.length) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A state for the shorter words of q that end after p."""
        clone = self._state(self.length[p] + 1, self.link[q], self.first[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list, first: int) -> None:
        """Adds a sequence; call in ascending order of `first`."""
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
                continue
            new, p = self._state(self.length[last] + 1, 0, first, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            last = new

    def firsts(self, words: list, length: int) -> list[int | None]:
        """Matching statistics, cut at `length`: for each window of the words, who had it first (None: nobody)."""
        out, state, matched = [], 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state, matched = self.next[state][word], matched + 1
            while self.length[self.link[state]] >= length if state else False:
                state = self.link[state]
                matched = min(matched, self.length[state])
            if i >= length - 1:
                out.append(self.first[state] if matched >= length else None)
        return out


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64) for b in (base, inverse))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of a text: their bytes, joined by one space, and hashes."""

    def __init__(self, text: str | None):
        self.words = (text or "").encode().split()
        self.joined = b" ".join(self.words)
        sizes = np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes

    def __len__(self) -> int:
        return len(self.words)

    def part(self, i: int, j: int) -> bytes:
        return self.joined[self.starts[i] : self.ends[j - 1]]

    def hashes(self) -> np.ndarray:
        out = np.zeros(len(self), np.uint64)
        step = 1 << 15
        for i in range(0, len(self), step):
            a, b = self.starts[i : i + step], self.ends[i : i + step]
            raw = np.frombuffer(self.joined[a[0] : b[-1]], np.uint8).astype(np.uint64) + np.uint64(1)
            power, inverse = _powers(1 << max(16, (len(raw) - 1).bit_length()))
            sums = np.r_[np.uint64(0), np.cumsum(raw * power[: len(raw)], dtype=np.uint64)]
            out[i : i + step] = _mix((sums[b - a[0]] - sums[a - a[0]]) * inverse[a - a[0]])
        return out

    @staticmethod
    def grams(hashes: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(hashes) - n + 1, np.uint64)
        for i in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : len(out) + i]
        return _mix(out)


def anchors(words: Words, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(for each window the position of its anchor, the anchor's hash; the word hashes)."""
    hashes = words.hashes()
    own = Words.grams(hashes, gram)
    place = np.lib.stride_tricks.sliding_window_view(own, length - gram + 1).argmin(axis=1) + np.arange(len(words) - length + 1)
    return place, own[place].view(np.int64), hashes


def _anchors_of(docs: DataFrame, length: int) -> DataFrame:
    """(h, first, others): the documents of a batch with an anchor, smallest first."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found, owner = [], []
            for doc, text in zip(batch.column("_doc").to_pylist(), batch.column("text"), strict=True):
                words = Words(text.as_py())
                if len(words) >= length:
                    found.append(np.unique(anchors(words, length)[1]))
                    owner.append(np.full(len(found[-1]), doc))
            if not found:
                continue
            h, doc = np.concatenate(found), np.concatenate(owner)
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
            h, doc = h[new], doc[new]
            start = np.r_[True, h[1:] != h[:-1]]
            begin = np.flatnonzero(start)
            more = np.diff(np.r_[begin, len(h)]) - 1
            others = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(more)].astype(np.int32)), pa.array(doc[~start]), mask=pa.array(more == 0))
            yield pa.RecordBatch.from_arrays([pa.array(h[begin]), pa.array(doc[begin]), others], ["h", "first", "others"])

    return docs.select("_doc", "text").mapInArrow(run, "h long, first long, others array<long>")


def _shared(rows: DataFrame) -> DataFrame:
    """(_doc, _shared, _first, _hot): the anchors of each document that other documents have too, the shard of each anchor, and
    whether many documents have it.

    First and number of an anchor's documents are aggregates, joined to its rows again; no window holds an anchor's rows. The shard is
    the first document that has the anchor; where that document's anchors have more than SHARD_ENTRIES places in all, they are dealt to so
    many shards as keeps each to that (an anchor that is not hot has HOT places at most).
    """
    size = F.lit(1) + F.coalesce(F.size("others"), F.lit(0))
    known = rows.groupBy("h").agg(F.min("first").alias("lo"), F.max("first").alias("hi"), F.sum(size).alias("n")).where(f"lo < {NO_ID} AND (lo < hi OR n > 1)")
    known = stored(known.select("h", "lo", "n", (F.col("n") > HOT).alias("hot")), "anchors")
    parts = known.where("NOT hot").groupBy("lo").agg(F.ceil(F.sum("n") / SHARD_ENTRIES).alias("parts")).where("parts > 1")
    known = known.join(parts, "lo", "left")
    key = F.when(F.col("parts").isNull(), F.col("lo")).otherwise(F.xxhash64("lo", F.pmod(F.xxhash64("h"), F.col("parts"))))
    found = rows.join(known.select("h", key.alias("key"), "hot"), "h")
    each = found.select("h", "key", "hot", F.explode(F.concat(F.array("first"), F.coalesce("others", F.array().cast("array<long>")))).alias("_doc"))
    lists = each.groupBy("_doc").agg(F.collect_list(F.struct("h", "key", "hot")).alias("_l"))
    return lists.select("_doc", F.col("_l.h").alias("_shared"), F.col("_l.key").alias("_first"), F.col("_l.hot").alias("_hot"))


def _settle(held: dict, length: int) -> list:
    """The segments of a batch and their places. Of the windows that are dealt by their own words only the first document of the batch has to
    ask; for its later ones that document settles it, and their spans, merged, go on as rows of their own (hot: null)."""
    out, gone = [], {}
    for key, places in held.items():
        first = min(places)[0]
        if key[1] and len(places) > 1 and first < NO_ID:
            for doc, row, start in places:
                if doc > first:
                    gone.setdefault((doc, row), []).append(start)
            places = [p for p in places if p[0] == first]
        out.append((key, places))
    for (doc, row), starts in gone.items():
        starts.sort()
        merged = []
        for s in starts:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = s + length
            else:
                merged.append([s, s + length])
        out.append(((doc, None, b""), [(doc, row, x) for span in merged for x in span]))
    return out


def _segments(docs: DataFrame, length: int) -> DataFrame:
    """(key, hot, first, segment, places): words of windows with shared anchors, equal ones of a batch once."""

    def run(batches):
        import pyarrow as pa

        place_type = pa.list_(pa.struct([("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int64())]))
        for batch in batches:
            held: dict = {}
            for i in np.flatnonzero(batch.column("_shared").is_valid().to_numpy(zero_copy_only=False)).tolist():
                words = Words(batch.column("text")[i].as_py())
                if len(words) < length:
                    continue
                doc, row = batch.column("_doc")[i].as_py(), batch.column("_row")[i].as_py()
                _, h, hashes = anchors(words, length)
                known, lo, many = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("_shared", "_first", "_hot"))
                order = np.argsort(known)
                at = order[np.minimum(np.searchsorted(known, h, sorter=order), len(known) - 1)]
                flagged = known[at] == h
                hot, key = flagged & many[at], lo[at]
                start = flagged & (hot | np.r_[True, (key[1:] != key[:-1]) | ~flagged[:-1] | hot[:-1]])
                begin = np.flatnonzero(start)
                ends = np.flatnonzero(flagged & np.r_[start[1:] | ~flagged[1:], True]) + length
                keys = key[begin]
                if hot.any():
                    keys = np.where(hot[begin], Words.grams(hashes, length).view(np.int64)[begin], keys)
                for a, b, k, x in zip(begin.tolist(), ends.tolist(), keys.tolist(), hot[begin].tolist(), strict=True):
                    held.setdefault((k, x, words.part(a, b)), []).append((doc, row, a))
            items = _settle(held, length)
            for at in range(0, len(items), 20_000):
                some = items[at : at + 20_000]
                flat = [p for _, places in some for p in places]
                values = pa.StructArray.from_arrays([pa.array([p[j] for p in flat], pa.int64()) for j in range(3)], ["doc", "row", "start"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(places) for _, places in some)]).astype(np.int32)), values).cast(place_type)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in some], pa.int64()), pa.array([k[1] for k, _ in some], pa.bool_()), pa.array([min(places)[0] for _, places in some], pa.int64()), pa.array([k[2] for k, _ in some], pa.binary()), lists], ["key", "hot", "first", "segment", "places"])

    return docs.mapInArrow(run, "key long, hot boolean, first long, segment binary, places array<struct<doc: long, row: long, start: long>>")


def repeats(group: list[tuple[bytes, list[tuple[int, int, int]]]], length: int = LENGTH):
    """(doc, row, start, stop) of the words that repeat earlier ones, of the segments of one shard and their places."""
    merged: dict[bytes, list] = {}
    for segment, places in group:
        merged.setdefault(segment, []).extend(places)
    ordered = sorted((min(places)[0], segment, segment.split(), places) for segment, places in merged.items())
    automaton = SuffixAutomaton() if len(ordered) > 1 else None  # a single segment has its own places only
    if automaton:
        for first, _, words, _ in ordered:
            automaton.add(words, first)
    for first, _, words, places in ordered:
        windows = len(words) - length + 1
        firsts = automaton.firsts(words, length) if automaton else [first] * windows
        for doc, row, start in places:
            i = 0
            while i < windows:
                j = i
                while j < windows and firsts[j] < min(doc, NO_ID):
                    j += 1
                if j > i:
                    yield doc, row, start + i, start + j - 1 + length
                i = j + 1


def _spans(segments: DataFrame, length: int) -> DataFrame:
    """(_doc, _spans) of the words to remove."""

    def run(batches):
        import pyarrow as pa

        here, group, seen, out = None, [], {}, []

        def rows():
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "row", "start", "stop"])

        for batch in batches:
            lists = batch.column("places")
            flat, offsets = lists.flatten(), lists.offsets.to_numpy()
            doc, row, start = (flat.field(j).to_numpy().tolist() for j in range(3))
            offsets = (offsets - offsets[0]).tolist()
            for i, (key, hot, segment) in enumerate(zip(batch.column("key").to_pylist(), batch.column("hot").to_pylist(), batch.column("segment").to_pylist(), strict=True)):
                if here != (key, hot):
                    out += repeats(group, length)
                    here, group, seen = (key, hot), [], {}
                places = zip(doc[offsets[i] : offsets[i + 1]], row[offsets[i] : offsets[i + 1]], start[offsets[i] : offsets[i + 1]], strict=True)
                if hot is None:  # settled where it was read: starts and stops in turn
                    places = list(places)
                    out += [(d, r, x, y) for (d, r, x), (_, _, y) in zip(places[::2], places[1::2], strict=True)]
                elif hot:  # a whole window, and its rows come in order of their first document: nothing needs to be held
                    first = seen.setdefault(segment, min(doc[offsets[i] : offsets[i + 1]]))
                    out += [(d, r, s, s + length) for d, r, s in places if first < min(d, NO_ID)]
                else:
                    group.append((segment, list(places)))
            yield rows()
            out = []
        out += repeats(group, length)
        yield rows()

    dealt = segments.repartition("key").sortWithinPartitions("key", "hot", "first")
    spans = dealt.mapInArrow(run, "doc long, row long, start long, stop long")
    return spans.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("row", "start", "stop")).alias("_spans"))


def cut(words: Words, text: str | None, covered: np.ndarray) -> str | None:
    """The text without the covered words; white space is kept between the words that stay, and one is kept at a cut."""
    if not covered.any():
        return text
    raw, at, keep, gap = (text or "").encode(), 0, [], b""
    for word, gone in zip(words.words, covered.tolist(), strict=True):
        i = raw.index(word, at)
        if not gone:
            keep.append(raw[at:i] if not gap else gap)
            keep.append(word)
            gap = b""
        elif not gap:
            gap = raw[at:i] or b" "
        at = i + len(word)
    return b"".join(keep).decode().strip(" ")


NEW = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]


def _cut_out(docs: DataFrame, columns: list[T.StructField]) -> DataFrame:
    names = [f.name for f in columns]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts, counts, removed, digests = [], [], [], []
                for text, row, spans in zip(part.column("text").to_pylist(), part.column("_row").to_pylist(), part.column("_spans").to_pylist(), strict=True):
                    words = Words(text)
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s in spans or ():
                        if s["row"] == row:
                            edge[s["start"]] += 1
                            edge[s["stop"]] -= 1
                    covered = np.cumsum(edge[:-1]) > 0
                    texts.append(cut(words, text, covered))
                    counts.append(len(words))
                    removed.append(int(covered.sum()))
                    kept = words.joined if not covered.any() else b" ".join([w for w, c in zip(words.words, covered.tolist(), strict=True) if not c])
                    digests.append(hashlib.sha256(kept).hexdigest())
                arrays = [pa.array(texts, pa.string()) if n == "text" else part.column(n) for n in names]
                arrays += [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names + [f.name for f in NEW])

    return docs.mapInArrow(run, T.StructType([*columns, *NEW]))


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, their texts without repeated windows, with n_words, n_removed and kept_sha256 (of the kept words, joined by one space)."""
    docs = apart(docs, [f.name for f in NEW] + ["_doc", "_row", "_shared", "_first", "_hot", "_spans"])
    own = F.lit(NO_ID) + F.xxhash64(F.lit("text"), "text").bitwiseAND(F.lit(NO_ID - 1))
    keyed = docs.withColumn("_doc", F.coalesce("doc_id", own)).withColumn("_row", F.xxhash64("doc_id", "text"))
    shared = _shared(stored(_anchors_of(keyed, length), "anchors"))
    dealt = keyed.repartition("_doc")  # both joins below read this exchange
    segments = _segments(dealt.join(shared, "_doc", "left"), length)
    spans = _spans(segments, length)
    return _cut_out(dealt.join(spans, "_doc", "left"), docs.schema.fields)


def remove_known(docs: DataFrame, reference: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs, their texts without windows that stand in the reference (text), with n_words, n_removed and kept_sha256."""
    total = reference.agg(F.sum(F.size(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+")))).first()[0] or 0
    if total > KNOWN_WORDS:
        raise ValueError(f"a reference of {total} words is too large to broadcast; join it to docs with smaller ids and call dedup()")
    shards, held = [SuffixAutomaton()], 0
    for row in reference.select("text").collect():  # bounded above
        words = (row[0] or "").encode().split()
        if held and held + len(words) > SHARD_WORDS:
            shards.append(SuffixAutomaton())
            held = 0
        shards[-1].add(words, 0)
        held += len(words)
    shared = docs.sparkSession.sparkContext.broadcast(shards)
    docs = apart(docs, [f.name for f in NEW] + ["_row", "_spans"])
    kind = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("row", "start", "stop")]))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            spans = []
            for text in batch.column("text"):
                words = (text.as_py() or "").encode().split()
                spans.append([{"row": 0, "start": i, "stop": i + length} for a in shared.value for i, first in enumerate(a.firsts(words, length)) if first is not None])
            kind_here = pa.list_(pa.struct([("row", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.zeros(batch.num_rows, np.int64)), pa.array(spans, kind_here)], [*batch.schema.names, "_row", "_spans"])

    found = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_row", T.LongType()), T.StructField("_spans", kind)]))
    return _cut_out(found, docs.schema.fields)
