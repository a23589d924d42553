"""Quality classifier: interpolated modified Kneser-Ney models of byte n-grams, trained on trusted text.

Trusted documents are all those labelled quality 1 and not toxic. Documents are dealt to two folds by their text, and each
fold is scored by the model that the other fold's trusted documents make: so no document, nor a copy of it, is scored by a
model that has seen it, and scores of trusted documents are worth as much as those of others.

N-grams of the highest order are counted where they are read and summed by n-gram; each lower order counts the distinct
n-grams that continue to it. Discounts come from the counts of counts of each order, and joins of each order with its contexts
and with the order below give the probabilities. A document's score is its mean negative log-likelihood for each byte (the
logarithm of its perplexity). A document is rejected above its threshold: a quantile of the scores of all trusted documents of its
language and size class (doublings of UTF-8 bytes: scores of long texts spread far less than those of short ones). Classes
with few trusted documents take the quantile of the language, languages with few the one over all of them.

Documents are dealt to chunks of some CHUNK_BYTES, of one fold each, by a hash of doc_id and text. A chunk reads its texts as a stream, after the ids
that are trusted among them, and gives each distinct n-gram once, with its count in trusted texts: these counts train the models, and the same
rows ask for the scores. Distinct n-grams are looked up in the sharded tables of the model by joins, order by order, and the answers go back to
their chunks, where they precede the texts in the stream. So texts shuffle twice, and a common n-gram is asked for once by a chunk: no key
gathers all documents, and nothing of the model is in one memory. A caller with a model of proven size may set broadcast_entries instead.

Defined cases: a null text is an empty one, scored for its end mark alone; a very long text is counted and scored in slices
of SLICE bytes; equal rows share a chunk, whose texts are never held together; a null language is a language of its own; without trusted documents nothing is rejected, and a fold that has none
leaves every byte equally likely to the other; label rows of one doc_id must all trust it; equal texts score alike, and a
score equal to the threshold is kept; an empty table gives no rows; clashing columns of the input become input_<name>.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftlake.llm.common import apart, discard, stored, utf8_size

ORDER = 5
PAD, END = b"\n", b"\0"
SLICE = 1 << 19  # bytes that are scored or counted at once
CHUNK_BYTES = 32 << 20  # of documents that ask the sharded model together
HELD_GRAMS = 4_000_000  # distinct n-grams that a chunk holds before it gives them away
TAG = 56  # an n-gram's order stands in the bits from here on


@dataclass(frozen=True)
class Rule:
    quantile: float = 0.995
    slack: float = 0.0  # nats for each byte, on top
    least_trusted: int = 50  # documents of a size class, or of a language


def fold(text: str = "text") -> Column:
    return F.pmod(F.xxhash64(F.lit(3), F.coalesce(text, F.lit(""))), F.lit(2)).cast("int")


def _keys(data: bytes, order: int = ORDER):
    """The n-grams (as integers) that end at each byte but the first order - 1."""
    import numpy as np

    raw = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    n = len(raw) - order + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(order):
        out = (out << np.uint64(8)) | raw[i : n + i]
    return out


def _slices(text: str | None, order: int = ORDER):
    """Padded parts of a text; together they have each of its n-grams once."""
    data = PAD * (order - 1) + (text or "").encode() + END
    for i in range(0, len(data) - order + 1, SLICE):
        yield data[i : i + SLICE + order - 1]


def _chunk(docs: DataFrame) -> Column:
    """The chunk of a document; its lowest bit is the document's fold."""
    size = docs.agg(F.sum(utf8_size(F.col("text")) + 1)).first()[0] or 0
    number = F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(max(1, size // (2 * CHUNK_BYTES))))
    return 2 * number + fold()


class _Counts:
    """Distinct n-grams of highest order, with their counts in trusted texts."""

    def __init__(self):
        self.clear()

    def clear(self):
        import numpy as np

        self.grams, self.counts, self.held, self.size = np.zeros(0, np.uint64), np.zeros(0), [], 0

    def add(self, part: bytes, trusted: bool):
        self.held.append((part, trusted))
        self.size += len(part)
        if self.size >= 4 * SLICE:
            self.merge()

    def merge(self):
        import numpy as np

        for trusted in (False, True):
            if parts := [_keys(x) for x, t in self.held if t == trusted]:
                own, n = np.unique(np.concatenate(parts), return_counts=True)
                both, at = np.unique(np.concatenate([self.grams, own]), return_inverse=True)
                self.counts = np.bincount(at, weights=np.concatenate([self.counts, n * trusted]), minlength=len(both))
                self.grams = both
        self.held, self.size = [], 0


def ngrams(docs: DataFrame, trusted: DataFrame | None = None) -> DataFrame:
    """(_s, gram, c): the n-grams of highest order in the texts of each chunk (column _s of docs), with their counts in the texts whose doc_id is trusted. A
    chunk with very many gives some in several rows, whose counts add up."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        counts, chunk, ids = _Counts(), None, set()

        def out():
            counts.merge()
            for i in range(0, len(counts.grams), 1 << 16):
                grams, c = counts.grams[i : i + (1 << 16)].astype(np.int64), counts.counts[i : i + (1 << 16)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), chunk, np.int64)), pa.array(grams), pa.array(c)], ["_s", "gram", "c"])
            counts.clear()

        for batch in batches:
            for s, first, i, text in zip(*(batch.column(k).to_pylist() for k in ("_s", "_first", "doc_id")), batch.column("text"), strict=True):
                if s != chunk:
                    yield from out()
                    chunk, ids = s, set()
                if first:
                    ids.add(i)
                    continue
                for part in _slices(text.as_py()):
                    counts.add(part, i in ids)
                    if len(counts.grams) >= HELD_GRAMS:
                        yield from out()
        yield from out()

    rows = docs.select("_s", F.lit(False).alias("_first"), "doc_id", "text")
    if trusted is not None:
        # grows with the corpus: joined the same way at every size, not broadcast while it is small
        known = docs.select("_s", "doc_id").distinct().join(trusted.hint("merge"), "doc_id", "left_semi")
        rows = rows.unionByName(known.withColumn("_first", F.lit(True)), allowMissingColumns=True)
    return rows.repartition("_s").sortWithinPartitions("_s", F.desc("_first")).mapInArrow(run, "_s long, gram long, c long")


def _low(gram: Column | str, order: int) -> Column:
    """The last `order` bytes of an n-gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * order) - 1))


def _discounts(ones: list[int]) -> list[float]:
    """Chen and Goodman's discounts of counts 1, 2 and 3 or more; absolute discounting by half where counts are too few."""
    n1, n2, n3, n4 = (x or 0 for x in ones)
    if min(n1, n2, n3) == 0:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [d if 0 < d < i + 1 else 0.5 for i, d in enumerate(found)]


def train(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(probabilities: m, n, gram, value; back-offs: m, n, gram, value): natural logarithms, by order of n-gram or context, of the models that score
    fold m; counts (m, gram, c) are those of the trusted texts of the other fold."""
    levels = {ORDER: stored(counts.groupBy("m", "gram").agg(F.sum("c").alias("c")), "grams")}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = stored(levels[n + 1].select("m", _low("gram", n).alias("gram")).groupBy("m", "gram").agg(F.count("*").alias("c")), "grams")
    below, probabilities, backs = None, [], []
    for n in range(1, ORDER + 1):
        counts = levels[n]
        ones = counts.groupBy("m").agg(*[F.sum((F.col("c") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()  # two rows
        cut = F.lit(None).cast("double")
        for row in ones:
            d = _discounts([row[f"n{i}"] for i in (1, 2, 3, 4)])
            cut = F.when(F.col("m") == row["m"], F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])).otherwise(cut)
        rows = counts.withColumn("context", F.shiftright("gram", 8)).withColumn("cut", cut)
        contexts = rows.groupBy("m", "context").agg(F.sum("c").alias("total"), F.sum("cut").alias("given"))
        contexts = stored(contexts.select("m", "context", "total", (F.col("given") / F.col("total")).alias("back")), "contexts")
        rows = rows.join(contexts, ["m", "context"]).withColumn("low", _low("gram", n - 1) if n > 1 else F.lit(0).cast("long"))
        rows = rows.withColumn("p_low", F.lit(1 / 256)) if below is None else rows.join(below, ["m", "low"])
        p = (F.col("c") - F.col("cut")) / F.col("total") + F.col("back") * F.col("p_low")
        below = stored(rows.select("m", "gram", p.alias("p_low")), "probabilities")
        probabilities.append(below.select("m", F.lit(n).alias("n"), "gram", F.log("p_low").alias("value")))
        backs.append(contexts.select("m", F.lit(n - 1).alias("n"), F.col("context").alias("gram"), F.log("back").alias("value")))
        below = below.withColumnRenamed("gram", "low")
    discard(*levels.values())
    return functools.reduce(DataFrame.union, probabilities), functools.reduce(DataFrame.union, backs)


class Lookup:
    """Numbers by 64-bit key, for whole arrays of keys: an open table in numpy."""

    EMPTY = (1 << 64) - 1

    def __init__(self, keys, values):
        import numpy as np

        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, self.EMPTY, np.uint64), np.zeros(1 << bits)
        at, left = self._at(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == self.EMPTY]
            self.keys[at[free]] = keys[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + np.uint64(1)) & self.mask
        self.values[at] = values

    def _at(self, keys):
        import numpy as np

        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def get(self, keys):
        """(values, found)"""
        import numpy as np

        at = self._at(keys)
        there = self.keys[at]
        found = there == keys
        left = np.flatnonzero(~found & (there != self.EMPTY))
        while len(left):
            at[left] = (at[left] + np.uint64(1)) & self.mask
            there = self.keys[at[left]]
            found[left] = there == keys[left]
            left = left[(there != keys[left]) & (there != self.EMPTY)]
        return self.values[at], found


class Scorer:
    """Scores of texts, from the log-likelihoods of arrays of n-grams."""

    def log_likelihoods(self, keys):
        raise NotImplementedError

    def scores(self, texts: list[str | None]) -> list[float]:
        """Mean negative log-likelihood of each text's bytes and its end."""
        import numpy as np

        sums, sizes, held, owner, size = np.zeros(len(texts)), np.zeros(len(texts)), [], [], 0

        def add():
            keys = [_keys(x) for x in held]  # of each part alone: n-grams that stretch over two texts are of neither
            sums_of = np.r_[0.0, np.cumsum(self.log_likelihoods(np.concatenate(keys)))]
            ends = np.cumsum([len(x) for x in keys])
            for i, a, b in zip(owner, np.r_[0, ends[:-1]], ends, strict=True):
                sums[i] += sums_of[b] - sums_of[a]
                sizes[i] += b - a

        for i, text in enumerate(texts):
            for part in _slices(text):
                held.append(part)
                owner.append(i)
                size += len(part)
                if size >= SLICE:
                    add()
                    held, owner, size = [], [], 0
        if held:
            add()
        return (-sums / np.maximum(sizes, 1)).round(6).tolist()


class Model(Scorer):
    def __init__(self, probabilities, backs):
        """Arrow tables of n, gram, value."""
        import numpy as np

        def lookup(t):
            n, gram = t.column("n").to_numpy().astype(np.uint64), t.column("gram").to_numpy().astype(np.uint64)
            return Lookup(n << np.uint64(TAG) | gram, t.column("value").to_numpy())

        self.probabilities, self.backs = lookup(probabilities), lookup(backs)

    def log_likelihoods(self, keys):
        import numpy as np

        out, left = np.zeros(len(keys)), np.arange(len(keys))
        for n in range(ORDER, 0, -1):
            own = keys[left] & np.uint64((1 << 8 * n) - 1)
            value, found = self.probabilities.get(own | np.uint64(n << TAG))
            out[left[found]] += value[found]
            left, own = left[~found], own[~found]
            value, found = self.backs.get(own >> np.uint64(8) | np.uint64((n - 1) << TAG))
            out[left] += np.where(found, value, 0.0)
        out[left] -= math.log(256)
        return out


class Answers(Scorer):
    """The log-likelihoods that a chunk has asked for."""

    def __init__(self, grams, values):
        import numpy as np

        self.known = Lookup(np.asarray(grams).astype(np.uint64), np.asarray(values))

    def log_likelihoods(self, keys):
        values, found = self.known.get(keys)
        if not found.all():
            raise ValueError("an n-gram of a chunk has no answer")
        return values


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).where("good").select("doc_id")


def _scored_here(docs: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    models = {m: Model(*(x.where(F.col("m") == m).toArrow() for x in model)) for m in (0, 1)}
    shared = docs.sparkSession.sparkContext.broadcast(models)
    names = docs.columns

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts, folds, scores = part.column("text").to_pylist(), part.column("_m").to_numpy(), np.zeros(part.num_rows)
                for m in (0, 1):
                    at = np.flatnonzero(folds == m)
                    scores[at] = shared.value[m].scores([texts[k] for k in at.tolist()])
                yield pa.RecordBatch.from_arrays([*part.select(names).columns, pa.array(scores, pa.float64())], [*names, "log_ppl"])

    return docs.withColumn("_m", fold()).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("log_ppl", T.DoubleType())]))


def _answers(asked: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(m, gram, value) for the distinct n-grams of highest order that are asked for (m, gram): joins from the highest order down, each with
    what no higher order knew."""
    left, done = asked.select("m", "gram").distinct().withColumn("sum", F.lit(0.0)), []
    probabilities, backs = model
    for n in range(ORDER, 0, -1):
        own = probabilities.where(F.col("n") == n).select("m", F.col("gram").alias("_low"), "value")
        back = backs.where(F.col("n") == n - 1).select("m", F.col("gram").alias("_context"), F.col("value").alias("_back"))
        found = stored(left.withColumn("_low", _low("gram", n)).join(own, ["m", "_low"], "left"), "found")
        done.append(found.where("value IS NOT NULL").select("m", "gram", (F.col("sum") + F.col("value")).alias("value")))
        missed = found.where("value IS NULL").withColumn("_context", F.shiftright("_low", 8)).join(back, ["m", "_context"], "left")
        left = missed.select("m", "gram", (F.col("sum") + F.coalesce("_back", F.lit(0.0))).alias("sum"))
    known = left.select("m", "gram", (F.col("sum") - math.log(256)).alias("value"))
    return functools.reduce(DataFrame.union, done, known)


def _scored_by_joins(docs: DataFrame, asked: DataFrame, model: tuple[DataFrame, DataFrame]) -> DataFrame:
    """As _scored_here, with no table of the model in memory; asked: what `ngrams` gives for the chunks of docs."""
    names = [c for c in docs.columns if c != "_s"]
    schema = T.StructType([*docs.select(names).schema.fields, T.StructField("log_ppl", T.DoubleType())])
    questions = asked.select("_s", (F.col("_s") % 2).cast("int").alias("m"), "gram")
    answers = questions.join(_answers(questions, model), ["m", "gram"]).select("_s", F.lit(True).alias("_first"), F.col("gram").alias("_gram"), F.col("value").alias("_value"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        chunk, held, known = None, [], None
        for batch in batches:
            chunks, first = batch.column("_s").to_numpy(), batch.column("_first").to_numpy(zero_copy_only=False)
            ends = np.r_[np.flatnonzero((chunks[1:] != chunks[:-1]) | (first[1:] != first[:-1])) + 1, len(chunks)]
            for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                if a == b:
                    continue
                if chunks[a] != chunk:
                    chunk, held, known = chunks[a], [], None
                part = batch.slice(a, b - a)
                if first[a]:
                    held.append((part.column("_gram").to_numpy(), part.column("_value").to_numpy()))
                    continue
                if known is None:
                    known, held = Answers(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                for i in range(0, b - a, 1000):
                    few = part.slice(i, 1000)
                    scores = known.scores(few.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays([*few.select(names).columns, pa.array(scores, pa.float64())], [*names, "log_ppl"])

    rows = docs.withColumn("_first", F.lit(False)).unionByName(answers, allowMissingColumns=True)
    return rows.repartition("_s").sortWithinPartitions("_s", F.desc("_first")).mapInArrow(run, schema)


OWN = ["log_ppl", "_m", "_s", "_first", "_gram", "_value"]


def score(docs: DataFrame, model: tuple[DataFrame, DataFrame], broadcast_entries: int = 0) -> DataFrame:
    """docs with log_ppl. A model of broadcast_entries entries at most (counted) is broadcast, which gives the same scores."""
    docs = apart(docs, OWN)
    if broadcast_entries and sum(x.count() for x in model) <= broadcast_entries:
        return _scored_here(docs, model)
    chunks = docs.withColumn("_s", _chunk(docs))
    return _scored_by_joins(chunks, stored(ngrams(chunks), "asked"), model)


def learned(docs: DataFrame, trusted: DataFrame) -> tuple[tuple[DataFrame, DataFrame], DataFrame]:
    """(model of the trusted doc_ids' texts, docs with log_ppl): the n-grams that chunks count for training are also what they ask."""
    docs = apart(docs, OWN)
    chunks = docs.withColumn("_s", _chunk(docs))
    asked = stored(ngrams(chunks, trusted), "asked")
    model = train(asked.where("c > 0").select((1 - F.col("_s") % 2).cast("int").alias("m"), "gram", "c"))
    return model, _scored_by_joins(chunks, asked, model)


def _quantiles(scores: DataFrame, keys: list[str], q: float) -> DataFrame:
    """keys, n, at: the smallest score, in thousandths, that a part q of the rows does not exceed. Exact to a bin; no group is gathered."""
    bins = scores.groupBy(*keys, F.ceil(F.col("log_ppl") * 1000).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    own = Window.partitionBy(*keys)
    cumulated = bins.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("total", F.sum("n").over(own))
    return cumulated.where(F.col("upto") >= F.lit(q) * F.col("total")).groupBy(*keys).agg(F.max("total").alias("n"), (F.min("bin") / 1000).alias("at"))


def size_class(text: str = "text") -> Column:
    """The binary digits of a text's size in bytes."""
    return F.length(F.bin(utf8_size(F.col(text))))


def _same(rows: DataFrame, others: DataFrame, how: str) -> DataFrame:
    """rows joined with others on others' key columns; null keys are equal."""
    keys = [c for c in others.columns if c in ("lang", "size_class")]
    others = others.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in others.columns])
    on = [rows[c].eqNullSafe(others[f"_{c}"]) for c in keys]
    return rows.join(others, on, how).drop(*[f"_{c}" for c in keys])


def thresholds(scores: DataFrame, trusted: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(lang, size_class, threshold) for every class of the scores (doc_id, lang, size_class, log_ppl); null without trusted documents."""
    known = stored(scores.join(trusted, "doc_id", "left_semi").select("lang", "size_class", "log_ppl"), "trusted")
    every = _quantiles(known, [], rule.quantile).first()
    limits = scores.select("lang", "size_class").distinct()
    for name, keys in (("by_size", ["lang", "size_class"]), ("by_lang", ["lang"])):
        limits = _same(limits, _quantiles(known, keys, rule.quantile).where(F.col("n") >= rule.least_trusted).select(*keys, F.col("at").alias(name)), "left")
    at = F.coalesce("by_size", "by_lang", F.lit(every["at"] if every else None).cast("double"))
    return stored(limits.select("lang", "size_class", (at + rule.slack).alias("threshold")), "thresholds")


def fit(docs: DataFrame, labels: DataFrame, rule: Rule = Rule()) -> tuple[tuple[DataFrame, DataFrame], DataFrame, DataFrame]:
    """(model, scores: doc_id, lang, size_class, log_ppl of all docs, thresholds by language and size class)."""
    good = trusted_ids(labels)
    model, scored = learned(docs.select("doc_id", "lang", "text"), good)
    scores = stored(scored.select("doc_id", "lang", size_class().alias("size_class"), "log_ppl"), "scores")
    return model, scores, thresholds(scores, good, rule)


def _judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    kept = ~F.coalesce(F.col("log_ppl") > F.col("threshold"), F.lit(False))
    return _same(rows, limits, "inner").withColumn("kept", kept)


def classify(docs: DataFrame, labels: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, lang, log_ppl, threshold, kept for every row of docs."""
    _, scores, limits = fit(docs, labels, rule)
    return _judged(scores, limits).select("doc_id", "lang", "log_ppl", "threshold", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """docs without the rejected ones. Each is scored once, and stored with its score until the thresholds are known."""
    good = trusted_ids(labels)
    clear = apart(docs, [*OWN, "threshold", "kept", "size_class"])
    scored = stored(learned(clear, good)[1].withColumn("size_class", size_class()), "scored")
    limits = thresholds(scored.select("doc_id", "lang", "size_class", "log_ppl"), good, rule)
    return _judged(scored, limits).where("kept").select(*clear.columns).toDF(*docs.columns)
