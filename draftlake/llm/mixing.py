"""Mixing sources to target weights (native): temperature, bisection, budgeted block permutations.

The weight of a source is its share of tokens raised to an exponent and normalised. The exponent is the smallest in
[0, 1] (the flattest mixture) that keeps the entropy at or below its target and the repetition of any source at or
below its limit; it is found by bisection. The weights, in whole millionths, give every source a budget of tokens. A
source spends it on whole epochs, each a seeded permutation of its documents, and on the first part of one more.
The streams of all sources are cut into blocks in which each source has its share of block_tokens, and every block is
permuted once more.

Defined cases: a null source is a source of its own; a null or empty text counts one token (its end mark), and so no
source is without weight; rows of one doc_id, and rows without one that have equal
texts, tie in the permutation and go together; a very long text fills blocks of its own; an empty table gives no rows;
columns of the input that clash with new ones become input_<name>.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftlake.llm.common import WORD, apart, prefix_sums, stored

MILLION = 1_000_000
#: Rows of one source and epoch that one window sorts, on average.
SLICE_ROWS = 64


@dataclass(frozen=True)
class Mixture:
    target_entropy: float | None = 0.95  # as a part of the logarithm of the number of sources
    max_repeats: float | None = 4.0  # epochs of any source for one epoch of the least repeated
    budget_tokens: int | None = None  # None: the least at which every document is used once
    block_tokens: int = 65_536
    seed: int = 7


def token_count(text: Column) -> Column:
    return (F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) + 1).cast("long")


def _moments(shares: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float, float, float]]:
    """For each exponent: the sum of p^x, the sum of p^x ln p, and the largest and smallest p^(x-1)."""
    grid = F.explode(F.array(*[F.lit(x) for x in exponents]))
    rows = (
        shares.select("p", grid.alias("x"))
        .groupBy("x")
        .agg(F.sum(F.pow("p", "x")), F.sum(F.pow("p", "x") * F.log("p")), F.max(F.pow("p", F.col("x") - 1)), F.min(F.pow("p", F.col("x") - 1)))
        .collect()  # one row for each of 31 exponents
    )
    return {r[0]: tuple(r)[1:] for r in rows}


def solve_exponent(shares: DataFrame, m: Mixture, steps: int = 30) -> float:
    """Bisection; five halvings at a time, by looking at the 31 points that they could ask for."""
    sources = shares.count()
    if sources < 2:
        return 1.0
    most = math.inf if m.target_entropy is None else m.target_entropy * math.log(sources)
    limit = math.inf if m.max_repeats is None else m.max_repeats
    low, high = 0.0, 1.0
    for _ in range(steps // 5):
        points = [low + (high - low) * i / 32 for i in range(1, 32)]
        found = _moments(shares, points)
        ok = []
        for x in points:
            z, zl, largest, smallest = found[x]
            ok.append(math.log(z) - x * zl / z <= most and largest / smallest <= limit)
        k = ok.index(True) if True in ok else 31
        low, high = [low, *points][k], [*points, high][k]
    return round(high, 6)


def plan(slim: DataFrame, m: Mixture = Mixture()) -> DataFrame:
    """One row for each source: source, rows, tokens, weight_ppm, target, full (epochs), rest (tokens of the next)."""
    sums = stored(slim.groupBy("source").agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens")), "sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 1
    shares = sums.withColumn("p", F.col("tokens") / F.lit(float(total)))
    exponent = solve_exponent(shares, m)
    z = shares.agg(F.sum(F.pow("p", F.lit(exponent)))).first()[0] or 1.0
    weights = shares.withColumn("weight_ppm", F.greatest(F.lit(1), F.round(F.pow("p", F.lit(exponent)) / F.lit(z) * MILLION)).cast("long"))
    weights = stored(weights.drop("p"), "weights")
    wide = "CAST({} AS DECIMAL(38,0))".format
    budget = m.budget_tokens
    if budget is None:
        budget = weights.agg(F.max(F.expr(f"({wide('tokens')} * {MILLION} + weight_ppm - 1) DIV weight_ppm"))).first()[0] or 0
    return (
        weights.withColumn("target", F.expr(f"CAST({wide('weight_ppm')} * {int(budget)} DIV {MILLION} AS BIGINT)"))
        .withColumn("full", F.expr("target DIV tokens"))
        .withColumn("rest", F.expr("target - full * tokens"))
        .withColumn("block_share", F.greatest(F.lit(1), F.expr(f"CAST({wide('weight_ppm')} * {m.block_tokens} DIV {MILLION} AS BIGINT)")))
    )


def _ident() -> Column:
    """What tells documents apart: the id, or the text of one without id."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))


def _key(epoch: Column, seed: int, ident: Column) -> Column:
    """Orders the documents of one source and epoch."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), ident))


def schedule(docs: DataFrame, m: Mixture = Mixture(), carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): the mixture as doc_id, source, n_tokens, epoch, key, block, slot, weight_ppm and columns to carry along, without texts."""
    slim = stored(docs.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"), _ident().alias("_ident"), *carry), "tokens")
    weights = stored(plan(slim, m), "plan")
    by_source = weights.withColumnRenamed("source", "_source")
    rows = slim.join(by_source, slim["source"].eqNullSafe(by_source["_source"]))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    rows = rows.where("epoch < full OR rest > 0").withColumn("key", _key(F.col("epoch"), m.seed, F.col("_ident")))
    slices = F.greatest(F.lit(1), F.ceil(F.col("rows") / SLICE_ROWS))
    rows = rows.withColumn("_slice", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 4294967296.0 * slices).cast("long"))
    group = ["_id", "epoch"]
    rows = rows.withColumn("_id", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")))
    bases = prefix_sums(rows.groupBy(*group, "_slice").agg(F.sum("n_tokens").alias("_tokens")), "_slice", "_tokens", group)
    inside = Window.partitionBy(*group, "_slice")
    ranked = rows.withColumn("_upto", F.sum("n_tokens").over(inside.orderBy("key"))).withColumn("_peers", F.sum("n_tokens").over(inside.orderBy("key").rangeBetween(Window.currentRow, Window.currentRow)))
    placed = ranked.join(bases.select(*group, "_slice", "before"), [*group, "_slice"]).withColumn("start", F.col("before") + F.col("_upto") - F.col("_peers"))
    placed = placed.where("epoch < full OR start < rest").withColumn("block", F.expr("(epoch * tokens + start) DIV block_share"))
    slot = F.row_number().over(Window.partitionBy("block").orderBy(F.reverse("key"), "doc_id", "n_tokens")).cast("long") - 1
    return placed.select("doc_id", "source", "n_tokens", "epoch", "key", "block", slot.alias("slot"), "weight_ppm", *carry), weights


def mix(docs: DataFrame, m: Mixture = Mixture()) -> DataFrame:
    """docs with `epoch`: each row once for every time that the mixture uses it. Texts are not shuffled.

    What the partly used epoch of a source takes is the rows up to one key; that key is all that the rows need to know.
    """
    docs = apart(docs, ["epoch"])
    rows, weights = schedule(docs, m)
    last = rows.groupBy("source", "epoch").agg(F.max("key").alias("_last"))
    last = last.join(weights.select(F.col("source").alias("_s"), "full"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("full")), "right")
    cut = stored(last.select(F.col("_s").alias("_source"), F.col("full").alias("_full"), "_last"), "cuts")
    more = (F.coalesce(_key(F.col("_full"), m.seed, _ident()) <= F.col("_last"), F.lit(False))).cast("int")
    uses = F.when(F.col("_full") + more > 0, F.sequence(F.lit(0).cast("long"), F.col("_full") + more - 1)).otherwise(F.array().cast("array<long>"))
    return docs.join(cut, docs["source"].eqNullSafe(cut["_source"])).withColumn("epoch", F.explode(uses)).drop("_source", "_full", "_last")


def mix_in_order(docs: DataFrame, m: Mixture = Mixture()) -> DataFrame:
    """As mix, without `epoch`, in the order of blocks and of the slots in them: rows are dealt to partitions by ranges of blocks.

    Texts are stored with the number of their row, joined to its places, and sent to their blocks.
    """
    kept = docs.columns
    rows = stored(apart(docs, ["_row", "block", "slot"]).withColumn("_row", F.monotonically_increasing_id()), "rows")
    places, _ = schedule(rows, m, ("_row",))
    placed = rows.join(places.select("_row", "block", "slot"), "_row").repartitionByRange("block").sortWithinPartitions("block", "slot")
    return placed.drop("_row", "block", "slot").toDF(*kept)
