"""Mixing sources to target weights, in DataFrame functions only.

Temperature mixing: a source with share p of the tokens gets the weight p**a / sum(p**a).
The exponent a is bisected between 1 (shares as they are) and 0 (all alike): the least
that keeps every source within a repetition limit, or the weights within a target
entropy. Weights become a number of epochs for each source, and each epoch a
permutation of the source's blocks, and of the documents inside each block, by hash;
the last epoch ends where the source's token budget does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from overlapse.workspace import materialise, remove

MAX_REPEATS = 2.0
SEED = 17
#: Levels of bisection, and how many of them one pass over the sources evaluates.
LEVELS, AT_ONCE = 40, 4
#: Sources that are broadcast at most; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, key): words of each whole text; key names the row's id and text."""
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text)))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"), key.alias("key"))


def source_table(rows: DataFrame) -> DataFrame:
    """(source, tokens, n_docs, blocks): blocks and the rows in one are both about the root of n_docs."""
    sums = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    return sums.withColumn("blocks", F.ceil(F.sqrt("n_docs")).cast("long"))


@dataclass(frozen=True)
class Mixture:
    exponent: float
    budget: float  # tokens in all
    total: int
    scale: float  # sum of p ** exponent


def solve(sources: DataFrame, max_repeats: float | None, entropy: float | None, budget: float | None) -> Mixture:
    """Bisection over one pass of sums for every four levels; the sources stay distributed.

    Without a budget, it is the least that takes every source once or more: that of
    the largest source's one epoch.
    """
    some = sources.filter("tokens > 0")
    head = some.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).head()
    if not head[0]:
        return Mixture(1.0, 0.0, 0, 1.0)
    total, least, most = head[0], head[1] / head[0], head[2] / head[0]
    p = F.col("tokens") / F.lit(total)

    def sums(points: list[float]) -> list[tuple[float, float]]:
        cols = [c for a in points for c in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p)))]
        row = some.agg(*cols).head()
        return [(row[2 * i], row[2 * i + 1]) for i in range(len(points))]

    def fits(a: float, z: float, e: float) -> bool:
        """Whether weights at exponent ``a`` keep the limit."""
        if entropy is not None:
            return math.log(z) - a * e / z <= entropy
        if max_repeats is None:
            return True
        if budget is None:
            return (most / least) ** (1 - a) <= max_repeats
        return budget / total * least ** (a - 1) / z <= max_repeats

    low, high = 0.0, 1.0
    if fits(0.0, *sums([0.0])[0]):
        high = 0.0
    else:
        for _ in range(LEVELS // AT_ONCE):
            width = (high - low) / (1 << AT_ONCE)
            points = [low + width * i for i in range(1, 1 << AT_ONCE)]
            known = dict(zip(range(1, 1 << AT_ONCE), zip(points, sums(points), strict=True), strict=True))
            lo, hi = 0, 1 << AT_ONCE
            while hi - lo > 1:
                mid = (lo + hi) // 2
                a, (z, e) = known[mid]
                lo, hi = (lo, mid) if fits(a, z, e) else (mid, hi)
            low, high = low + width * lo, low + width * hi
    z = sums([high])[0][0]
    return Mixture(high, budget if budget is not None else total * z * most ** (1 - high), total, z)


def with_epochs(sources: DataFrame, mix: Mixture) -> DataFrame:
    """``sources`` with weight and epochs; a source without a token is taken once, at weight 0."""
    p = F.col("tokens") / F.lit(max(1, mix.total))
    weight = F.when(F.col("tokens") > 0, F.pow(p, F.lit(mix.exponent)) / F.lit(mix.scale)).otherwise(0.0)
    return sources.withColumn("weight", weight).withColumn("epochs", F.when(F.col("tokens") > 0, F.col("weight") * F.lit(mix.budget) / F.col("tokens")).otherwise(1.0))


def block_of(key: Column, blocks: Column) -> Column:
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), blocks)


def turn(epoch: Column, source: Column, block: Column, key: Column) -> Column:
    """Where a row stands in its source's permutation in an epoch: by its block's hash, then its own."""
    name = F.coalesce(source, F.lit(""))
    of_block = F.md5(F.concat_ws("|", F.lit(SEED), epoch, name, block))
    return F.struct(of_block.alias("of_block"), block.alias("block"), F.md5(F.concat_ws("|", F.lit(SEED), epoch, key)).alias("own"), key.alias("key"))


def joined(rows: DataFrame, sources: DataFrame) -> DataFrame:
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    named = sources.withColumnRenamed("source", "_s")
    return rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def permuted(rows: DataFrame, sources: DataFrame, last_only: bool = False) -> DataFrame:
    """A row an epoch: ``before`` are the tokens of the source that come before it in that epoch.

    Windows run over a block's rows, and over a source's blocks: neither holds more than
    about the root of the source's rows.
    """
    at = joined(rows, sources.select("source", "tokens", "blocks", "epochs")).withColumn("block", block_of(F.col("key"), F.col("blocks")))
    top = F.ceil("epochs").cast("int") - 1
    epochs = F.array(top) if last_only else F.sequence(F.lit(0), top)
    each = at.filter("epochs > 0").withColumn("epoch", F.explode(epochs)).withColumn("turn", turn(F.col("epoch"), F.col("source"), F.col("block"), F.col("key")))
    group = ["source", "epoch", "turn.of_block", "block"]
    inner = W.partitionBy("source", "epoch", "block").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    each = each.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    totals = each.groupBy("source", "epoch", F.col("turn.of_block").alias("of_block"), "block").agg(F.sum("n_tokens").alias("size"))
    outer = W.partitionBy("source", "epoch").orderBy("of_block", "block").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.withColumn("start", F.coalesce(F.sum("size").over(outer), F.lit(0))).select(F.col("source").alias("_s"), F.col("epoch").alias("_e"), F.col("block").alias("_b"), "start")
    out = each.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e")) & (F.col("block") == F.col("_b")))
    return out.withColumn("before", F.col("start") + F.col("inside")).drop("_s", "_e", "_b", *group[2:3])


def in_budget() -> Column:
    """All of a full epoch; of the last, what begins before the rest of the source's budget is used up."""
    rest = (F.col("epochs") - F.col("epoch")) * F.col("tokens")
    return (F.col("epochs") >= F.col("epoch") + 1) | (F.col("before") < rest)


def mix_schedule(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """A row for each time that a document is taken: doc_id, source, n_tokens, epoch, block, slot.

    Ordered by slot (0 to 1, the share of the source's budget used before), every stretch
    of the mixture has the target weights. A null text has no token; a null source is
    a source of its own. Repeated rows are taken one by one; a null doc_id is allowed.
    An empty table gives an empty result; other columns are not read.
    """
    rows = materialise(measured(docs), "mix-rows")
    sources = materialise(source_table(rows), "mix-sources")
    planned = with_epochs(sources, solve(sources, max_repeats, entropy, budget))
    taken = permuted(rows, planned).filter(in_budget())
    used = F.col("epoch") * F.col("tokens") + F.col("before")
    slot = F.when(F.col("tokens") > 0, F.round(used / (F.col("epochs") * F.col("tokens")), 6)).otherwise(0.0)
    return taken.select("doc_id", "source", "n_tokens", F.col("epoch").cast("int").alias("epoch"), F.col("block").cast("long").alias("block"), slot.alias("slot"))


def mix_documents(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it, with the columns of ``docs``.

    Texts aren't shuffled: only the place where each source's last epoch ends is looked up.
    """
    names = docs.columns
    at = {c: f"_c{i}" for i, c in enumerate(names)}
    rows = materialise(measured(docs), "mix-rows")
    sources = materialise(source_table(rows), "mix-sources")
    planned = with_epochs(sources, solve(sources, max_repeats, entropy, budget))
    ends = permuted(rows, planned, last_only=True).filter(in_budget()).groupBy("source").agg(F.max("turn").alias("end"))
    ends = ends.select(F.col("source").alias("_s"), "end")
    limits = materialise(planned.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "blocks", "epochs", "end"), "mix-limits")
    remove(rows)
    remove(sources)
    text = F.coalesce(F.col(at["text"]), F.lit(""))
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(at["doc_id"]).cast("string"), F.lit("")), F.md5(text)))
    whole = docs.select(*[F.col(f"`{c}`").alias(at[c]) for c in names]).withColumns({"source": F.col(at["source"]).cast("string"), "key": key})
    placed = joined(whole, limits).withColumn("block", block_of(F.col("key"), F.col("blocks")))
    top = F.ceil("epochs").cast("int") - 1
    last = turn(top, F.col("source"), F.col("block"), F.col("key")) <= F.col("end")
    copies = F.greatest(top, F.lit(0)) + F.coalesce(last, F.lit(False)).cast("int")
    return placed.withColumn("_n", copies).filter("_n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*[F.col(at[c]).alias(c) for c in names])
