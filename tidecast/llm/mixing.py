"""Mixing sources to target weights, with DataFrame functions only.

A source's share of all tokens is raised to an exponent between 0 (all sources alike) and 1 (as they are).
The exponent is bisected: the largest at which the weights reach a target entropy, or, if that would repeat
a source too often, the smallest that keeps to the repetition limit. Weights become token budgets, and a
budget is realised as a permutation of blocks: a source's documents are dealt into blocks, every epoch
visits the blocks, and the documents in them, in a new order, and the last epoch ends where the budget does.

Running sums go over block totals first and inside one block then, so a source with most of the documents
is spread over its blocks. Orders are MD5 sums of ids, epoch and seed, the same on every run.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.session import stage

#: Words as the other operators take them: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Exponents that one pass over the source totals tries; each round narrows the range to one step of it.
GRID, ROUNDS = 32, 4


@dataclass(frozen=True)
class Target:
    """What a mix aims at.

    ``entropy`` is the share of the largest possible entropy, ``repetition`` the most that any source may
    be repeated against the least repeated one. ``budget`` is the number of tokens to deal out; without it,
    it is the smallest at which every document is used once.
    """

    entropy: float = 0.97
    repetition: float = 2.0
    budget: int | None = None
    block_tokens: int = 1_000_000
    seed: int = 1


def counted(documents: DataFrame) -> DataFrame:
    """``doc_id, source, n_tokens`` of every document; a null source counts as the empty one."""
    return documents.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"),
    )


def exponent(totals: DataFrame, target: Target) -> float:
    """The exponent for ``totals(source, tokens)``; sources without tokens do not count. 1 if there is none."""
    every = totals.agg(F.sum("tokens")).head()[0]
    if not every:
        return 1.0
    shares = totals.filter("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(every)))

    def tried(values: list[float]) -> list:
        power = F.pow("share", F.col("a"))
        rows = shares.withColumn("a", F.explode(F.array(*map(F.lit, values))))
        sums = rows.groupBy("a").agg(
            F.sum(power).alias("z"),
            F.sum(power * F.log("share")).alias("e"),
            F.count("*").alias("n"),
            F.max("share").alias("most"),
            F.min("share").alias("least"),
        )
        return sums.select(
            "a",
            (F.log("z") - F.col("a") * F.col("e") / F.col("z") >= target.entropy * F.log("n")).alias("even"),
            (F.pow(F.col("most") / F.col("least"), 1 - F.col("a")) <= target.repetition).alias("rare"),
        ).orderBy("a").collect()

    def bisect(low: float, high: float, name: str, rising: bool) -> float:
        """The end of the range where the condition still holds (``rising``: it holds at the upper end)."""
        for _ in range(ROUNDS):
            step = (high - low) / GRID
            rows = tried([low + step * i for i in range(GRID)] + [high])
            holds = [row["a"] for row in rows if row[name]]
            if not holds:
                return high if rising else low
            if rising:
                low, high = max(low, holds[0] - step), holds[0]
            else:
                low, high = holds[-1], min(high, holds[-1] + step)
        return high if rising else low

    # To four digits, on the side where the condition holds.
    even, rare = bisect(0.0, 1.0, "even", False), bisect(0.0, 1.0, "rare", True)
    return max(math.floor(even * 1e4 + 1e-6) / 1e4, math.ceil(rare * 1e4 - 1e-6) / 1e4)


def budgets(rows: DataFrame, target: Target) -> DataFrame:
    """``source, tokens, blocks, budget, epochs`` of every source of ``rows(doc_id, source, n_tokens)``.

    A source without tokens has the budget 0 and one epoch, so that its documents stay once. Another source
    whose budget is 0 has no epoch.
    """
    totals = stage(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    a, every = exponent(totals, target), totals.agg(F.sum("tokens")).head()[0] or 1
    power = F.pow(F.col("tokens") / F.lit(float(every)), F.lit(a))
    shared = totals.withColumn("power", F.when(F.col("tokens") > 0, power).otherwise(0.0))
    sums = shared.agg(F.sum("power").alias("z"), F.max(F.col("tokens") / F.nullif("power", F.lit(0.0))).alias("cover")).head()
    z = sums["z"] or 1.0
    shared = shared.withColumn("weight", F.col("power") / F.lit(z))
    if target.budget is None:
        # The source that is repeated least is used exactly once.
        total, least = F.lit(float((sums["cover"] or 0.0) * z)), F.col("tokens")
    else:
        total, least = F.lit(float(target.budget)), F.lit(0)
    shared = shared.withColumn("budget", F.greatest(F.round(F.col("weight") * total).cast("long"), least))
    shared = shared.withColumn("budget", F.when(F.col("tokens") > 0, F.col("budget")).otherwise(F.lit(0)))
    return stage(
        shared.select(
            "source",
            "tokens",
            F.greatest(F.lit(1), F.ceil(F.col("tokens") / target.block_tokens)).cast("long").alias("blocks"),
            "budget",
            F.when(F.col("tokens") > 0, F.ceil(F.col("budget") / F.col("tokens")))
            .otherwise(F.lit(1))
            .cast("int")
            .alias("epochs"),
        )
    )


def _key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def _block(target: Target) -> Column:
    number = F.conv(F.substring(_key(F.col("doc_id"), F.lit(target.seed)), 1, 8), 16, 10).cast("long")
    return F.pmod(number, F.col("blocks"))


def _block_key(target: Target, epoch: Column) -> Column:
    return _key(F.col("source"), F.col("block"), epoch, F.lit(target.seed))


def _doc_key(target: Target, epoch: Column) -> Column:
    return _key(F.col("doc_id"), epoch, F.lit(target.seed))


def _placed(rows: DataFrame, budget: DataFrame, target: Target) -> DataFrame:
    """Every document of every epoch with its block and ``start``, the tokens of its source before it."""
    dealt = rows.join(budget, "source").withColumn("block", _block(target))
    sums = dealt.groupBy("source", "block", "epochs", "tokens").agg(F.sum("n_tokens").alias("held"))
    sums = sums.withColumn("epoch", F.explode(F.expr("sequence(0, epochs - 1)")))
    sums = sums.withColumn("block_key", _block_key(target, F.col("epoch")))
    order = Window.partitionBy("source", "epoch").orderBy("block_key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("held").over(order), F.lit(0)) + F.col("epoch") * F.col("tokens")
    sums = sums.select("source", "block", "epoch", "block_key", before.cast("long").alias("before"))
    visits = dealt.select("doc_id", "source", "n_tokens", "block", "budget", "epochs").join(sums, ["source", "block"])
    visits = visits.withColumn("doc_key", _doc_key(target, F.col("epoch")))
    inside = Window.partitionBy("source", "epoch", "block").orderBy("doc_key", "n_tokens")
    earlier = F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return visits.withColumn("start", F.col("before") + F.coalesce(earlier, F.lit(0)))


def _used() -> Column:
    """The budget reaches the document; one without tokens is also used where the budget ends."""
    return (F.col("start") < F.col("budget")) | ((F.col("n_tokens") == 0) & (F.col("start") <= F.col("budget")))


def mix(documents: DataFrame, target: Target = Target()) -> DataFrame:
    """``doc_id, source, epoch, block, start, n_tokens``: the mixed documents in their sources' order.

    ``documents`` has ``doc_id, source, text``; other columns are ignored. A row stands for one use of a
    document; ordered by ``start`` in a source, epochs and blocks follow one another. The last document may
    reach beyond the budget. A null or empty text has no token and is used where its place is reached; a
    null source is the empty one; a null id is an id of its own. Rows that repeat an id are all used, one
    after the other. An empty table gives no row.
    """
    rows = stage(counted(documents))
    placed = _placed(rows, budgets(rows, target), target).filter(_used())
    return placed.select("doc_id", "source", "epoch", "block", "start", "n_tokens")


def mixed_documents(documents: DataFrame, target: Target = Target()) -> DataFrame:
    """The documents with all their columns, each as often as the mix uses it.

    Only the last document that each source's budget reaches is looked up; whether a document comes before
    it in the last epoch is seen from its own keys, so texts are not shuffled. Rows that repeat an id are
    used alike.
    """
    rows = stage(counted(documents))
    budget = budgets(rows, target)
    final = _placed(rows, budget, target).filter((F.col("epoch") == F.col("epochs") - 1) & _used())
    ends = final.groupBy("source").agg(F.max(F.struct("block_key", "doc_key")).alias("end"))
    ends = stage(budget.join(ends, "source", "left").withColumnRenamed("source", "mix_source"))
    names = documents.columns
    taken = documents.select(F.struct(*names).alias("row"), "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    taken = taken.join(ends, F.col("source") == F.col("mix_source")).withColumn("block", _block(target))
    last = F.col("epochs") - 1
    reached = F.struct(
        _block_key(target, last).alias("block_key"), _doc_key(target, last).alias("doc_key")
    ) <= F.col("end")
    uses = last + F.coalesce(reached, F.lit(False)).cast("int")
    taken = taken.withColumn("use", F.explode(F.when(uses > 0, F.sequence(F.lit(1), uses)).otherwise(F.array().cast("array<int>"))))
    return taken.select("row.*")
