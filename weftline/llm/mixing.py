"""Mixing sources to target weights: a temperature, then budgeted block permutations.

Each source's share of the tokens is raised to an exponent and the weights are normalised.  The
exponent, from 1 (as is) to 0 (all alike), is bisected: the largest one whose weights reach the target
entropy (a part of the largest possible), but none that repeats a source more than ``most`` times on
average; the limit wins.  The budget is in tokens; by default it is the smallest for which every source
is used once at least, so that no document is left out.

A source's quota is its weight times the budget.  Its documents are dealt into blocks of about
``block_tokens`` by a hash of their ids and texts.  Every pass over a source takes its blocks in a new
random order, and the documents of a block in a new order; passes follow one another until the quota
is filled, and the last block is cut where it is.  The place of a block is a prefix sum in two levels:
the random order is cut into ranges, about the square root of the blocks, whose sums are added up
first, then the blocks within each range.  So no task orders a whole source: what one window holds
grows with the square root of a source's blocks, and the documents of one block are sorted in one task.

``slot`` places a row in its source's quota (0 to below 1): sorted by it, all sources are mixed at
their weights throughout.  A null source is treated as the source '', and its rows keep the null.  Null
and empty texts have no tokens; they come with their source.  A source without any token has no weight:
its rows are given once, with copy 0, block 0 and a null slot.  Rows with null or repeated ids are dealt
by their texts; wholly equal rows share a block.  Long texts are only counted.  An empty table gives no
rows.  The columns of ``docs`` are carried as one struct, so they may have any names; of the four
that are added, those whose names are taken are called ``mixed_n_tokens``, ``mixed_copy`` and so on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import staged

#: rows of about 60 bytes
BROADCAST_ROWS = 500_000


def n_words(text: Column) -> Column:
    """Words between ASCII white space, as a count of tokens."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def weights_at(tokens: np.ndarray, exponent: float) -> np.ndarray:
    logs = exponent * np.log(tokens / tokens.sum())
    raw = np.exp(logs - logs.max())
    return raw / raw.sum()


def entropy(weights: np.ndarray) -> float:
    return float(-(weights * np.log(np.maximum(weights, 1e-300))).sum())


def exponent_for(tokens: np.ndarray, target: float, most: float, budget: float | None) -> tuple[float, float]:
    """The exponent, and the budget that it asks for."""

    def total(x: float) -> float:
        return float((tokens / weights_at(tokens, x)).max()) if budget is None else budget

    def flat(x: float) -> bool:
        return entropy(weights_at(tokens, x)) >= target * np.log(len(tokens)) - 1e-12

    def fits(x: float) -> bool:
        return bool((weights_at(tokens, x) * total(x) <= most * tokens * (1 + 1e-9)).all())

    def bisected(test, low: float, high: float) -> tuple[float, float]:
        """Ends of a tiny interval; ``test`` holds at its lower end, or below all of it."""
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if test(middle) else (low, middle)
        return low, high

    exponent = 1.0 if flat(1.0) else bisected(flat, 0.0, 1.0)[0]
    if not fits(exponent):  # towards 1 sources are repeated less
        exponent = bisected(lambda x: not fits(x), exponent, 1.0)[1]
    return exponent, total(exponent)


def plan_of(sizes: DataFrame, target: float, most: float, budget: int | None, block_tokens: int) -> DataFrame:
    """Source, tokens, quota and number of blocks; ``sizes`` (s, t) is staged and has tokens only.

    The totals, 8 bytes a source, are what the driver gets; the names stay where they are.
    """
    tokens = sizes.orderBy("t").toArrow().column("t").to_numpy().astype(float)
    if not len(tokens):
        return sizes.select("s", "t", F.lit(0).cast("long").alias("q"), F.lit(1).cast("long").alias("n"))
    exponent, full = exponent_for(tokens, target, most, budget)
    share = F.exp(F.lit(exponent) * F.log(F.col("t") / float(tokens.sum())))
    norm = float(np.exp(exponent * np.log(tokens / tokens.sum())).sum())
    quota = F.least(F.rint(share * (full / norm)), F.floor(F.lit(float(most)) * F.col("t"))).cast("long")
    return sizes.select("s", "t", quota.alias("q"), F.ceil(F.col("t") / block_tokens).cast("long").alias("n"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mix_sources(docs: DataFrame, target: float = 0.9, most: float = 4.0, budget: int | None = None, block_tokens: int = 200_000, seed: int = 11, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, once for each use, with n_tokens, copy (0, 1, ...), block and slot."""
    taken = {c.lower() for c in docs.columns}
    names = [x if x not in taken else f"mixed_{x}" for x in ("n_tokens", "copy", "block", "slot")]
    key = F.xxhash64(F.col(doc_id), F.col(text))
    rows = docs.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"), n_words(F.col(text)).alias("n_tokens"), key.alias("h"), F.struct("*").alias("row"))
    sizes = staged(rows.groupBy("s").agg(F.sum("n_tokens").alias("t")), "sizes")
    plan = _small(staged(plan_of(sizes.filter("t > 0"), target, most, budget, block_tokens), "plan"))
    dealt = rows.join(plan, "s").withColumn("block", F.pmod(F.xxhash64("h", F.lit(seed)), "n"))
    blocks = staged(dealt.groupBy("s", "t", "q", "n", "block").agg(F.sum("n_tokens").alias("b")), "blocks")
    passes = blocks.filter("q > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("q") / F.col("t")).cast("int") - 1)))
    passes = passes.withColumn("o", F.xxhash64("s", "copy", "block", F.lit(seed))).withColumn("r", F.pmod("o", F.ceil(F.sqrt("n")).cast("long")))
    passes = staged(passes, "passes")
    ranges = passes.groupBy("s", "copy", "r").agg(F.sum("b").alias("b"))
    ranges = ranges.selectExpr("s", "copy", "r", "coalesce(sum(b) over (partition by s, copy order by r rows between unbounded preceding and 1 preceding), 0) as low")
    inside = passes.selectExpr("*", "coalesce(sum(b) over (partition by s, copy, r order by o, block rows between unbounded preceding and 1 preceding), 0) as up")
    placed = inside.join(_small(staged(ranges, "ranges")), ["s", "copy", "r"]).withColumn("before", F.expr("copy * t + low + up"))
    placed = staged(placed.filter("before < q or b = 0 and before <= q").select("s", "block", "copy", "before"), "placed")
    order = f"partition by s, copy, block order by xxhash64(h, copy, {seed}), h rows between unbounded preceding and current row"
    used = dealt.join(_small(placed), ["s", "block"]).withColumn("upto", F.expr(f"before + sum(n_tokens) over ({order})")).filter("upto <= q")
    slot = (F.col("upto") - F.col("n_tokens")) / F.col("q")
    added = [F.col("n_tokens").alias(names[0]), F.col("copy").alias(names[1]), F.col("block").alias(names[2]), slot.alias(names[3])]
    idle = _small(staged(sizes.filter("t = 0").select("s"), "idle"))
    alone = [F.col("n_tokens").alias(names[0]), F.lit(0).alias(names[1]), F.lit(0).cast("long").alias(names[2]), F.lit(None).cast("double").alias(names[3])]
    return used.select("row.*", *added).union(rows.join(idle, "s").select("row.*", *alone))
