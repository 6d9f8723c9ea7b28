"""Mixing sources to target weights with capped repetition (problem 8).

The plan needs only the token sum of each source. Weights are tempered shares: w ** a, divided
by their sum, where the exponent a is bisected until an entropy or a repetition limit is met.
The plan becomes passes over the documents: full passes, and one partial pass that takes hash
blocks in their order until the source's budget is spent.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Literal

from pyspark.sql import DataFrame, Window, functions as F

from rankweave.session import Workspace

#: Tokens that a block of a partial pass holds on average; only one block is cut inside.
BLOCK_TOKENS = 200_000


def tempered(shares: Sequence[float], exponent: float) -> list[float]:
    """Shares to the power of ``exponent``, divided by their sum; a share of 0 stays 0."""
    top = max(shares, default=0.0)
    raised = [(s / top) ** exponent if s > 0 else 0.0 for s in shares]
    whole = sum(raised)
    return [r / whole for r in raised] if whole else list(raised)


def entropy(shares: Sequence[float]) -> float:
    return -sum(s * math.log(s) for s in shares if s > 0)


def bisect_exponent(shares: Sequence[float], holds, low: float = 0.0, high: float = 1.0) -> float:
    """Greatest exponent in [low, high] for which ``holds(tempered shares)``, low if none does."""
    if holds(tempered(shares, high)):
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if holds(tempered(shares, mid)) else (low, mid)
    return low


def exponent_for_entropy(shares: Sequence[float], target: float) -> float:
    """Exponent between 0 (even) and 8 (peaked) whose tempered shares have the target entropy."""
    low, high = 0.0, 8.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(tempered(shares, mid)) > target else (low, mid)
    return (low + high) / 2


@dataclass(frozen=True)
class Budget:
    source: str
    weight: float
    tokens: int
    max_repeats: int
    budget: float
    limited: bool
    exponent: float


def plan(sources: Sequence[tuple[str, float, int, int]], total: float) -> list[Budget]:
    """Budgets of ``(source, weight, max_repeats, tokens)`` for a mixture of ``total`` tokens.

    A source whose tokens times max_repeats are less than weight times total is limited: it gives
    all it may. What is missing then goes to the other sources by tempered weights, with the
    greatest exponent up to 1 (1 keeps the proportions of the weights) at which none of them
    exceeds its repetition limit; where even equal shares exceed one, that source is filled and
    the rest is shared again. If all are filled the mixture is smaller than ``total``.
    """
    room = {s: float(t * m) for s, _, m, t in sources}
    weight = {s: w for s, w, _, _ in sources}
    limited = {s for s, w, _, _ in sources if room[s] < w * total}
    budget = {s: min(room[s], weight[s] * total) for s in room}
    exponent = 1.0
    free = [s for s in room if s not in limited]
    missing = total - sum(budget.values())
    while free and missing > 0.5:
        names = sorted(free)
        base = [weight[s] for s in names]

        def fits(q: Sequence[float], names=names, missing=missing) -> bool:
            return all(budget[s] + x * missing <= room[s] + 1e-6 for s, x in zip(names, q, strict=True))

        exponent = bisect_exponent(base, fits)
        q = tempered(base, exponent)
        if not any(q):
            break
        given = {s: min(room[s] - budget[s], x * missing) for s, x in zip(names, q, strict=True)}
        for s, x in given.items():
            budget[s] += x
        missing -= sum(given.values())
        free = [s for s in free if budget[s] < room[s] - 1e-6]
    return [Budget(s, w, t, m, budget[s], s in limited, exponent) for s, w, m, t in sources]


def tempered_weights(sources: Sequence[tuple[str, float, int, int]], total: float, entropy: float | None = None) -> list[tuple[str, float]]:
    """Weights from the sources' own token shares, raised to one exponent between 0 and 1.

    With ``entropy`` (nats) the exponent that reaches it, or the nearest end. Without it the least
    exponent, which favours small sources most, at which none has to be repeated more often than it
    may; where even the shares themselves ask for more, they stay as they are. Given weights play no
    part. Sources without tokens have weight 0.
    """
    own = [float(t) for *_, t in sources]
    if not sum(own):
        return [(s, 0.0) for s, *_ in sources]
    shares = [x / sum(own) for x in own]

    def fits(exponent: float) -> bool:
        return all(q * total <= m * t + 1e-6 for q, (*_, m, t) in zip(tempered(shares, exponent), sources, strict=True) if t)

    if entropy is not None:
        exponent = exponent_for_entropy(shares, entropy)
    else:
        low, high = 0.0, 1.0
        if fits(low) or not fits(high):
            high = low if fits(low) else high
        else:
            for _ in range(60):
                mid = (low + high) / 2
                low, high = (low, mid) if fits(mid) else (mid, high)
        exponent = high
    return [(s, q) for (s, *_), q in zip(sources, tempered(shares, exponent), strict=True)]


def token_sums(docs: DataFrame, source: str, tokens: str, targets: DataFrame) -> list[tuple[str, float, int, int]]:
    """``(source, weight, max_repeats, tokens)`` of each target; one row per source is collected."""
    sums = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(f"`{tokens}`").alias("t"))
    rows = targets.join(sums, "source", "left").select(
        "source", F.coalesce("weight", F.lit(0.0)), F.coalesce("max_repeats", F.lit(0)), F.coalesce("t", F.lit(0))
    )
    return sorted((r[0], float(r[1]), int(r[2]), int(r[3])) for r in rows.collect())


def mix(
    docs: DataFrame, doc: str, source: str, tokens: str, targets: DataFrame, total: int | None = None, seed: int = 0,
    temper: float | Literal["limits"] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report: two DataFrames.

    The mixture has ``source, doc, repeats, tokens``: a document is used ``repeats`` times. The
    report has ``source, weight, tokens, max_repeats, budget, used, share, limited`` for each
    target. Documents of a source that is not listed, of null source or without tokens take no
    part. ``total`` is the size aimed at, by default the tokens of all listed documents. With
    ``temper`` the weights come from the sources' token shares instead, see ``tempered_weights``:
    a number is the entropy aimed at, ``limits`` evens sources out as far as repetition allows.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mix")
    slim = docs.select(
        F.col(f"`{doc}`").alias("_d"), F.col(f"`{source}`").alias("source"), F.col(f"`{tokens}`").cast("bigint").alias("_n")
    ).where("_n > 0 AND source IS NOT NULL AND _d IS NOT NULL")
    listed = targets.where("source IS NOT NULL").groupBy("source").agg(
        F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats")
    )
    slim = ws.keep(slim.join(F.broadcast(listed.select("source")), "source", "left_semi"), "docs")
    sources = token_sums(slim, "source", "_n", listed)
    total = total if total is not None else sum(t for *_, t in sources)
    if temper is not None:
        weights = tempered_weights(sources, total, None if temper == "limits" else temper)
        sources = [(s, w, m, t) for (s, w), (*_, m, t) in zip(weights, sources, strict=True)]
    budgets = plan(sources, total)
    rows = []
    for b in budgets:
        full = min(b.max_repeats, int(b.budget // b.tokens)) if b.tokens else 0
        rest = b.budget - full * b.tokens if full < b.max_repeats else 0.0
        rows.append((b.source, full, int(rest + 1e-3), max(1, round(b.tokens / BLOCK_TOKENS))))
    passes = F.broadcast(spark.createDataFrame(rows, "source string, _full int, _rest bigint, _blocks bigint"))
    # The permutation of the partial pass: blocks by hash, inside a block by another hash.
    placed = slim.join(passes, "source").withColumn(
        "_block", F.pmod(F.xxhash64(F.lit(seed), "_d"), F.col("_blocks"))
    )
    block = placed.groupBy("source", "_block").agg(F.sum("_n").alias("_b"))
    # what stands before a block, in two levels: ranges of its hash, then the blocks of a range
    hash_ = F.xxhash64(F.lit(seed), "_block")
    block = block.withColumn("_h", hash_).withColumn("_range", F.shiftright("_h", 52))
    ranges = block.groupBy("source", "_range").agg(F.sum("_b").alias("_rb"))  # 4,096 a source at most
    above = F.sum("_rb").over(Window.partitionBy("source").orderBy("_range")) - F.col("_rb")
    ranges = ranges.select("source", "_range", above.alias("_above"))
    upto = Window.partitionBy("source", "_range").orderBy("_h", "_block")
    block = block.withColumn("_within", F.sum("_b").over(upto) - F.col("_b")).join(ranges, ["source", "_range"])
    block = block.select("source", "_block", "_b", (F.col("_above") + F.col("_within")).alias("_before"))
    placed = placed.join(block, ["source", "_block"])
    whole = F.col("_before") + F.col("_b") <= F.col("_rest")
    cut = ~whole & (F.col("_before") < F.col("_rest"))
    inside = Window.partitionBy("source", "_block").orderBy(F.xxhash64(F.lit(seed + 1), "_d"), "_d")
    edge = placed.where(cut).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    edge = edge.withColumn("_more", (F.col("_upto") <= F.col("_rest")).cast("int")).drop("_upto")
    rest = placed.where(~cut).withColumn("_more", whole.cast("int"))
    mixture = (
        rest.unionByName(edge)
        .select("source", F.col("_d").alias(doc), (F.col("_full") + F.col("_more")).alias("repeats"), F.col("_n").alias("tokens"))
        .where("repeats > 0")
    )
    mixture = ws.keep(mixture, "mixture")
    used = mixture.groupBy("source").agg(F.sum(F.col("repeats") * F.col("tokens")).alias("used"))
    facts = spark.createDataFrame(
        [(b.source, b.weight, b.tokens, b.max_repeats, b.budget, b.limited) for b in budgets],
        "source string, weight double, tokens bigint, max_repeats int, budget double, limited boolean",
    )
    report = facts.join(F.broadcast(used), "source", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    all_ = report.agg(F.sum("used").alias("_all"))
    report = report.crossJoin(F.broadcast(all_)).select(
        "source", "weight", "tokens", "max_repeats", "budget", "used",
        F.coalesce(F.try_divide("used", "_all"), F.lit(0.0)).alias("share"), "limited",
    )
    return mixture, report
