"""Per-key results where a few keys hold most rows.

``key_profile`` gives totals, weighted means and exact quantiles per key. Hot keys cost no
more than others:

* sums and counts are algebraic, so each task combines its own rows before the shuffle;
* quantiles come from value histograms that are refined until each rank is resolved. Equal
  values are first merged into cells, cells are spread over salts by value, each round counts
  the cells of a key in ``BINS`` bins of the bracket still open, and only those counts meet.
  The values of a hot key never come together in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankweave.session import Workspace

#: Bins of one histogram round. A rank among values v distinct values is resolved after about
#: log(v) / log(BINS) rounds, and a bracket always loses its other bins.
BINS = 256
#: Cells of one key that may share a join key; a key with more is spread over several.
CELLS = 200_000


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], weight: str | None = None
) -> DataFrame:
    """Exact discrete quantiles per key: ``keys..., q, value, rows``.

    The q-quantile is the smallest value whose cumulated weight reaches ``q`` of the key's
    weight (weight 1 a row unless ``weight`` names a whole-number column; null and negative
    weights count as 0). Rows with a null or NaN value are ignored; a key without a value or
    without weight has no row; a null key is a key of its own. An empty table gives no row.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "quantiles")
    w = F.lit(1) if weight is None else F.greatest(F.coalesce(F.col(f"`{weight}`"), F.lit(0)), F.lit(0))
    names = [f"_k{i}" for i in range(len(keys))]
    cells = (
        df.select(
            *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)],
            # -0.0 and 0.0 are one value
            (F.col(f"`{value}`").cast("double") + F.lit(0.0)).alias("_v"),
            w.cast("bigint").alias("_w"),
        )
        .where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.col("_w") > 0))
        .groupBy(*names, "_v")
        .agg(F.sum("_w").alias("_w"))
    )
    cells = ws.keep(cells, "cells")
    salts = F.expr(f"int(count(1) div {CELLS}) + 1").alias("_salts")
    start = cells.groupBy(*names).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_w").alias("_n"), salts)
    start = ws.keep(start, "start")
    # at most (cells) / CELLS keys are that large, which bounds the broadcast
    large = start.where("_salts > 1").select(*[F.col(c).alias(f"{c}h") for c in names], F.col("_salts").alias("_of"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}h")) for c in names])
    cells = cells.join(F.broadcast(large), same, "left").select(
        *names, "_v", "_w", F.pmod(F.xxhash64("_v"), F.coalesce("_of", F.lit(1))).cast("int").alias("_salt")
    )
    q = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("_q")
    n, p = F.col("_n"), F.col("_q")
    rank = F.greatest(F.lit(1), n - F.floor(n - p * n)).cast("bigint")
    open_ = start.select(*names, q, "_lo", "_hi", "_n", "_salts").withColumn("_rank", rank)
    open_ = ws.keep(open_.withColumn("_done", F.col("_lo") == F.col("_hi")), "r0")
    round_ = 0
    while not open_.where(~F.col("_done")).isEmpty():
        round_ += 1
        open_ = ws.keep(_refine(cells, open_, names, log=round_ % 2 == 0), f"r{round_}")
        ws.drop(f"r{round_ - 1}")
    out = [F.col(n).alias(k) for k, n in zip(keys, names, strict=True)]
    return open_.select(*out, F.col("_q").alias("q"), F.col("_lo").alias("value"), F.col("_n").alias("rows"))


def _refine(cells: DataFrame, brackets: DataFrame, names: list[str], log: bool) -> DataFrame:
    """One round: count the cells in the bins of each open bracket, keep the bin with the rank."""
    lo, hi, v = F.col("_lo"), F.col("_hi"), F.col("_v")

    def scaled(x, way):
        return F.signum(x) * F.log1p(F.abs(x)) if way else x / 2

    def share(way):
        a, b = scaled(lo, way), scaled(hi, way)
        return F.when(b > a, (scaled(v, way) - a) / (b - a))

    # the ends are named, so the least and the greatest value part in every round
    part = F.coalesce(share(True), share(False)) if log else share(False)
    inner = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(F.coalesce(part, F.lit(0.0)) * BINS)))
    bin_ = F.when(v == hi, F.lit(BINS - 1)).when(v == lo, F.lit(0)).otherwise(
        F.least(F.lit(BINS - 2), F.greatest(F.lit(0), inner))
    )
    todo = brackets.where(~F.col("_done")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    spread = cells.withColumnsRenamed({n: f"{n}c" for n in [*names, "_salt"]})
    on = (F.col("_saltc") == F.col("_salt")) & (v >= lo) & (v <= hi)
    for n in names:
        on = on & F.col(f"{n}c").eqNullSafe(F.col(n))
    counts = (
        spread.join(todo, on)
        .select(*names, "_q", "_n", "_salts", "_rank", bin_.alias("_bin"), "_v", "_w")
        .groupBy(*names, "_q", "_n", "_salts", "_rank", "_bin")
        .agg(F.sum("_w").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    up = Window.partitionBy(*names, "_q").orderBy("_bin")  # BINS rows at most
    hit = counts.withColumn("_upto", F.sum("_c").over(up)).where(
        (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_c") < F.col("_rank"))
    )
    new = hit.select(
        *names, "_q", "_lo", "_hi", "_n", "_salts",
        (F.col("_rank") - (F.col("_upto") - F.col("_c"))).alias("_rank"),
        (F.col("_lo") == F.col("_hi")).alias("_done"),
    )
    return brackets.where("_done").unionByName(new)


def key_profile(
    df: DataFrame,
    key: str,
    size: str,
    metrics: Sequence[str] = (),
    probs: Sequence[float] = (0.5,),
) -> DataFrame:
    """One row per key: ``key, rows, size, share`` , a weighted mean per metric, size quantiles.

    ``size`` is a whole number; null counts as 0. ``share`` is the key's part of the size of all
    rows, those of a null key included (null if that is 0). A metric's mean is weighted by size
    over the rows where it is neither null nor NaN, null without weight. ``q<percent>`` are the
    exact discrete quantiles of size over the key's rows. A null key makes a row of its own.
    """
    ws = Workspace(df.sparkSession, "profile")
    n = F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0))
    usable = {m: F.col(f"`{m}`").isNotNull() & ~F.isnan(F.col(f"`{m}`").cast("double")) for m in metrics}
    slim = ws.keep(
        df.select(
            F.col(f"`{key}`").alias("_key"),
            n.alias("_size"),
            *[F.when(usable[m], F.col(f"`{m}`").cast("double")).alias(f"_m{i}") for i, m in enumerate(metrics)],
        ),
        "slim",
    )
    size_ = F.col("_size")
    totals = slim.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.sum("_size").alias("_total"),
        *[F.sum(F.col(f"_m{i}") * size_).alias(f"_s{i}") for i in range(len(metrics))],
        *[F.sum(F.when(F.col(f"_m{i}").isNotNull(), size_)).alias(f"_w{i}") for i in range(len(metrics))],
    )
    totals = ws.keep(totals, "totals")
    whole = totals.agg(F.sum("_total").alias("_whole"))  # one row
    out = totals.crossJoin(F.broadcast(whole)).select(
        F.col("_key"),
        F.col("_rows").alias("rows"),
        F.col("_total").alias("size"),
        F.try_divide(F.col("_total"), F.col("_whole")).alias("share"),
        *[F.try_divide(F.col(f"_s{i}"), F.col(f"_w{i}")).alias(m) for i, m in enumerate(metrics)],
    )
    if probs:
        found = exact_quantiles(slim, ["_key"], "_size", probs)
        name = {float(p): f"q{round(p * 100)}" for p in probs}
        wide = found.groupBy(F.col("_key").alias("_key2")).agg(
            *[F.max(F.when(F.col("q") == F.lit(p), F.col("value"))).cast("bigint").alias(c) for p, c in name.items()]
        )
        out = out.join(wide, F.col("_key").eqNullSafe(F.col("_key2")), "left").drop("_key2")
    return out.withColumnRenamed("_key", key)
