"""Filling containers of fixed capacity by best-two-fit (problem 7).

Items are spread by hash over shards of about SHARD_ITEMS items and each shard is packed by
itself. A shard leaves at most one container of its last, poorly filled kind, so what a shard
boundary wastes is below 1 / (SHARD_ITEMS * mean size / capacity).
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rankweave.session import Workspace

#: Items of one shard on average; bounds what one task holds.
SHARD_ITEMS = 20_000


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; every size lies between 1 and ``capacity``.

    Each container first takes the largest item left, then always the largest that still fits.
    If a gap is left, its smallest item s makes room: the two unpacked items whose sum is
    greatest, above s and not above s + gap, replace it, and so on until nothing improves.
    Works on the counts of the sizes, so its time grows with containers, not with items squared.
    """
    order = np.lexsort((np.arange(len(sizes)), sizes))
    left = np.bincount(sizes, minlength=capacity + 1)
    stock = {s: deque() for s in np.flatnonzero(left)}
    for i in order:
        stock[sizes[i]].append(i)
    where = np.full(len(sizes), -1, np.int64)
    container, todo = 0, len(sizes)
    while todo:
        bin_: list[int] = []
        gap = capacity
        while gap and (fits := np.flatnonzero(left[1 : gap + 1])).size:
            s = int(fits[-1]) + 1
            left[s] -= 1
            bin_.append(s)
            gap -= s
        while gap and bin_:
            smallest = bin_[-1]
            if (pair := _two(left, smallest + gap, smallest)) is None:
                break
            a, b = pair
            bin_[-1:] = [max(a, b), min(a, b)]
            bin_.sort(reverse=True)
            left[a] -= 1
            left[b] -= 1
            left[smallest] += 1
            gap += smallest - a - b
        for s in bin_:
            where[stock[s].popleft()] = container
        todo -= len(bin_)
        container += 1
    return where


def _two(left: np.ndarray, most: int, above: int) -> tuple[int, int] | None:
    """Two sizes in stock with the greatest sum in (above, most], None if there are none."""
    have = np.flatnonzero(left[: most + 1])
    if not have.size:
        return None
    # the greatest partner of each size; a size is its own partner only if two are left
    at = np.searchsorted(have, most - have, side="right") - 1
    partner = np.where(at >= 0, have[at], -1)
    alone = (partner == have) & (left[have] < 2)
    lower = np.where(at >= 1, have[np.maximum(at - 1, 0)], -1)
    partner = np.where(alone, lower, partner)
    sums = np.where(partner >= 0, have + partner, -1)
    k = int(sums.argmax())
    return (int(have[k]), int(partner[k])) if sums[k] > above else None


def pack(df: DataFrame, item: str, size: str, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``item, piece, start, size, container, fill`` for each piece of each item.

    Only an item larger than ``capacity`` is cut, into full pieces and a rest; ``start`` is the
    offset of a piece. Items of null or non-positive size take no room and are left out, as are
    null items. ``container`` is unique over all shards, ``fill`` is the sum of its sizes.
    """
    whole = df.select(F.col(f"`{item}`").alias("_i"), F.col(f"`{size}`").cast("bigint").alias("_n")).where(
        F.col("_i").isNotNull() & (F.col("_n") > 0)
    )
    # the sizes are read three times, whatever they cost to make
    whole = Workspace(df.sparkSession, "pack").keep(whole, "sizes")
    pieces = whole.select(
        "_i", "_n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / capacity).cast("int") - 1)).alias("_p")
    ).select("_i", "_p", F.least(F.lit(capacity), F.col("_n") - F.col("_p") * capacity).cast("int").alias("_s"))
    full = pieces.where(F.col("_s") == capacity)
    part = pieces.where(F.col("_s") < capacity)
    shards = max(1, -(-part.count() // shard_items))
    kind = df.schema[item].dataType.simpleString()

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_i", "_p"], kind="stable")
        c = best_two_fit(pdf["_s"].to_numpy(), capacity)
        used = np.bincount(c, weights=pdf["_s"])
        return pdf.assign(_c=[f"{k}-{x}" for k, x in zip(pdf["_shard"], c, strict=True)], _f=used[c].astype("int64"))[
            ["_i", "_p", "_s", "_c", "_f"]
        ]

    packed = (
        part.withColumn("_shard", F.pmod(F.xxhash64("_i", "_p"), F.lit(shards)).cast("int"))
        .groupBy("_shard")
        .applyInPandas(fill, f"_i {kind}, _p int, _s int, _c string, _f bigint")
    )
    # a full piece is a container of its own; it needs no packing
    own = full.select(
        "_i", "_p", "_s", F.concat_ws("-", F.lit("full"), F.col("_i").cast("string"), F.col("_p")).alias("_c"),
        F.lit(capacity).cast("bigint").alias("_f"),
    )
    return own.unionByName(packed).select(
        F.col("_i").alias(item),
        F.col("_p").alias("piece"),
        (F.col("_p").cast("bigint") * capacity).alias("start"),
        F.col("_s").alias("size"),
        F.col("_c").alias("container"),
        F.col("_f").alias("fill"),
    )
