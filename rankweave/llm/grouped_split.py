"""Splits that keep related records together (problem 4).

Names that occur together are joined into components by large-star / small-star rounds over the
distinct pairs. Components of the same size and label profile form a bundle. The bundles are few
(different sizes add up, so there are at most sqrt(2 * records) sizes per profile); a min-cost
flow sends their records to the splits, whole components are cut from that flow by rounding, and
the members of a bundle take their split by the rank of their hash.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankweave.session import Workspace

#: Components that one hash bucket holds on average when members are ranked.
BUCKET = 5_000


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``name, component`` of every name in either column; the component is its least name.

    A row with both names joins them; a row with one null only declares the other. Large-star and
    small-star rounds on distinct edges, each cut by a written table, until nothing changes.
    """
    ws = Workspace(pairs.sparkSession, "components")
    both = ws.keep(pairs.select(F.col(f"`{a}`").alias("_a"), F.col(f"`{b}`").alias("_b")).distinct(), "pairs")
    names = both.select(F.explode(F.array("_a", "_b")).alias("name")).dropna().distinct()
    edges = both.dropna().where("_a <> _b").select(
        F.greatest("_a", "_b").alias("u"), F.least("_a", "_b").alias("v")
    ).distinct()
    edges = ws.keep(edges, "e0")
    mark, round_ = _mark(edges), 0
    while True:
        round_ += 1
        edges = ws.keep(_small_star(_large_star(edges)), f"e{round_}")
        ws.drop(f"e{round_ - 1}")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    return names.join(edges.withColumnRenamed("u", "name"), "name", "left").select(
        "name", F.coalesce("v", "name").alias("component")
    )


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each name tells its larger neighbours the least of its neighbours and itself."""
    two = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = two.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return two.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each name tells its smaller neighbours, and itself, the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    told = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return told.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def allocate(bundles: Sequence[tuple[int, int]], shares: Sequence[float]) -> list[list[int]]:
    """Components of each bundle ``(size, count)`` for each split.

    Records flow from bundles to splits. Up to its quota a split takes a record free, beyond it
    for 1; a component larger than a quota adds its excess, so large ones go where they fit.
    Successive shortest paths give the least cost. Whole components are then cut from the flow by
    rounding down, and what is left goes, largest first, where most of the quota is still open.
    Last, single components change their split as long as that brings the sums nearer to the quotas.
    """
    k = len(shares)
    total = sum(s * c for s, c in bundles)
    quota = [total * s for s in shares]
    cost = [[max(0.0, s - q) / max(s, 1) for q in quota] for s, _ in bundles]
    flow = [[0] * k for _ in bundles]
    room = [int(q) for q in quota]
    room[max(range(k), key=lambda j: quota[j])] += total - sum(room) if total >= sum(room) else 0
    # cheapest way to hand a record of a bundle in split i over to split j, lazily cleaned
    hand: list[list[list[tuple[float, int]]]] = [[[] for _ in range(k)] for _ in range(k)]
    for b in sorted(range(len(bundles)), key=lambda x: -bundles[x][0]):
        supply = bundles[b][0] * bundles[b][1]
        while supply:
            dist = list(cost[b])
            via: list[tuple[int, int] | None] = [None] * k
            for _ in range(k - 1):
                for i in range(k):
                    for j in range(k):
                        heap = hand[i][j]
                        while heap and not flow[heap[0][1]][i]:
                            heapq.heappop(heap)
                        if heap and dist[i] + heap[0][0] < dist[j] - 1e-12:
                            dist[j], via[j] = dist[i] + heap[0][0], (i, heap[0][1])
            end = min(range(k), key=lambda j: dist[j] + (room[j] <= 0))
            path, seen, j = [], set(), end
            while via[j] is not None and j not in seen:
                seen.add(j)
                path.append((via[j][0], j, via[j][1]))
                j = via[j][0]
            amount = min([supply, *[flow[x][i] for i, _, x in path]] + ([room[end]] if room[end] > 0 else []))
            first = path[-1][0] if path else end
            _move(flow, hand, cost, b, first, amount)
            for i, j2, x in reversed(path):
                flow[x][i] -= amount
                _move(flow, hand, cost, x, j2, amount)
            room[end] -= amount
            supply -= amount
    out = [[f // max(1, s) for f in row] for row, (s, _) in zip(flow, bundles, strict=True)]
    open_ = [q - sum(out[b][j] * bundles[b][0] for b in range(len(bundles))) for j, q in enumerate(quota)]
    for b in sorted(range(len(bundles)), key=lambda x: -bundles[x][0]):
        for _ in range(bundles[b][1] - sum(out[b])):
            j = max(range(k), key=lambda j: open_[j])
            out[b][j] += 1
            open_[j] -= bundles[b][0]
    while True:
        gain, best = 1e-6, None
        for i in range(k):
            for j in range(k):
                for b, (s, _) in enumerate(bundles):
                    if i != j and out[b][i]:
                        g = abs(open_[i]) + abs(open_[j]) - abs(open_[i] + s) - abs(open_[j] - s)
                        if g > gain:
                            gain, best = g, (b, i, j)
        if best is None:
            return out
        b, i, j = best
        out[b][i] -= 1
        out[b][j] += 1
        open_[i] += bundles[b][0]
        open_[j] -= bundles[b][0]


def _move(flow: list, hand: list, cost: list, b: int, j: int, amount: int) -> None:
    if not flow[b][j]:
        for other in range(len(flow[b])):
            if other != j:
                heapq.heappush(hand[j][other], (cost[b][other] - cost[b][j], b))
    flow[b][j] += amount


def split_by_component(
    records: DataFrame, record: str, component: str, targets: DataFrame, name: str, share: str, label: Column | None = None
) -> DataFrame:
    """``record, component, split`` for each distinct record.

    Records with a null component form a component each; null records are ignored. ``targets``
    has a row per split with its share (shares are divided by their sum; null and negative ones
    count as 0). ``label`` adds a profile: components only share a bundle if they hold as many
    records of each label. No split takes part of a component.
    """
    spark = records.sparkSession
    ws = Workspace(spark, "split")
    lab = F.lit("") if label is None else F.coalesce(label.cast("string"), F.lit(""))
    slim = (
        records.select(F.col(f"`{record}`").alias("_r"), F.col(f"`{component}`").alias("_c"), lab.alias("_l"))
        .where("_r IS NOT NULL")
        .groupBy("_r")
        .agg(F.min("_c").alias("_c"), F.min("_l").alias("_l"))
        .withColumn("_c", F.coalesce(F.concat(F.lit("c:"), F.col("_c")), F.concat(F.lit("r:"), F.col("_r").cast("string"))))
    )
    slim = ws.keep(slim, "records")
    per = slim.groupBy("_c", "_l").agg(F.count(F.lit(1)).alias("_n"))
    comp = per.groupBy("_c").agg(
        F.sum("_n").alias("_size"),
        F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "_l", F.col("_n").cast("string")))), ",").alias("_p"),
    )
    if label is None:
        comp = comp.withColumn("_p", F.lit(""))
    comp = ws.keep(comp, "components")
    splits = [(r[0], max(0.0, r[1] or 0.0)) for r in targets.select(name, share).orderBy(name).collect()]
    whole = sum(s for _, s in splits) or 1.0
    bundles = comp.groupBy("_size", "_p").agg(F.count(F.lit(1)).alias("_k")).orderBy(F.desc("_size"), "_p").collect()
    plan = allocate([(r["_size"], r["_k"]) for r in bundles], [s / whole for _, s in splits])
    cuts, at = [], 0
    for row, counts in zip(bundles, plan, strict=True):
        at = 0
        for (split, _), c in zip(splits, counts, strict=True):
            if c:
                cuts.append((row["_size"], row["_p"], split, at, at + c))
            at += c
    schema = "_size bigint, _p string, split string, _from bigint, _to bigint"
    cut = spark.createDataFrame(cuts, schema)
    # Rank of a component in its bundle by hash: counts of hash buckets first, then order inside
    # a bucket, so that a bundle of most components never meets in one task.
    buckets = max(1, -(-sum(r["_k"] for r in bundles) // BUCKET))
    hashed = comp.withColumn("_h", F.xxhash64("_c")).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sums = hashed.groupBy("_size", "_p", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_size", "_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_size", "_p", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_size", "_p", "_b").orderBy("_h", "_c")
    ranked = hashed.withColumn("_i", F.row_number().over(inside) - 1).join(sums, ["_size", "_p", "_b"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_i"))
    at = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = ranked.join(cut, ["_size", "_p"]).where(at).select("_c", "split")
    return slim.join(placed, "_c").select(
        F.col("_r").alias(record), F.expr("if(_c LIKE 'c:%', substr(_c, 3), NULL)").alias(component), "split"
    )
