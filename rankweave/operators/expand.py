"""Expansion over the undirected graph: capped breadth-first search, PageRank, paths."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from rankweave.session import Workspace

SEED_SIZES = (1, 3, 5, 10, 20, 50, 100)
CAPS = (50, 100, 200, 400, 800, 10**9)


def seeds(scores: DataFrame, sizes: Sequence[int], group: str = "instance_id", node: str = "idx") -> DataFrame:
    """``group, k, node, seed_rank``: the first k nodes by lexical rank for each k; zero scores count."""
    first = scores.where(F.col("lex_rank") <= max(sizes)).select(group, node, F.col("lex_rank").alias("seed_rank"))
    return first.withColumn("k", F.explode(F.array(*[F.lit(k) for k in sizes]))).where(F.col("seed_rank") <= F.col("k"))


class Search:
    """A breadth-first search over undirected neighbours, as deep as it has been asked so far.

    One table per hop: ``keys..., idx, seed_rank, hop``. ``seed_rank`` is the least among the seeds
    at that distance, which is the seed a walk in rank order arrives from. A neighbour of a layer
    lies in it, in the one before or in the next, so a hop joins the frontier with the edges and
    sets the last two layers aside, whatever was reached earlier. Layers are written, so the plan
    doesn't grow.
    """

    def __init__(self, start: DataFrame, adj: DataFrame, keys: Sequence[str]):
        self.ws, self.adj, self.keys = Workspace(start.sparkSession, "bfs"), adj, list(keys)
        self.cols = [*keys, "idx"]
        first = start.groupBy(*self.cols).agg(F.min("seed_rank").alias("seed_rank")).withColumn("hop", F.lit(0))
        self.layers = [self.ws.keep(first, "h0")]
        self.done = False

    def hop(self, front: DataFrame) -> None:
        """One more layer, from ``front``, the part of the last one that goes on."""
        adj, h = self.adj, len(self.layers)
        step = front.join(adj, (front["instance_id"] == adj["instance_id"]) & (front["idx"] == adj["a"])).select(
            *[front[k] for k in self.keys], F.col("b").alias("idx"), "seed_rank"
        )
        new = step.groupBy(*self.cols).agg(F.min("seed_rank").alias("seed_rank")).withColumn("hop", F.lit(h))
        seen = reduce(DataFrame.unionByName, [x.select(*self.cols) for x in self.layers[-2:]])
        new = self.ws.keep(new.join(seen, self.cols, "left_anti"), f"h{h}")
        if new.isEmpty():
            self.done = True
        else:
            self.layers.append(new)

    def upto(self, hops: int) -> DataFrame:
        while len(self.layers) <= hops and not self.done:
            self.hop(self.layers[-1])
        return reduce(DataFrame.unionByName, self.layers[: hops + 1])


def bfs(start: DataFrame, adj: DataFrame, keys: Sequence[str], hops: int, cap: int | None = None, cap_check: str = "before") -> DataFrame:
    """``keys..., idx, seed_rank, hop`` of every node within ``hops`` of the start nodes.

    With a cap a group stops once it holds more nodes than that, counted before a hop (so the last
    layer may overshoot) or, with ``cap_check='after'``, after it. Groups end by themselves when no
    node is new.
    """
    search = Search(start, adj, keys)
    if cap is None:
        return search.upto(hops)
    total = None
    for h in range(1, hops + 1):
        # how many nodes each group holds: a running total, one row a group
        here = search.layers[-1].groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        both = here if total is None else total.unionByName(here).groupBy(*keys).agg(F.sum("_n").alias("_n"))
        total = search.ws.keep(both, f"n{h}")
        front = search.layers[-1]
        if cap_check == "before" or h > 1:
            front = front.join(total.where(F.col("_n") <= cap), list(keys), "left_semi")
        search.hop(front)
        if search.done:
            break
    return reduce(DataFrame.unionByName, search.layers)


def cut_by_caps(reached: DataFrame, caps: Sequence[int], group: str = "instance_id") -> DataFrame:
    """``reached`` once per cap, each group up to the layer that its cap lets it search.

    A cap only says when to stop, so one uncapped search answers all of them: a group takes hop h
    if the layers before it hold no more than ``cap`` nodes together.
    """
    sizes = reached.groupBy(group, "hop").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("hop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = sizes.withColumn("before", before)  # a row a group and hop
    last = held.withColumn("cap", F.explode(F.array(*[F.lit(c) for c in caps]))).where(F.col("before") <= F.col("cap"))
    last = last.groupBy(group, "cap").agg(F.max("hop").alias("last"))
    return reached.join(last, group).where(F.col("hop") <= F.col("last")).drop("last")


def seed_consensus(scores: DataFrame, adj: DataFrame, k: int, hops: int) -> DataFrame:
    """``instance_id, idx, consensus``: the number of seeds within ``hops`` of a node."""
    start = seeds(scores, (k,)).withColumn("seed", F.col("idx")).drop("k")
    found = bfs(start, adj, ["instance_id", "seed"], hops)
    return found.groupBy("instance_id", "idx").agg(F.count(F.lit(1)).alias("consensus"))


def pagerank(start: DataFrame, adj: DataFrame, alpha: float = 0.85, iters: int = 40, every: int = 8) -> DataFrame:
    """``instance_id, idx, pr``: personalized PageRank with uniform restart at the start nodes.

    Mass at a node without neighbours is lost, it isn't handed out again. The edges are partitioned
    by their start once and held on the executors (a lost block is made again from its table); a
    round joins them where the last sum left its rows, so it shuffles only the mass that moves.
    Every few rounds the result is written to cut the plan.
    """
    ws = Workspace(start.sparkSession, "pagerank")
    count = start.groupBy("instance_id").agg(F.count(F.lit(1)).alias("_n"))
    restart = ws.keep(start.join(count, "instance_id").select("instance_id", "idx", (1 / F.col("_n")).alias("pr")), "restart")
    degree = adj.groupBy("instance_id", "a").agg(F.count(F.lit(1)).alias("_d"))
    steps = ws.keep(adj.join(degree, ["instance_id", "a"]).select("instance_id", "a", "b", (alpha / F.col("_d")).alias("w")), "steps")
    parts = int(start.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = steps.repartition(parts, "instance_id", "a").persist(StorageLevel.MEMORY_AND_DISK)
    back = restart.select("instance_id", "idx", ((1 - alpha) * F.col("pr")).alias("pr"))
    p = restart
    for i in range(iters):
        moved = p.withColumnRenamed("idx", "a").join(steps, ["instance_id", "a"]).select(
            "instance_id", F.col("b").alias("idx"), (F.col("pr") * F.col("w")).alias("pr")
        )
        p = moved.unionByName(back).groupBy("instance_id", "idx").agg(F.sum("pr").alias("pr"))
        if (i + 1) % every == 0 or i + 1 == iters:
            p = ws.keep(p, f"p{i}")
            if i >= every:
                ws.drop(f"p{i - every}")
    steps.unpersist()
    return p


def shortest_paths(reach: DataFrame, adj: DataFrame, ends: DataFrame, hops: int) -> DataFrame:
    """``instance_id, step, idx``: a shortest path from a seed to the end node of each instance.

    Step 0 is the end; every step goes to the neighbour one hop nearer with the least index.
    """
    at = reach.join(ends, ["instance_id", "idx"]).select("instance_id", "idx", "hop")
    out = at.select("instance_id", F.lit(0).alias("step"), "idx")
    for step in range(1, hops + 1):
        near = reach.select("instance_id", F.col("idx").alias("b"), F.col("hop").alias("hop_b"))
        back = (
            at.join(adj.withColumnRenamed("a", "idx"), ["instance_id", "idx"])
            .join(near, ["instance_id", "b"])
            .where(F.col("hop_b") == F.col("hop") - 1)
        )
        at = back.groupBy("instance_id").agg(F.min(F.struct("b", "hop_b")).alias("s")).select(
            "instance_id", F.col("s.b").alias("idx"), F.col("s.hop_b").alias("hop")
        )
        out = out.unionByName(at.select("instance_id", F.lit(step).alias("step"), "idx"))
    return out
