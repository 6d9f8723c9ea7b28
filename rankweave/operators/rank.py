"""Ranking policies, top-n and the localization queries built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankweave.functions.text import STOP_SHORT, qualified_name
from rankweave.operators.corpus import Corpus, indexed_nodes, resolved_edges, undirected
from rankweave.operators.expand import bfs, pagerank, seeds
from rankweave.operators.lexical import name_scores, six_places

# Sort keys of each policy over a pool with hop, lex, flag and pr; (name, descending).
POLICIES: dict[str, tuple[tuple[str, bool], ...]] = {
    "lex": (("lex", True),),
    "hop": (("hop", False), ("lex", True)),
    "cons": (("flag", True), ("lex", True)),
    "hopcons": (("hop", False),),
    "pagerank": (("pr", True),),
    "pr_hop": (("pr", True), ("lex", True)),
    "lex_hop": (("lex", True), ("hop", False)),
    "hop2_lex2": (("hop", False), ("lex", True)),
    "cons_hop": (("lex", True), ("flag", True), ("hop", False)),
}
# Further names of one ordering.
ALIASES = {"hop_first": "hop", "budget_mix": "hop", "lexical_only": "lex", "layers": "hop"}


def order_by(policy: str, node: str = "idx") -> list[Column]:
    keys = POLICIES[ALIASES.get(policy, policy)]
    return [F.col(c).desc() if down else F.col(c).asc() for c, down in keys] + [F.col(node).asc()]


def rank_by(pool: DataFrame, policy: str, keys: Sequence[str] = ("instance_id",)) -> DataFrame:
    """Adds ``rank`` from 1 in the order of the policy; the node index breaks every tie."""
    return pool.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by(policy))))


def best_ranks(pool: DataFrame, targets: DataFrame, policies: Sequence[str]) -> DataFrame:
    """``instance_id, rule, best``: the rank of the first target under each policy, no sort needed.

    The first target is a minimum, and its rank the number of rows before it, so one join and two
    sums answer all policies and no instance has to fit into one task.
    """

    def key(policy: str) -> Column:
        keys = POLICIES[ALIASES.get(policy, policy)]
        return F.struct(*[(-F.col(c) if down else F.col(c)).alias(c) for c, down in keys], F.col("idx"))

    hit = pool.join(targets, ["instance_id", "idx"], "left_semi")
    first = hit.groupBy("instance_id").agg(*[F.min(key(p)).alias(f"first_{p}") for p in policies])
    ahead = pool.join(first, "instance_id").groupBy("instance_id").agg(*[F.count_if(key(p) < F.col(f"first_{p}")).alias(p) for p in policies])
    return ahead.unpivot("instance_id", list(policies), "rule", "ahead").select("instance_id", "rule", (F.col("ahead") + 1).alias("best"))


def lexical_first(scores: DataFrame, pool: DataFrame) -> DataFrame:
    """The ablation as published: nodes outside the pool by index come before the pool by score."""
    marked = scores.join(pool.select("instance_id", "idx", F.lit(1).alias("in_pool")), ["instance_id", "idx"], "left")
    inside = F.coalesce("in_pool", F.lit(0))
    order = Window.partitionBy("instance_id").orderBy(inside, F.when(inside == 1, -F.col("lex")).otherwise(0.0), "idx")
    return marked.withColumn("rank", F.row_number().over(order)).select("instance_id", "idx", "rank")


def ten_seeds_pagerank(c: Corpus) -> DataFrame:
    return c.keep("pagerank", lambda: pagerank(seeds(c.scores, (10,)).select("instance_id", "idx"), c.adj))


def with_pagerank(c: Corpus) -> DataFrame:
    """The pool of ten seeds and three hops with ``pr`` (nine places), 0 where no mass arrives."""

    def make() -> DataFrame:
        pr = ten_seeds_pagerank(c)
        return c.pool().join(pr.withColumn("pr", F.round("pr", 9)), ["instance_id", "idx"], "left").withColumn("pr", F.coalesce("pr", F.lit(0.0)))

    return c.keep("pool_pr", make)


def localize(c: Corpus, seed_k: int = 10, hops: int = 2, top_n: int = 100, cap: int | None = None) -> DataFrame:
    """One row per instance and rank: ``node, file, kind, hops, via, lexical, reached_by``.

    Seeds are the first ``seed_k`` nodes by BM25, expanded ``hops`` deep, ranked by hop, then by
    score, then by index. An instance without nodes has no row; all instances run in one plan.
    """
    if cap is None:
        reached = c.reached(seed_k, hops).drop("k")
    else:
        reached = bfs(seeds(c.scores, (seed_k,)), c.adj, ["instance_id", "k"], hops, cap=cap).drop("k")
    return present(rank_by(reached.join(c.scores, ["instance_id", "idx"]), "hop"), c.nodes, c.scores, top_n)


def present(ranked: DataFrame, nodes: DataFrame, scores: DataFrame, top_n: int) -> DataFrame:
    named = nodes.select("instance_id", "idx", F.col("id").alias("node"), "file", "kind")
    by = scores.select("instance_id", F.col("lex_rank").alias("seed_rank"), F.col("idx").alias("seed_idx"))
    seed = nodes.select("instance_id", F.col("idx").alias("seed_idx"), F.col("id").alias("reached_by"))
    return (
        ranked.where(F.col("rank") <= top_n)
        .join(named, ["instance_id", "idx"])
        .join(by.join(seed, ["instance_id", "seed_idx"]), ["instance_id", "seed_rank"], "left")
        .select(
            "instance_id", "rank", "node", "file", "kind", F.col("hop").alias("hops"),
            F.when(F.col("hop") == 0, "seed").otherwise(F.concat(F.lit("hop"), F.col("hop"))).alias("via"), six_places(F.col("lex")).alias("lexical"), "reached_by",
        )
    )


def skill_tables(c: Corpus) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with tests, their scores, and the nodes reached from ten seeds with a cap of 200."""

    def scores() -> DataFrame:
        return name_scores(c.nodes_with_tests, c.instances, STOP_SHORT)

    def reached() -> DataFrame:
        adj = undirected(resolved_edges(c.raw("graph_edges"), c.nodes_with_tests))
        start = c.held["scores_all"].where("lex_rank <= 10").select("instance_id", "idx", F.col("lex_rank").alias("seed_rank"))
        return bfs(start, c.ws.keep(adj, "adj_all"), ["instance_id"], 2, cap=200)

    s = c.keep("scores_all", scores)
    return c.nodes_with_tests, s, c.keep("skill", reached)


def localize_with_tests(c: Corpus, top_n: int = 20) -> DataFrame:
    """The command-line variant: tests take part in corpus, seeds and bridges and go on output.

    ``rank, score, hops, file, start, symbol, node``; score is divided by the greatest of the
    instance's returned rows (by 1 if that is 0).
    """
    nodes, scores, reached = skill_tables(c)
    named = nodes.select("instance_id", "idx", F.col("id").alias("node"), "file", "start", "is_test")
    rows = reached.join(scores, ["instance_id", "idx"]).join(named, ["instance_id", "idx"]).where(~F.col("is_test"))
    top = rank_by(rows, "hop").where(F.col("rank") <= top_n)
    most = F.max("lex").over(Window.partitionBy("instance_id"))
    return top.select(
        "instance_id", "rank", F.round(F.col("lex") / F.when(most > 0, most).otherwise(1.0), 6).alias("score"),
        F.col("hop").alias("hops"), "file", "start", qualified_name(F.col("node")).alias("symbol"), "node",
    )


def loaded(raw_nodes: DataFrame, raw_edges: DataFrame, keep_tests: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and undirected neighbours from raw tables."""
    nodes = indexed_nodes(raw_nodes, keep_tests)
    edges = resolved_edges(raw_edges, nodes)
    return nodes, edges, undirected(edges)
