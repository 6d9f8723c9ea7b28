"""Graphs, issues and gold of all instances as tables keyed by ``instance_id``.

The index of a node is its dense position among the kept nodes of its instance; it breaks every
tie. Tables are written once per session and data folder and shared by all queries on it.
"""

from __future__ import annotations

from functools import cached_property
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rankweave.session import Workspace, table

if TYPE_CHECKING:
    from rankweave.operators.expand import Search

KINDS = ("function", "class")
STRUCTURAL = ("calls", "imports", "inherits")

EDGE_ARRAY = "array<string>"
EDGE_OBJECT = "struct<`from`:string,`to`:string,`type`:string>"


def parse_edge(raw) -> tuple:
    """``src, dst, type`` of a raw JSON edge, an array of three or an object; null if malformed."""
    arr = F.from_json(raw, EDGE_ARRAY)
    obj = F.from_json(raw, EDGE_OBJECT)
    is_array = F.ltrim(raw).startswith("[")

    def pick(i: int, name: str):
        return F.when(is_array, F.get(arr, F.lit(i))).otherwise(obj[name])

    return pick(0, "from").alias("src_id"), pick(1, "to").alias("dst_id"), pick(2, "type").alias("type")


def indexed_nodes(raw: DataFrame, keep_tests: bool = False) -> DataFrame:
    """Function and class nodes with their dense index; test nodes only with ``keep_tests``.

    Of rows with one id the one with the least node_idx counts, then file, sig and start.
    """
    rows = raw.where(F.col("kind").isin(*KINDS) & F.col("id").isNotNull() & F.col("instance_id").isNotNull()).select(
        "instance_id", "node_idx", "id", "kind", F.coalesce("file", F.lit("")).alias("file"),
        F.coalesce("sig", F.lit("")).alias("sig"), F.coalesce("test", F.lit(False)).alias("is_test"), F.coalesce("start", F.lit(0)).alias("start"),
    )
    if not keep_tests:
        rows = rows.where(~F.col("is_test"))
    best = rows.groupBy("instance_id", "id").agg(F.min(F.struct("node_idx", "file", "sig", "start", "kind", "is_test")).alias("b"))
    flat = best.select("instance_id", "id", *[F.col(f"b.{c}").alias(c) for c in ("node_idx", "file", "sig", "start", "kind", "is_test")])
    # one instance is one graph; its nodes are numbered in one task
    order = Window.partitionBy("instance_id").orderBy(F.col("node_idx").asc_nulls_first(), "id")
    return flat.withColumn("idx", F.row_number().over(order) - 1).drop("node_idx")


def resolved_edges(raw: DataFrame, nodes: DataFrame, types: tuple[str, ...] = STRUCTURAL) -> DataFrame:
    """Directed multi-edges between indexed nodes: no unknown ends, other types or self-loops."""
    parsed = raw.distinct().select("instance_id", "edge_no", *parse_edge(F.col("edge"))).where(F.col("type").isin(*types))
    ends = nodes.select("instance_id", "id", "idx")
    src = ends.toDF("instance_id", "src_id", "src")
    dst = ends.toDF("instance_id", "dst_id", "dst")
    found = parsed.join(src, ["instance_id", "src_id"]).join(dst, ["instance_id", "dst_id"])
    return found.where("src <> dst").select("instance_id", "edge_no", "src", "dst", "type")


def undirected(edges: DataFrame) -> DataFrame:
    """``instance_id, a, b``: each neighbour once, in both directions."""
    one = edges.select("instance_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    return one.unionByName(edges.select("instance_id", F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def valid_instances(raw: DataFrame) -> DataFrame:
    """The row of each instance that was ingested last, its statement never null."""
    order = Window.partitionBy("instance_id").orderBy(
        F.col("ingested_at").desc_nulls_last(), F.col("problem_statement").desc_nulls_last(), F.col("created_at").desc_nulls_last()
    )
    rows = raw.where("instance_id IS NOT NULL").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return rows.select(
        "instance_id", "repo", "base_commit", F.coalesce("problem_statement", F.lit("")).alias("issue"),
        *[F.coalesce(F.col(f"gold.{c}"), F.array().cast("array<string>")).alias(c) for c in ("entities", "files", "module_level", "added_files")],
    )


class Corpus:
    """All tables of one data folder. Every property is written once and read from then on."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.ws = Workspace(spark, "corpus")
        self.held: dict[str, DataFrame] = {}
        self.searches: dict[int, Search] = {}

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def keep(self, name: str, make) -> DataFrame:
        if name not in self.held:
            self.held[name] = self.ws.keep(make(), name)
        return self.held[name]

    @property
    def nodes(self) -> DataFrame:
        return self.keep("nodes", lambda: indexed_nodes(self.raw("graph_nodes")))

    @property
    def nodes_with_tests(self) -> DataFrame:
        return self.keep("nodes_with_tests", lambda: indexed_nodes(self.raw("graph_nodes"), keep_tests=True))

    @property
    def edges(self) -> DataFrame:
        return self.keep("edges", lambda: resolved_edges(self.raw("graph_edges"), self.nodes))

    @property
    def adj(self) -> DataFrame:
        return self.keep("adj", lambda: undirected(self.edges))

    @property
    def instances(self) -> DataFrame:
        return self.keep("instances", lambda: valid_instances(self.raw("instances")))

    @property
    def gold(self) -> DataFrame:
        """``instance_id, id`` of every gold entity."""
        return self.instances.select("instance_id", F.explode("entities").alias("id")).dropna().distinct()

    @property
    def targets(self) -> DataFrame:
        """``instance_id, idx``: gold entities that are nodes of their graph."""
        return self.keep("targets", lambda: self.nodes.join(self.gold, ["instance_id", "id"], "left_semi").select("instance_id", "idx"))

    @property
    def usable(self) -> DataFrame:
        """Instances with a gold entity in their graph, with their repository."""
        return self.instances.join(self.targets, "instance_id", "left_semi").select("instance_id", "repo")

    @cached_property
    def lexical(self):
        from rankweave.operators.lexical import name_scores

        return name_scores

    @property
    def scores(self) -> DataFrame:
        """``instance_id, idx, lex, lex_rank`` (from 1) of every kept node."""
        return self.keep("scores", lambda: self.lexical(self.nodes, self.instances))

    @property
    def reach(self) -> DataFrame:
        """``instance_id, k, idx, hop, seed_rank`` for every seed size the experiments use, eight hops deep."""
        from rankweave.operators.expand import SEED_SIZES, bfs, seeds

        return self.keep("reach", lambda: bfs(seeds(self.scores, SEED_SIZES), self.adj, ["instance_id", "k"], 8))

    def reached(self, k: int, hops: int) -> DataFrame:
        """``instance_id, k, idx, seed_rank, hop`` from k seeds; searched only as deep as any query asked."""
        from rankweave.operators.expand import Search, seeds

        if k not in self.searches:
            self.searches[k] = Search(seeds(self.scores, (k,)), self.adj, ["instance_id", "k"])
        return self.searches[k].upto(hops)

    @property
    def capped(self) -> DataFrame:
        """``instance_id, k, cap, idx, seed_rank, hop``: ten seeds, twelve hops, all caps of the sweep."""
        from rankweave.operators.expand import CAPS, cut_by_caps

        return self.keep("capped", lambda: cut_by_caps(self.reached(10, 12), CAPS))

    def pool(self, k: int = 10, hops: int = 3) -> DataFrame:
        """Reached nodes with hop, reached flag and lexical score."""
        reached = self.reached(k, hops).drop("k")
        return reached.join(self.scores, ["instance_id", "idx"]).withColumn("flag", (F.col("hop") > 0).cast("int"))


_CORPORA: dict[tuple[str, str], Corpus] = {}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """The corpus of a data folder, one per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CORPORA:
        _CORPORA[key] = Corpus(spark, sf_dir)
    return _CORPORA[key]
