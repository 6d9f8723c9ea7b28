"""Measures of nodes, graphs and targets that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankweave.functions import text as T
from rankweave.operators import lexical as L
from rankweave.operators.corpus import Corpus


def classify(df: DataFrame, id_: str) -> DataFrame:
    """File, symbol and visibility of a node id."""
    qn = T.qualified_name(F.col(id_))
    dunder = qn.startswith("__") & qn.endswith("__")
    return df.select(
        "instance_id", id_, T.file_of(F.col(id_)).alias("file"), qn.alias("symbol"), (qn.startswith("_") & ~dunder).alias("private"),
        dunder.alias("dunder"), qn.contains(".").alias("is_method"),
    )


def commas(sig: Column) -> Column:
    return F.length(sig) - F.length(F.replace(sig, F.lit(","), F.lit("")))


def arity(sig: Column) -> Column:
    """Commas plus one of a definition, else 0; at most 12, divided by 12."""
    s = F.regexp_replace(sig, r"^\s+", "")
    n = F.when(s.startswith("def ") | s.startswith("async def "), commas(sig) + 1).otherwise(0)
    return F.least(n, F.lit(12)) / 12


def best_gold_rank(c: Corpus) -> DataFrame:
    """Rank from 0 of the best target of each instance, 10**9 without one."""
    best = c.scores.join(c.targets, ["instance_id", "idx"], "left_semi").groupBy("instance_id").agg((F.min("lex_rank") - 1).alias("r"))
    return c.instances.select("instance_id").join(best, "instance_id", "left").select(
        "instance_id", F.coalesce("r", F.lit(10**9)).cast("bigint").alias("best_rank")
    )


def tfidf(c: Corpus) -> DataFrame:
    return c.keep("tfidf", lambda: L.tfidf_scores(c.nodes, c.instances))


def pool_norm() -> Column:
    most = F.max("lex").over(Window.partitionBy("instance_id"))
    return F.col("lex") / F.when(most > 0, most).otherwise(1.0)


def gold_hops(c: Corpus, k: int = 10) -> DataFrame:
    """Least hop of a target per usable instance, -1 if none is reached."""
    near = c.reach.where(F.col("k") == k).join(c.targets, ["instance_id", "idx"], "left_semi").groupBy("instance_id").agg(F.min("hop").alias("h"))
    return c.usable.join(near, "instance_id", "left").select("instance_id", "repo", F.coalesce("h", F.lit(-1)).alias("hops"))


def degrees(c: Corpus) -> DataFrame:
    """``instance_id, idx, deg, outs``: undirected neighbours and directed multi-edges."""
    deg = c.adj.groupBy("instance_id", F.col("a").alias("idx")).agg(F.count(F.lit(1)).alias("deg"))
    outs = c.edges.groupBy("instance_id", F.col("src").alias("idx")).agg(F.count(F.lit(1)).alias("outs"))
    both = c.nodes.select("instance_id", "idx").join(deg, ["instance_id", "idx"], "left").join(outs, ["instance_id", "idx"], "left")
    return both.select("instance_id", "idx", F.coalesce("deg", F.lit(0)).alias("deg"), F.coalesce("outs", F.lit(0)).alias("outs"))


def graph_summary(c: Corpus) -> DataFrame:
    """Nodes, mean degree, files and share of edges between files of each graph."""
    base = c.nodes.join(degrees(c), ["instance_id", "idx"]).groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.avg("deg").alias("mean_deg"), F.count_distinct("file").alias("n_files")
    )
    files = c.nodes.select("instance_id", "idx", "file")
    cross = (
        c.edges.join(files.toDF("instance_id", "src", "fs"), ["instance_id", "src"])
        .join(files.toDF("instance_id", "dst", "fd"), ["instance_id", "dst"])
        .groupBy("instance_id")
        .agg(F.avg((F.col("fs") != F.col("fd")).cast("int")).alias("cross_file"))
    )
    return base.join(cross, "instance_id", "left").withColumn("cross_file", F.coalesce("cross_file", F.lit(0.0)))
