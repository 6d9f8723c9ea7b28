"""Queries of the training-data operators; ``sql.py`` holds what DuckDB can say of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankweave.functions.text import normal_name, project_of_instance, source_key, word_punct_count
from rankweave.llm.grouped_split import components, split_by_component
from rankweave.llm.markup import clean_texts, valid_statements
from rankweave.llm.mixing import mix
from rankweave.llm.neighbours import knn, knn_pairs_at_least
from rankweave.llm.packing import pack
from rankweave.llm.residue import CLASS_NAMES, classified, without_content
from rankweave.llm.term_scores import graph_terms, tf_idf
from rankweave.llm.top_items import latest, top_n
from rankweave.session import Workspace, table

DIM = 64
NEIGHBOURS = 10
CONTAINER = 512
TOP = 5
ENTROPY = 2.0


# ---- problem 2


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_texts(valid_statements(table(spark, sf_dir, "instances")), "instance_id", "problem_statement")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_clean(spark, sf_dir).select("instance_id", F.explode("languages").alias("markup"))


# ---- problem 3


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_pairs_at_least(table(spark, sf_dir, "node_vectors"), "vec_id", "embedding", DIM, 0.92, NEIGHBOURS)


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn(table(spark, sf_dir, "node_vectors"), "vec_id", "embedding", DIM, NEIGHBOURS)
    return found.select("vec_id", "rank", "neighbour", F.round(F.col("cosine").cast("double"), 4).alias("cosine"))


# ---- problem 4


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = table(spark, sf_dir, "repo_graphs")
    return graphs.select(
        F.lower(F.regexp_replace("instance_id", r"^\s+|\s+$", "")).alias("instance_id"),
        normal_name(F.col("repo")).alias("repo"),
        project_of_instance(F.col("instance_id")).alias("named"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = Workspace(spark, "p4").keep(components(_projects(spark, sf_dir), "repo", "named"), "names")
    # the result itself lists pairs; names of one project are few, instances play no part here
    other = names.toDF("repo_b", "component")
    return (
        names.withColumnRenamed("name", "repo_a").join(other, "component").where("repo_a < repo_b").select("repo_a", "repo_b")
    )


def p4_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _projects(spark, sf_dir)
    names = Workspace(spark, "p4").keep(components(rows, "repo", "named"), "names")
    of = rows.select("instance_id", F.coalesce("named", "repo").alias("name")).distinct()
    records = of.join(names, "name", "left").select("instance_id", "component")
    targets = table(spark, sf_dir, "split_targets")
    return split_by_component(records, "instance_id", "component", targets, "split_name", "share")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = p4_split(spark, sf_dir).groupBy("split").agg(
        F.count(F.lit(1)).alias("instances"), F.count_distinct("component").alias("projects")
    )
    whole = got.agg(F.sum("instances").alias("whole"))
    targets = table(spark, sf_dir, "split_targets").select(F.col("split_name").alias("split"), "share")
    return targets.join(got, "split", "left").crossJoin(whole).select(
        "split", F.col("share").alias("target"), F.coalesce("instances", F.lit(0)).alias("instances"),
        F.coalesce("projects", F.lit(0)).alias("projects"),
        F.round(F.coalesce(F.try_divide("instances", "whole"), F.lit(0.0)), 6).alias("reached"),
    )


# ---- problem 5


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tf_idf(graph_terms(table(spark, sf_dir, "graph_nodes")), "instance_id", "id", "term", unique=True)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).where("tf >= 5 AND df <= 3").select("instance_id", "term")


def p5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).withColumn("score", F.round("score", 6))


# ---- problem 6


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "prediction_ranked").where(F.col("lexical").isNotNull() & ~F.isnan("lexical"))
    valid = latest(rows, ["instance_id", "node"], ["scored_at", "pred_id"], ["lexical", "hops"])
    return top_n(valid, "instance_id", "lexical", ["hops", "node"], TOP, unique=True)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("instance_id", "node")


def p6_top_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("instance_id", "rank", "node", "lexical", F.col("hops").cast("double").alias("hops"))


# ---- problem 7


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", word_punct_count(F.col("text")).alias("tokens"))
    return pack(docs, "doc_id", "tokens", CONTAINER)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).groupBy("doc_id").agg(F.max("piece").alias("last")).where("last > 0").select("doc_id")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    per = _packed(spark, sf_dir).groupBy("container").agg(F.sum("size").alias("fill"), F.count(F.lit(1)).alias("pieces"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("fill").alias("tokens"),
        F.round(F.sum("fill") / (F.count(F.lit(1)) * CONTAINER), 6).alias("fill_share"), F.max("fill").alias("most"),
    )


# ---- problem 8


def _mixture(spark: SparkSession, sf_dir: str, **how) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", source_key(F.col("source")).alias("source"), word_punct_count(F.col("text")).alias("tokens")
    )
    targets = table(spark, sf_dir, "mix_targets").withColumn("source", source_key(F.col("source")))
    return mix(docs, "doc_id", "source", "tokens", targets, **how)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1].where("limited").select("source")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _mixture(spark, sf_dir)[1]
    return report.withColumn("share", F.round("share", 6)).withColumn("budget", F.round("budget", 3))


def p8_tempered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares where the sources' own sizes are tempered: evened out as far as repetition allows, or to an entropy of 2 nats."""
    reports = [
        _mixture(spark, sf_dir, temper=t)[1].select(
            F.lit(str(t)).alias("aim"), "source", *[F.round(c, 6).alias(c) for c in ("weight", "share")], "used"
        )
        for t in ("limits", ENTROPY)
    ]
    return reports[0].unionByName(reports[1])


# ---- problem 9


def _residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_content(_residue(spark, sf_dir), "doc_id").select("doc_id")


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source that stay once the cases are left out, and how many went for what."""
    found = without_content(_residue(spark, sf_dir), "doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", source_key(F.col("source")).alias("source"))
    kind = F.when(F.col("class").isNull(), "kept").otherwise(F.get(F.array(*map(F.lit, CLASS_NAMES)), F.col("class")))
    return docs.join(found, "doc_id", "left").groupBy("source", kind.alias("why")).agg(F.count(F.lit(1)).alias("documents"))


def p9_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages other than content with the number of documents and sources they stand in."""
    rows = _residue(spark, sf_dir).where("class <> 0 AND message <> ''")
    return rows.groupBy("message", "class").agg(
        F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p2_found, p2_clean, p3_found, p3_neighbours, p4_found, p4_split, p4_shares, p5_found, p5_scores, p6_found, p6_top_nodes,
        p7_found, p7_containers, p7_fill, p8_found, p8_mixture, p8_shares, p8_tempered, p9_found, p9_kept, p9_messages,
    )
}
