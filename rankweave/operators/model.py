"""A learned reranker over the pool: gradient-boosted trees, folds by repository."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from rankweave.operators.corpus import Corpus
from rankweave.operators.features import FEATURES, node_features

FOLDS = 5
ROUNDS = 20


def training_rows(c: Corpus, folds_: int = FOLDS) -> DataFrame:
    """Pool nodes of usable instances with their features, the label and the fold.

    Repositories are put in md5 order and dealt round the folds, so no repository is in two; with
    as many folds as repositories each is left out once.
    """
    repos = c.usable.select("repo").distinct()
    order = Window.orderBy(F.md5(F.coalesce("repo", F.lit(""))), "repo")  # one row a repository
    folds = repos.withColumn("fold", (F.row_number().over(order) - 1) % folds_)
    of = c.usable.select("instance_id", F.coalesce("repo", F.lit("")).alias("r")).join(
        folds.select(F.coalesce("repo", F.lit("")).alias("r"), "fold"), "r"
    )
    label = c.targets.withColumn("label", F.lit(1.0))
    rows = node_features(c).join(of.select("instance_id", "fold"), "instance_id").join(label, ["instance_id", "idx"], "left")
    return rows.withColumn("label", F.coalesce("label", F.lit(0.0)))


def rerank(c: Corpus, rounds: int = ROUNDS, folds: int = FOLDS) -> DataFrame:
    """``instance_id, idx, fold, p, rank``: out-of-fold probability and the order by it.

    A fold whose training rows hold one label only is ordered by the lexical feature.
    """
    rows = c.keep(f"training{folds}", lambda: training_rows(c, folds))
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    parts = []
    for fold in range(folds):
        train, test = assembled.where(F.col("fold") != fold), assembled.where(F.col("fold") == fold)
        if train.select("label").distinct().count() < 2:
            parts.append(test.select("instance_id", "idx", "fold", F.col("lex_norm").alias("p")))
            continue
        model = GBTClassifier(maxIter=rounds, stepSize=0.08, maxDepth=5, seed=7).fit(train)
        scored = model.transform(test)
        parts.append(scored.select("instance_id", "idx", "fold", F.round(vector_to_array("probability")[1], 9).alias("p")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    order = Window.partitionBy("instance_id").orderBy(F.col("p").desc(), "idx")
    return c.keep(f"reranked{folds}_{rounds}", lambda: out.withColumn("rank", F.row_number().over(order)))
