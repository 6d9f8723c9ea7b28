"""Feature vectors of pool nodes and of whole tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankweave.functions.text import NAME, STOP_CORE, TEST_PATH, ident_tokens, qualified_name
from rankweave.operators.corpus import Corpus
from rankweave.operators.measures import arity, commas, degrees, graph_summary, pool_norm

# Features of a pool node in their order.
FEATURES = (
    "lex_norm", "hop", "consensus", "seed_flag", "degree_norm", "in_degree", "out_degree", "same_file_seed", "name_in_issue",
    "sig_overlap", "is_private", "is_dunder", "is_test_adjacent", "n_args", "size_norm", "is_method", "reach_mass", "rank_in_pool",
)
# Patterns of issue texts.
TRACE = (
    r"Traceback \(most recent call last\):|File \".*?\", line [0-9]+|\bAssertionError\b|\bTypeError\b|\bValueError\b|\bKeyError\b"
    r"|\bAttributeError\b|\bImportError\b"
)
TRACE_SHORT = r"Traceback \(most recent call last\):|File \".*?\", line [0-9]+|\bAssertionError\b|\bTypeError\b|\bValueError\b"
FENCE = "```"
TEST_WORDS = r"(?i)\b(test|pytest|assert|fixture|mock|monkeypatch|parametrize)\b"
MOCK_WORDS = r"(?i)\b(mock|MagicMock|Fake|mocker|monkeypatch)\b"
PUNCT = r"[()\[\]{}<>:;=]"


def pool_base(c: Corpus) -> DataFrame:
    """The pool of ten seeds and three hops with everything the feature vectors are made of."""
    seed_files = c.pool().where("hop = 0").join(c.nodes.select("instance_id", "idx", "file"), ["instance_id", "idx"])
    seed_files = seed_files.select("instance_id", "file", F.lit(1).alias("seed_file")).distinct()
    issues = c.instances.select("instance_id", F.array_distinct(ident_tokens(F.col("issue"), STOP_CORE)).alias("issue_toks"))
    return (
        c.pool()
        .join(c.nodes.select("instance_id", "idx", "id", "kind", "file", "sig"), ["instance_id", "idx"])
        .join(degrees(c), ["instance_id", "idx"])
        .join(seed_files, ["instance_id", "file"], "left")
        .join(issues, "instance_id")
        .withColumn("qn", qualified_name(F.col("id")))
        .withColumn("name_toks", F.array_distinct(ident_tokens(F.col("qn"))))
    )


def _flag(c: Column) -> Column:
    return c.cast("double")


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def node_features(c: Corpus) -> DataFrame:
    """``instance_id, idx`` and the 18 features; ``consensus`` is log1p of the reached flag."""
    per = Window.partitionBy("instance_id")
    qn, deg, outs = F.col("qn"), F.col("deg"), F.col("outs")
    dunder = qn.startswith("__") & qn.endswith("__")
    lexical = F.row_number().over(per.orderBy(F.col("lex").desc(), "idx")) - 1
    value = {
        "lex_norm": pool_norm(), "hop": F.col("hop").cast("double"), "consensus": F.log1p(F.col("flag").cast("double")), "seed_flag": _flag(F.col("hop") == 0),
        "degree_norm": F.log1p(deg.cast("double")) / 10, "in_degree": F.log1p(F.greatest(deg - outs, F.lit(0)).cast("double")) / 10,
        "out_degree": F.log1p(outs.cast("double")) / 10, "same_file_seed": _flag(F.col("seed_file").isNotNull()),
        "name_in_issue": _flag(F.arrays_overlap("name_toks", "issue_toks")), "sig_overlap": jaccard(F.col("name_toks"), F.col("issue_toks")),
        "is_private": _flag(qn.startswith("_")), "is_dunder": _flag(dunder), "is_test_adjacent": _flag(F.col("file").rlike(TEST_PATH)),
        "n_args": arity(F.col("sig")), "size_norm": F.least(F.log1p(deg.cast("double")), F.lit(6.0)) / 6,
        "is_method": _flag(F.col("id").contains("::") & ~qn.startswith("__")), "reach_mass": F.pow(F.lit(0.5), F.col("hop")),
        "rank_in_pool": lexical / F.count(F.lit(1)).over(per),
    }
    return pool_base(c).select("instance_id", "idx", *[F.round(value[f], 6).alias(f) for f in FEATURES])


def short_features(c: Corpus) -> DataFrame:
    """``instance_id, idx`` and the 12 features ``f1`` to ``f12`` of the shorter variant."""
    qn = F.col("qn")
    sig_toks = F.array_distinct(ident_tokens(F.col("sig")))
    value = [
        pool_norm(), F.col("hop").cast("double"), F.least("deg", F.lit(60)) / 60.0, jaccard(F.col("name_toks"), F.col("issue_toks")),
        _flag(F.arrays_overlap("name_toks", "issue_toks")), _flag(qn.startswith("_")), _flag(qn.startswith("__") & qn.endswith("__")),
        F.least(commas(F.col("sig")), F.lit(12)) / 12.0, _flag(F.col("seed_file").isNotNull()), F.least("hop", F.lit(3)) / 3.0,
        F.least(F.size(F.array_intersect(sig_toks, F.col("issue_toks"))), F.lit(40)) / 40.0, _flag(F.col("kind") == "class"),
    ]
    return pool_base(c).select("instance_id", "idx", *[F.round(v, 6).alias(f"f{i}") for i, v in enumerate(value, 1)])


def issue_features(instances: DataFrame) -> DataFrame:
    """``instance_id`` and eight features of the issue text."""
    s = F.col("issue")
    upper = F.length(F.regexp_replace(s, r"[^\p{Lu}]", "")) / F.greatest(F.length(s), F.lit(1))
    return instances.select(
        "instance_id", F.regexp_count(s, F.lit(NAME)).cast("double").alias("n_words"), _flag(s.rlike(TRACE)).alias("has_trace"),
        _flag(s.contains(FENCE)).alias("has_fence"), (F.regexp_count(s, F.lit(FENCE)) / 2.0).alias("n_fence"),
        F.regexp_count(s, F.lit(TEST_WORDS)).cast("double").alias("test_words"), F.regexp_count(s, F.lit(MOCK_WORDS)).cast("double").alias("mock_words"),
        F.regexp_count(s, F.lit(PUNCT)).cast("double").alias("punct"), F.round(upper, 6).alias("upper_ratio"),
    )


def triage(c: Corpus) -> DataFrame:
    """Issue, graph and gold features of each instance that has a graph, all as doubles."""
    gold = c.instances.select(
        "instance_id", *[F.size(a).cast("double").alias(n) for a, n in (("entities", "n_gold"), ("files", "n_gold_files"), ("module_level", "n_module_level"), ("added_files", "n_added_files"))]
    )
    graph = graph_summary(c).select("instance_id", *[F.col(x).cast("double").alias(x) for x in ("n_nodes", "mean_deg", "n_files", "cross_file")])
    return issue_features(c.instances).join(graph, "instance_id").join(gold, "instance_id")


def correlations(df: DataFrame, features: list[str], target: Column) -> DataFrame:
    """``feature, r``: Pearson correlation with a 0/1 target; constant features are left out."""
    pairs = ", ".join(f"'{f}', `{f}`" for f in features)
    long = df.withColumn("_y", target.cast("double")).select("_y", F.expr(f"stack({len(features)}, {pairs}) AS (feature, x)"))
    stats = long.groupBy("feature").agg(F.covar_pop("x", "_y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("_y").alias("sy"))
    # not corr(): it divides by zero on a constant feature
    return stats.where("sx > 0 AND sy > 0").select("feature", F.round(F.try_divide("c", F.col("sx") * F.col("sy")), 6).alias("r"))
