"""BM25 and TF-IDF over many small corpora at once: one corpus per value of the group column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankweave.functions.text import IDENT, STOP_CORE, ident_tokens, qualified_name, words
from rankweave.session import Workspace, spread

K1, B = 1.5, 0.75


def postings(docs: DataFrame, group: str, doc: str, tokens: str) -> DataFrame:
    """``group, doc, term, tf``."""
    return docs.select(group, doc, F.explode(tokens).alias("term")).groupBy(group, doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, group: str, tokens: str) -> DataFrame:
    """``group, n, avgdl``: documents, empty ones included, and mean length (1 if all are empty)."""
    length = F.size(tokens)
    mean = F.when(F.sum(length) > 0, F.sum(length) / F.count(F.lit(1))).otherwise(F.lit(1.0))
    return docs.groupBy(group).agg(F.count(F.lit(1)).alias("n"), mean.alias("avgdl"))


def bm25(docs: DataFrame, queries: DataFrame, group: str, doc: str, tokens: str, k1: float = K1, b: float = B) -> DataFrame:
    """``group, doc, score`` of every document, 0 without a match.

    ``queries`` has ``group, term``; repeated terms count once. Only postings of query terms are
    kept before anything is aggregated, so the work follows the matches. Tokens are read several
    times and therefore written first.
    """
    ws = Workspace(docs.sparkSession, "bm25")
    docs, queries = ws.keep(docs.select(group, doc, tokens), "docs"), ws.keep(queries.select(group, "term"), "queries")
    terms = queries.select(group, "term").distinct()
    hits = ws.keep(postings(docs, group, doc, tokens).join(terms, [group, "term"]), "hits")
    df = hits.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"))
    lengths = docs.select(group, doc, F.size(tokens).alias("dl"))
    stats = corpus_stats(docs, group, tokens)
    tf, n, d = F.col("tf"), F.col("n"), F.col("df")
    idf = F.log(1 + (n - d + 0.5) / (d + 0.5))
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = (
        hits.join(df, [group, "term"]).join(lengths, [group, doc]).join(stats, group).groupBy(group, doc).agg(F.sum(part).alias("score"))
    )
    return docs.select(group, doc).join(scored, [group, doc], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def ranked(scores: DataFrame, group: str, doc: str) -> DataFrame:
    """Adds ``lex`` and ``lex_rank`` from 1; ties by document.

    The score is kept to nine places: enough to tell any two scores apart that differ by more than
    the order of summation, which no two runs share.
    """
    order = Window.partitionBy(group).orderBy(F.col("lex").desc(), doc)
    return scores.select(group, doc, F.round("score", 9).alias("lex")).withColumn("lex_rank", F.row_number().over(order))


def six_places(score: Column) -> Column:
    """A score as it is shown."""
    return F.floor(score * 1e6 + 0.5) / 1e6


def name_documents(nodes: DataFrame, stop: tuple[str, ...] = STOP_CORE) -> DataFrame:
    """``instance_id, idx, tokens``: identifier tokens of qualified name and signature."""
    tokens = F.concat(ident_tokens(qualified_name(F.col("id")), stop), ident_tokens(F.col("sig"), stop))
    return nodes.select("instance_id", "idx", tokens.alias("tokens"))


def issue_terms(instances: DataFrame, stop: tuple[str, ...] = STOP_CORE) -> DataFrame:
    """``instance_id, term``: each identifier of an issue is split once, however often it occurs."""
    found = F.regexp_extract_all(F.col("issue"), F.lit(IDENT), F.lit(0))
    toks = spread(instances, "instance_id").select("instance_id", F.explode(found).alias("tok")).distinct()
    return toks.select("instance_id", F.explode(ident_tokens(F.col("tok"), stop)).alias("term")).distinct()


def name_scores(nodes: DataFrame, instances: DataFrame, stop: tuple[str, ...] = STOP_CORE) -> DataFrame:
    """``instance_id, idx, lex, lex_rank`` of the nodes of every instance that has an issue."""
    docs = name_documents(spread(nodes, "instance_id", "idx").join(instances.select("instance_id"), "instance_id", "left_semi"), stop)
    return ranked(bm25(docs, issue_terms(instances, stop), "instance_id", "idx", "tokens"), "instance_id", "idx")


def file_scores(nodes: DataFrame, instances: DataFrame) -> DataFrame:
    """``instance_id, file, lex, lex_rank``: BM25 of each file over the distinct tokens of its path."""
    files = nodes.join(instances.select("instance_id"), "instance_id", "left_semi").select("instance_id", "file").distinct()
    docs = files.withColumn("tokens", F.array_distinct(ident_tokens(F.col("file"))))
    return ranked(bm25(docs, issue_terms(instances), "instance_id", "file", "tokens"), "instance_id", "file")


def tfidf_scores(nodes: DataFrame, instances: DataFrame) -> DataFrame:
    """``instance_id, idx, lex, lex_rank`` by TF-IDF cosine, the independent check of BM25."""
    tokens = F.concat(words(qualified_name(F.col("id"))), words(F.col("sig")))
    known = spread(nodes, "instance_id", "idx").join(instances.select("instance_id"), "instance_id", "left_semi")
    docs = known.select("instance_id", "idx", tokens.alias("tokens"))
    ws = Workspace(nodes.sparkSession, "tfidf")
    docs = ws.keep(docs, "docs")
    n = docs.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"))
    post = postings(docs, "instance_id", "idx", "tokens")
    df = post.groupBy("instance_id", "term").agg(F.count(F.lit(1)).alias("df"))
    weighted = post.join(df, ["instance_id", "term"]).join(n, "instance_id").select(
        "instance_id", "idx", "term", ((1 + F.log("tf")) * F.log(F.col("n") / (1 + F.col("df")))).alias("w")
    )
    weighted = ws.keep(weighted, "weighted")
    norm = weighted.groupBy("instance_id", "idx").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    query = spread(instances, "instance_id").select("instance_id", F.explode(words(F.col("issue"))).alias("term")).groupBy("instance_id", "term").agg(
        F.count(F.lit(1)).alias("qt")
    )
    query = ws.keep(query, "query")
    qnorm = query.groupBy("instance_id").agg(F.sqrt(F.sum(F.col("qt") * F.col("qt"))).alias("qn"))
    dot = weighted.join(query, ["instance_id", "term"]).groupBy("instance_id", "idx").agg(F.sum(F.col("qt") * F.col("w")).alias("dot"))
    safe = F.when(F.col("norm") > 0, F.col("norm")).otherwise(F.lit(1.0))
    scored = dot.join(norm, ["instance_id", "idx"]).join(qnorm, "instance_id").select(
        "instance_id", "idx", (F.col("dot") / safe / F.col("qn")).alias("score")
    )
    every = docs.select("instance_id", "idx").join(scored, ["instance_id", "idx"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return ranked(every, "instance_id", "idx")
