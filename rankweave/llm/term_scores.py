"""How distinctive a term is of a record: TF-IDF from distributed counts (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankweave.functions.text import ident_tokens, qualified_name
from rankweave.session import Workspace

#: A term counts as common from this share of the records on. The terms of a record add up, so
#: at most (distinct terms of a record on average) / COMMON terms can be common.
COMMON = 0.01


def tf_idf(units: DataFrame, record: str, unit: str, term: str, unique: bool = False) -> DataFrame:
    """``record, term, tf, df, score`` of each term of each record.

    ``units`` has a row for each occurrence: tf is the number of different units of the record
    that hold the term, df the number of records that do, N the number of records with a term.
    score = tf * ln((N + 1) / (df + 0.5)), divided by the Euclidean length of the record's
    scores. Rows with a null record, unit or term are ignored; repeated rows count once
    (``unique`` says that there are none and saves a shuffle); an empty table gives no row.
    """
    ws = Workspace(units.sparkSession, "tfidf")
    occurs = units.select(
        F.col(f"`{record}`").alias("_r"), F.col(f"`{unit}`").alias("_u"), F.col(f"`{term}`").alias("_t")
    ).dropna()
    occurs = occurs if unique else occurs.distinct()
    tf = ws.keep(occurs.groupBy("_r", "_t").agg(F.count(F.lit(1)).alias("_tf")), "tf")
    n = tf.agg(F.count_distinct("_r").alias("_n"))
    df = ws.keep(tf.groupBy("_t").agg(F.count(F.lit(1)).alias("_df")).crossJoin(F.broadcast(n)), "df")
    common = df.where(F.col("_df") >= F.col("_n") * COMMON)
    rare = df.where(F.col("_df") < F.col("_n") * COMMON)
    # A common term occurs in up to all records, so its rows must not meet in one task: the few
    # common terms (bounded, see COMMON) travel to the rows, the rare ones are joined by hash.
    marked = tf.join(F.broadcast(common), "_t", "left")
    scored = (
        marked.where(F.col("_df").isNotNull())
        .unionByName(marked.where(F.col("_df").isNull()).drop("_df", "_n").join(rare, "_t"))
        .withColumn("_s", F.col("_tf") * F.log((F.col("_n") + 1) / (F.col("_df") + 0.5)))
    )
    scored = ws.keep(scored, "scored")
    length = scored.groupBy("_r").agg(F.sqrt(F.sum(F.col("_s") * F.col("_s"))).alias("_len"))
    return scored.join(length, "_r").select(
        F.col("_r").alias(record),
        F.col("_t").alias(term),
        F.col("_tf").alias("tf"),
        F.col("_df").alias("df"),
        F.coalesce(F.try_divide(F.col("_s"), F.col("_len")), F.lit(0.0)).alias("score"),
    )


def graph_terms(nodes: DataFrame) -> DataFrame:
    """``instance_id, id, term``: identifier tokens of name and signature of each kept node, each once.

    Rows of one node are brought together before their texts are split, so the long ids cross the
    network once and not with every term.
    """
    kept = nodes.where(F.col("kind").isin("function", "class") & ~F.coalesce("test", F.lit(False)))
    one = kept.groupBy("instance_id", "id").agg(F.collect_set("sig").alias("sigs"))
    sigs = F.flatten(F.transform("sigs", lambda s: ident_tokens(s)))
    toks = F.array_distinct(F.concat(ident_tokens(qualified_name(F.col("id"))), sigs))
    return one.select("instance_id", "id", F.explode(toks).alias("term"))
