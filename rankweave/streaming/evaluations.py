"""Evaluation rows as a stream: late and repeated rows, totals by repository and day.

An extension; the batch queries don't need it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankweave.functions.text import normal_name

SCHEMA = (
    "eval_id bigint, run_id string, instance_id string, repo string, n bigint, lex20 double, mix20 double, hop20 double, "
    "evaluated_at timestamp, loaded_at timestamp"
)


def evaluation_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of evaluation rows as they arrive in a folder."""
    return spark.readStream.schema(SCHEMA).parquet(folder)


def daily_totals(rows: DataFrame, lateness: str = "30 days") -> DataFrame:
    """``day, repo, n, lex20, mix20`` per repository; means are weighted by n (null counts as 0).

    Rows later than ``lateness`` are dropped, and so are repeated ids within it. Rows without a
    repository or a time have no total.
    """
    n = F.coalesce("n", F.lit(0))

    def mean(m: str):
        return F.try_divide(F.sum(n * F.col(m)), F.sum(F.when(F.col(m).isNotNull(), n))).alias(m)

    named = rows.withColumn("repo", normal_name(F.col("repo"))).where("repo IS NOT NULL AND evaluated_at IS NOT NULL")
    once = named.withWatermark("evaluated_at", lateness).dropDuplicatesWithinWatermark(["eval_id"])
    got = once.groupBy(F.window("evaluated_at", "1 day"), "repo").agg(F.sum(n).alias("n"), mean("lex20"), mean("mix20"))
    return got.select(F.col("window.start").alias("day"), "repo", "n", "lex20", "mix20")
