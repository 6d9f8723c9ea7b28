from pyspark.sql import functions as F

from rankweave.functions.text import normal_name
from rankweave.streaming.evaluations import daily_totals, evaluation_stream


def test_stream_matches_batch(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/cross_repo.parquet")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    query = (
        daily_totals(evaluation_stream(spark, str(tmp_path / "in")), "1000 days").writeStream.outputMode("complete")
        .format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "ck")).start()
    )
    query.processAllAvailable()
    query.stop()
    got = {(r["day"], r["repo"]): r["n"] for r in spark.table("totals").collect()}
    once = rows.distinct().withColumn("repo", normal_name(F.col("repo"))).where("repo IS NOT NULL")
    want = once.groupBy(F.date_trunc("day", "evaluated_at").alias("day"), "repo").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    assert got == {(r["day"], r["repo"]): r["n"] for r in want.collect()}
