"""Writers of predictions, labels and reports."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F


def predictions(localized: DataFrame, top_n: int | None = None) -> DataFrame:
    """``instance_id, reach_hops, seeds, ranked``: one nested record per instance, ready for JSON."""
    rows = localized if top_n is None else localized.where(F.col("rank") <= top_n)
    fields = [c for c in rows.columns if c != "instance_id"]
    # at most top_n rows an instance come together here
    got = rows.groupBy("instance_id").agg(F.max("hops").alias("reach_hops"), F.sort_array(F.collect_list(F.struct(*fields))).alias("ranked"))
    seeds = F.transform(F.filter("ranked", lambda r: r["hops"] == 0), lambda r: r["node"])
    return got.select("instance_id", "reach_hops", seeds.alias("seeds"), "ranked")


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in a folder."""
    df.write.mode("overwrite").json(path)


def report_lines(skill_rows: DataFrame) -> DataFrame:
    """``instance_id, rank, line``: ``rank score hops file:line symbol``."""
    line = F.format_string("%d %.4f %d %s:%d %s", "rank", "score", "hops", "file", "start", "symbol")
    return skill_rows.select("instance_id", "rank", line.alias("line"))


def write_features(df: DataFrame, path: str) -> None:
    """The feature cache, as Parquet."""
    df.write.mode("overwrite").parquet(path)


def write_result(summary: Mapping[str, Any], rows: DataFrame, path: str) -> None:
    """One JSON document ``{"summary": ..., "rows": [...]}``, the form of the published results.

    The rows of a result are one an instance; they pass through the driver a partition at a time.
    """
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    names = [F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")]
    try:
        out.write(bytearray(('{"summary": ' + json.dumps(dict(summary)) + ', "rows": [').encode()))
        for i, r in enumerate(rows.select(*names).toLocalIterator()):
            out.write(bytearray(((",\n" if i else "\n") + r["j"]).encode()))
        out.write(bytearray(b"]}\n"))
    finally:
        out.close()


def read_result(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Summary and rows of a published result; a plain list of rows has an empty summary."""
    got = spark.read.json(path, multiLine=True)
    if "rows" not in got.columns:
        return spark.createDataFrame([()], "struct<>"), got
    return got.select("summary.*"), got.select(F.inline("rows"))


def report_table(df: DataFrame, widths: Mapping[str, int], order: str, places: int = 3) -> DataFrame:
    """``line`` of a fixed-width text report, in the order of a column; texts left, numbers right."""
    cells = []
    for name, width in widths.items():
        kind = df.schema[name].dataType.simpleString()
        if kind == "string":
            cells.append(F.rpad(F.coalesce(name, F.lit("-")), width, " "))
        else:
            shown = F.format_string(f"%.{places}f", F.col(name).cast("double")) if kind in ("double", "float") else F.col(name).cast("string")
            cells.append(F.lpad(F.coalesce(shown, F.lit("-")), width, " "))
    return df.orderBy(order).select(F.concat(*cells).alias("line"))
