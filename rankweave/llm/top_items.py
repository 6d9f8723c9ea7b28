"""Top N items of every group by statistics of a clustered table (problem 6).

The items are written once, clustered by group and score, in small Parquet row groups. A scan
then reads the footers first and takes the row groups of a file in descending greatest score.
A row group is skipped if it lies strictly below the current N-th score of every group in it;
equal scores are read, because the tie rule may still choose them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from rankweave.session import Workspace

#: Bytes that a row group may buffer while it is written.
ROW_GROUP_BYTES = 256 * 1024


def latest(df: DataFrame, keys: Sequence[str], newest: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Of each key the row with the greatest ``newest`` (nulls least); exact copies are one row."""
    best = F.max(F.struct(*newest, *[v for v in values if v not in newest])).alias("_best")
    got = df.groupBy(*keys).agg(best)
    return got.select(*keys, *[F.col(f"_best.{v}").alias(v) for v in values])


def _footers(batches: Iterator[pd.DataFrame], group: str, score: str) -> Iterator[pd.DataFrame]:
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    for batch in batches:
        for uri in batch["uri"]:
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as f:
                meta = pq.ParquetFile(f).metadata
            names = [meta.schema.column(i).path for i in range(meta.num_columns)]
            rows = []
            for i in range(meta.num_row_groups):
                rg = meta.row_group(i)
                g, s = (rg.column(names.index(c)).statistics for c in (group, score))
                known = g is not None and g.has_min_max
                rows.append(
                    {
                        "uri": uri,
                        "rg": i,
                        "n": rg.num_rows,
                        "one": str(g.min) if known and g.min == g.max else None,
                        "top": float(s.max) if s is not None and s.has_min_max else float("inf"),
                        "low": float(s.min) if s is not None and s.has_min_max else float("-inf"),
                    }
                )
            yield pd.DataFrame(rows, columns=["uri", "rg", "n", "one", "top", "low"])


def _scan(pdf: pd.DataFrame, columns: list[str], n: int) -> pd.DataFrame:
    """Best n of each group in one file; pdf: its row groups that are worth a look.

    Row groups are taken in descending greatest score. One that lies strictly below the n-th score
    of every group in it is skipped, one with several groups after a look at its group column.
    """
    import pyarrow.compute as pc
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    group, score, ties = columns[0], columns[1], columns[2:]
    fs, path = pafs.FileSystem.from_uri(pdf["uri"].iloc[0])
    parts = [pd.DataFrame(columns=columns)]
    first: dict[str, np.ndarray] = {}  # the n greatest scores seen of each group that goes on in another row group

    def done(g: str, top: float) -> bool:
        return g in first and len(first[g]) == n and top < first[g][-1]

    with fs.open_input_file(path) as f:
        file = pq.ParquetFile(f)
        for row in pdf.sort_values(["top", "rg"], ascending=[False, True]).itertuples():
            if row.one is not None:
                if done(row.one, row.top):
                    continue
            elif first:  # which groups it holds says the group column alone
                if all(done(g, row.top) for g in pc.unique(file.read_row_group(row.rg, columns=[group]).column(0)).to_pylist()):
                    continue
            part = file.read_row_group(row.rg, columns=columns).to_pandas()
            part = part.sort_values([group, score, *ties], ascending=[True, False] + [True] * len(ties), na_position="last")
            part = part.groupby(group, sort=False).head(n)
            parts.append(part)
            # the file is in the order of groups, so only the outer ones lie in other row groups too
            for g in {part[group].iloc[0], part[group].iloc[-1]} if len(part) else ():
                both = np.concatenate([first.get(g, np.zeros(0)), part.loc[part[group] == g, score].to_numpy(float)])
                first[g] = -np.sort(-both)[:n]
    best = pd.concat([x for x in parts if len(x)] or parts[:1], ignore_index=True)
    best = best.sort_values([group, score, *ties], ascending=[True, False] + [True] * len(ties), na_position="last")
    return best.groupby(group, sort=False).head(n)[columns]


def top_n(items: DataFrame, group: str, score: str, ties: Sequence[str], n: int, unique: bool = False) -> DataFrame:
    """``group, score, ties..., rank`` of the first n items of each group.

    Order: score descending, then each tie column ascending with null last. Rows whose group or
    score is null or whose score is NaN are ignored; rows that agree in all columns are one
    item; ``unique`` says that there are none and saves a shuffle. Groups of any size are allowed: their row groups lie in many files, each file yields
    at most n candidates of a group, and only those meet.
    """
    spark = items.sparkSession
    ws = Workspace(spark, "topn")
    names = ["_g", "_s", *[f"_t{i}" for i in range(len(ties))]]
    slim = items.select(
        F.col(f"`{group}`").cast("string").alias("_g"),
        (F.col(f"`{score}`").cast("double") + F.lit(0.0)).alias("_s"),
        *[F.col(f"`{t}`").alias(a) for t, a in zip(ties, names[2:], strict=True)],
    ).where(F.col("_g").isNotNull() & F.col("_s").isNotNull() & ~F.isnan("_s"))
    # written first: the bounds of the ranges are taken from a sample, which would compute it twice
    slim = ws.keep(slim if unique else slim.distinct(), "items")
    kinds = {f.name: f.dataType for f in slim.schema.fields}
    clustered = slim.repartitionByRange(F.col("_g"), F.col("_s").desc()).sortWithinPartitions(
        F.col("_g"), F.col("_s").desc(), *[F.col(t).asc_nulls_last() for t in names[2:]]
    )
    ws.keep(clustered, "clustered", **{"parquet.block.size": str(ROW_GROUP_BYTES)})
    files = [(uri,) for uri, _ in ws.files("clustered")]
    uris = spark.createDataFrame(files, "uri string").repartition(max(1, len(files)))
    row_groups = ws.keep(
        uris.mapInPandas(
            lambda it: _footers(it, "_g", "_s"), "uri string, rg int, n bigint, one string, top double, low double"
        ),
        "footers",
    )
    # A row group of one group with n items bounds the N-th score of that group from below.
    floor = row_groups.where((F.col("n") >= n) & F.col("one").isNotNull()).groupBy("one").agg(F.max("low").alias("_floor"))
    worth = (
        row_groups.join(floor, "one", "left")
        .where(F.col("_floor").isNull() | (F.col("top") >= F.col("_floor")))
        .select("uri", "rg", "one", "top")
    )
    schema = T.StructType([T.StructField(c, kinds[c]) for c in names])
    # as many tasks as files: the descriptions are small, what they stand for is not
    worth = worth.repartition(max(1, len(files)), "uri")
    found = worth.groupBy("uri").applyInPandas(lambda pdf: _restore(_scan(pdf, names, n), schema), schema)
    order = Window.partitionBy("_g").orderBy(F.col("_s").desc(), *[F.col(t).asc_nulls_last() for t in names[2:]])
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select(
            F.col("_g").alias(group),
            F.col("_s").alias(score),
            *[F.col(a).alias(t) for t, a in zip(ties, names[2:], strict=True)],
            "rank",
        )
    )


def _restore(pdf: pd.DataFrame, schema: T.StructType) -> pd.DataFrame:
    """Whole-number columns that pandas holds as floats because of nulls."""
    for f in schema.fields:
        if isinstance(f.dataType, T.IntegralType):
            pdf = pdf.assign(**{f.name: pdf[f.name].astype("Int64")})
    return pdf
