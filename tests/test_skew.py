import math
import random

import pytest
from pyspark.sql import functions as F

from rankweave.operators import skew
from rankweave.operators.skew import exact_quantiles, key_profile


def lower(values, q):
    v = sorted(values)
    return v[max(1, len(v) - math.floor(len(v) - q * len(v))) - 1]


@pytest.mark.parametrize("cells", [skew.CELLS, 500])
def test_quantiles_like_sorting_with_a_hot_key(spark, monkeypatch, cells):
    monkeypatch.setattr(skew, "CELLS", cells)  # with 500 the hot key is salted, the others are not
    random.seed(5)
    wild = [0.0, -0.0, 1e-300, -1e-300, 1e308, -1e308, 5e-324, 1.0, 1.0000000000000002]
    rows = [("hot", random.choice([random.gauss(0, 1), random.choice(wild), random.uniform(-1e9, 1e9)])) for _ in range(9000)]
    rows += [(f"k{i % 7}", float(i % 13)) for i in range(500)] + [("one", 3.0), (None, 2.0), ("bad", None), ("bad", float("nan"))]
    df = spark.createDataFrame(rows, "key string, value double").withColumn("_v", F.lit(1)).withColumn("_k0", F.lit("x"))
    got = {(r["key"], r["q"]): r["value"] for r in exact_quantiles(df, ["key"], "value", (0.0, 0.1, 0.5, 0.999, 1.0)).collect()}
    by = {}
    for k, v in rows:
        if v is not None and v == v:
            by.setdefault(k, []).append(v)
    assert got == {(k, q): lower(v, q) for k, v in by.items() for q in (0.0, 0.1, 0.5, 0.999, 1.0)}


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 2.0, 1), ("a", 9.0, None), ("a", 8.0, -3), ("b", 1.0, 0)], "key string, value double, w bigint")
    got = exact_quantiles(df, ["key"], "value", (0.5, 1.0), "w").collect()
    assert sorted((r["key"], r["q"], r["value"], r["rows"]) for r in got) == [("a", 0.5, 1.0, 6), ("a", 1.0, 2.0, 6)]


def test_profile(spark):
    df = spark.createDataFrame(
        [("a", 1, 1.0), ("a", 3, 0.0), ("a", None, 1.0), ("a", 2, None), ("a", 2, float("nan")), ("b", 0, 1.0), (None, 2, 1.0)], "repo string, n bigint, m double"
    ).withColumn("rows", F.lit(9)).withColumn("_key", F.lit(1))
    got = {r["repo"]: r for r in key_profile(df, "repo", "n", ["m"], (0.5,)).collect()}
    assert (got["a"]["rows"], got["a"]["size"], got["a"]["share"], got["a"]["m"], got["a"]["q50"]) == (5, 8, 0.8, 0.25, 2)
    assert (got["b"]["size"], got["b"]["m"]) == (0, None)
    assert got[None]["share"] == 0.2


def test_empty(spark):
    df = spark.createDataFrame([], "repo string, n bigint, m double")
    assert key_profile(df, "repo", "n", ["m"]).count() == 0
    assert exact_quantiles(df, ["repo"], "m", (0.5,)).count() == 0
