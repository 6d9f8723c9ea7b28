import numpy as np
import pytest
from pyspark.sql import functions as F

from rankweave.llm import neighbours as N

SCHEMA = "vec_id bigint, embedding array<float>"


def table(spark, x, ids=None):
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return [set(np.argsort(-row, kind="stable")[:k]) for row in s], s


def lists(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["vec_id"], {})[r["neighbour"]] = (r["rank"], r["cosine"])
    return out


def test_rotation_keeps_lengths_and_angles():
    x = np.random.default_rng(0).standard_normal((50, 24)).astype(np.float32)
    y = N.pseudo_rotate(x, 3)
    assert y.shape == (50, 32)
    assert np.allclose(x @ x.T, y @ y.T, atol=1e-4)


@pytest.mark.parametrize("n", [2, 7, 600, 3000])
def test_block_is_exact(n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 64)).astype(np.float32)
    x[: n // 3] += 2 * rng.standard_normal(64).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, other, cos = N.block_top(x, 10)
    s = x @ x.T
    np.fill_diagonal(s, -9)
    k = min(10, n - 1)
    want = -np.sort(-s, axis=1)[:, :k]
    assert np.allclose(np.sort(cos.reshape(n, k)), np.sort(want), atol=1e-6)
    sides = (np.arange(n) % 2).astype(np.int32)
    row, other, _ = N.block_top(x, 10, sides)
    assert (sides[row] != sides[other]).all()


def test_recall_and_cosines(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 64)) * 2
    x = centres[rng.integers(0, 20, 4000)] + rng.standard_normal((4000, 64))
    x *= rng.lognormal(0, 2, (4000, 1))
    want, s = exact(x, 10)
    got = lists(N.knn(table(spark, x), "vec_id", "embedding", 64))
    asked = range(0, 4000, 20)
    assert sum(len(set(got[i]) & want[i]) for i in asked) / (10 * len(asked)) >= 0.9
    assert all(abs(c - s[i][j]) < 3e-5 for i in asked for j, (_, c) in got[i].items())
    assert all(sorted(r for r, _ in v.values()) == list(range(1, 11)) for v in got.values())


def test_buckets_grow_with_size_and_probes_do_not_fall():
    sizes = [16_000, 20_000, 200_000, 2_000_000, 20_000_000, 200_000_000, 10**10]
    plans = [N.scheme(n, 64) for n in sizes]
    probes = [sum(p.counts) for p in plans]
    assert min(probes) >= 7 and probes == sorted(probes) and probes[-1] > probes[2]
    assert all(n * max(p.counts) <= N.LOAD * p.buckets(64) for n, p in zip(sizes, plans, strict=True))
    assert all(p.buckets(64) <= max(128, 8 * n * max(p.counts) / N.LOAD) for n, p in zip(sizes, plans, strict=True))
    assert len(plans[-1].axes) > 2


@pytest.mark.parametrize("n", [800_000, 2_000_000, 6_000_000])
def test_recall_of_divided_buckets(n):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((50, 64)) * 2
    x = centres[rng.integers(0, 50, 40_000)] + rng.standard_normal((40_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x[:200] @ x.T
    s[np.arange(200), np.arange(200)] = -9
    near = np.argsort(-s, axis=1)[:, :10]
    plan = N.scheme(n, 64)
    assert plan.axes
    where = N.probes((x - x.mean(axis=0)).astype(np.float32), plan)
    met = (where[:200, None, :, None] == where[near][:, :, None, :]).any(axis=(2, 3))
    assert met.mean() >= 0.9


def in_parts(n, seed=6):
    """Vectors around 12 centres of uneven weight."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(8).standard_normal((12, 64))
    weight = 1 / np.arange(1, 13)
    return centres[rng.choice(12, n, p=weight / weight.sum())] + 0.8 * rng.standard_normal((n, 64))


def test_large_collections_are_told_apart_first():
    x = in_parts(20_000)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    for n, copies in ((1_000_000, 1), (16_800_000, N.SHARED)):
        at = N.places(x, n, 10)
        where = at.of(x[:4000])
        assert len(at.schemes) == 12 and (where >= 0).sum(axis=1).max() <= copies
        loads = np.bincount(where[where >= 0]) * (n / 4000)
        assert loads.max() <= 2 * N.GROUP
        assert sum(N.scheme(n, 64).counts) > 2 * copies
    blob = np.random.default_rng(7).standard_normal((5000, 64)).astype(np.float32)
    blob /= np.linalg.norm(blob, axis=1, keepdims=True)
    assert len(N.places(blob, 1_000_000, 10).schemes) == 1  # nothing to tell apart, nothing torn


@pytest.mark.parametrize("group", [N.GROUP, 1000])
def test_recall_of_parts(spark, monkeypatch, group):
    x = in_parts(4000)
    want, s = exact(x, 10)
    monkeypatch.setattr(N, "BLOCK", 2000)
    monkeypatch.setattr(N, "GROUP", group)
    got = lists(N.knn(table(spark, x), "vec_id", "embedding", 64))
    asked = range(0, 4000, 20)
    recall = sum(len(set(got[i]) & want[i]) for i in asked) / (10 * len(asked))
    assert recall >= (0.98 if group > 1000 else 0.9)
    assert all(abs(c - s[i][j]) < 3e-5 for i in asked for j, (_, c) in got[i].items())


def test_hashed_group():
    rng = np.random.default_rng(9)
    x = (rng.standard_normal((12_000, 64)) + 2).astype(np.float32)
    x[5000:5100] = x[:100] + 0.2 * rng.standard_normal((100, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, other, cos = N.hashed_top(x, 10, 8, 4, 24, 5)
    assert (row != other).all() and len(set(zip(row.tolist(), other.tolist(), strict=True))) == len(row)
    assert np.bincount(row).max() == 10
    assert np.allclose(cos, (x[row] * x[other]).sum(axis=1), atol=1e-6)
    found = set(zip(row.tolist(), other.tolist(), strict=True))
    assert all((i, 5000 + i) in found and (5000 + i, i) in found for i in range(100))
    s = x[:200] @ x.T
    s[np.arange(200), np.arange(200)] = -9
    near = np.argsort(-s, axis=1)[:, :10]
    assert np.mean([(i, j) in found for i in range(200) for j in near[i].tolist()]) >= 0.9


def test_sub_blocks_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 64)) + 3  # one crowded direction
    monkeypatch.setattr(N, "BLOCK", 100)
    got = lists(N.knn(table(spark, x), "vec_id", "embedding", 64, plan=N.Scheme((), (6,))))
    monkeypatch.undo()
    whole = lists(N.knn(table(spark, x), "vec_id", "embedding", 64, plan=N.Scheme((), (6,))))
    assert {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in whole.items()}


def test_second_level(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 64))
    x[1::2] = x[::2] + 0.05 * rng.standard_normal((750, 64))
    monkeypatch.setattr(N, "LOAD", 50)
    pairs = N.knn_pairs_at_least(table(spark, x), "vec_id", "embedding", 64, 0.92)
    got = {tuple(r) for r in pairs.collect()}
    assert {(i, i + 1) for i in range(0, 1500, 2)} <= got


def test_hot_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 64))
    x[::3] = x[0]  # a third of all rows is one vector
    x[1] = x[4] = x[7]
    got = lists(N.knn(table(spark, x), "vec_id", "embedding", 64))
    first = list(range(0, 33, 3))
    for i in (0, 3, 300, 597):
        assert set(got[i]) == set([f for f in first if f != i][:10])
    assert {4, 7} <= set(got[1]) and {1, 7} <= set(got[4])
    assert len(got) == 600 and all(len(v) == 10 for v in got.values())


def test_unusable_rows_and_clashing_names(spark):
    good = [1.0] + [0.0] * 63
    near = [1.0, 0.1] + [0.0] * 62
    rows = [
        (1, good), (2, near), (3, None), (4, [0.0] * 64), (5, good[:48]), (6, good + [1.0]), (7, [float("nan")] + good[1:]), (8, [float("inf")] + good[1:]), (9, [None] + good[1:]), (None, good),
        (10, [1e-30] + [0.0] * 63),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("rank", F.lit(0)).withColumn("v", F.lit(0))
    got = lists(N.knn(df, "vec_id", "embedding", 64))
    assert {k: set(v) for k, v in got.items()} == {1: {2, 10}, 2: {1, 10}, 10: {1, 2}}
    pairs = {tuple(r) for r in N.knn_pairs_at_least(df, "vec_id", "embedding", 64, 0.92).collect()}
    assert pairs == {(1, 2), (1, 10), (2, 10)}


def test_threshold_is_exact(spark):
    a = np.zeros((3, 64))
    a[0, 0] = 1
    a[1, :2] = 0.92, np.sqrt(1 - 0.92**2) - 1e-7
    a[2, :2] = 0.92 - 2e-6, -np.sqrt(1 - 0.92**2)
    x = a.astype(np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(3) for j in range(i + 1, 3) if u[i] @ u[j] >= 0.92}
    assert {tuple(r) for r in N.knn_pairs_at_least(table(spark, a), "vec_id", "embedding", 64, 0.92).collect()} == want


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert N.knn(df, "vec_id", "embedding", 64).count() == 0
    assert N.knn_pairs_at_least(df, "vec_id", "embedding", 64, 0.9).count() == 0
    one = spark.createDataFrame([(1, [1.0] * 64)], SCHEMA)
    assert N.knn(one, "vec_id", "embedding", 64).count() == 0
