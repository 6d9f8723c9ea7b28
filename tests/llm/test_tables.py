"""Splits, term scores, top items, packing and mixing against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rankweave.llm import grouped_split as G, mixing as M, packing as P, term_scores as TS, top_items as TI

# ---- splits


def union(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        if a and b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
        elif a or b:
            find(a or b)
    return {x: find(x) for x in up}


def test_components_like_union_find(spark):
    random.seed(1)
    pairs = [(f"n{random.randrange(300):03}", f"n{random.randrange(300):03}") for _ in range(180)]
    pairs += [(f"chain{i:02}", f"chain{i + 1:02}") for i in range(40)] + [("hub", f"leaf{i:03}") for i in range(200)] + [("solo", None), (None, "other"), (None, None), ("x", "x")]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("u", F.lit(1)).withColumn("name", F.lit(2))
    got = {r["name"]: r["component"] for r in G.components(df, "a", "b").collect()}
    want = union(pairs)
    assert set(got) == set(want)
    same = defaultdict(set)
    for n, c in got.items():
        same[c].add(n)
    assert all(len({want[n] for n in names}) == 1 for names in same.values()) and len(same) == len(set(want.values()))
    assert all(c == min(names) for c, names in same.items())


def test_components_of_nothing(spark):
    assert G.components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 40)), min_size=1, max_size=12, unique_by=lambda b: b[0]))
def test_allocation_is_whole_and_near_quota(bundles):
    shares = [0.8, 0.1, 0.1]
    plan = G.allocate(bundles, shares)
    assert [sum(row) for row in plan] == [c for _, c in bundles] and all(x >= 0 for row in plan for x in row)
    total = sum(s * c for s, c in bundles)
    off = sum(abs(sum(row[j] * b[0] for row, b in zip(plan, bundles)) - total * shares[j]) for j in range(3))
    assert off <= 2 * max(s for s, _ in bundles) * 3


def test_split_keeps_components_and_shares(spark):
    rows = [(f"i{i}", f"c{i % 400}") for i in range(4000)] + [(f"big{i}", "giant") for i in range(2000)] + [("none1", None), ("none2", None), (None, "c1"), ("i1", "c1")]
    df = spark.createDataFrame(rows, "rec string, comp string").withColumn("_size", F.lit(1)).withColumn("split", F.lit("x"))
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "s string, w double")
    got = G.split_by_component(df, "rec", "comp", targets, "s", "w").collect()
    assert len(got) == len({r["rec"] for r in got}) == 6002
    by = defaultdict(set)
    for r in got:
        if r["comp"]:
            by[r["comp"]].add(r["split"])
    assert all(len(v) == 1 for v in by.values())
    n = Counter(r["split"] for r in got)
    assert abs(n["train"] / 6002 - 0.8) < 0.01 and abs(n["test"] / 6002 - 0.1) < 0.01
    assert G.split_by_component(df.limit(0), "rec", "comp", targets, "s", "w").count() == 0


def test_profiles_are_balanced(spark):
    rows = [(f"{k}{i}", f"{k}{i}", k) for k in "ab" for i in range(100)]
    targets = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "s string, w double")
    df = spark.createDataFrame(rows, "rec string, comp string, kind string")
    got = G.split_by_component(df, "rec", "comp", targets, "s", "w", label=F.col("kind")).collect()
    assert Counter(r["split"] for r in got) == {"x": 100, "y": 100}


# ---- term scores


def test_tf_idf_like_plain_python(spark):
    random.seed(2)
    rows = [(f"r{random.randrange(40)}", f"u{random.randrange(30)}", f"t{int(random.paretovariate(0.7))}") for _ in range(4000)]
    rows += [("hot", f"u{i}", f"t{i % 50}") for i in range(2000)] + [(None, "u", "t"), ("r", None, "t"), ("r", "u", None)] + rows[:50]
    df = spark.createDataFrame(rows, "r string, u string, t string").withColumn("_t", F.lit("x")).withColumn("score", F.lit(1))
    occ = {x for x in rows if None not in x}
    tf = Counter((r, t) for r, _, t in occ)
    dfs = Counter(t for _, t in tf)
    n = len({r for r, _ in tf})
    s = {k: v * math.log((n + 1) / (dfs[k[1]] + 0.5)) for k, v in tf.items()}
    norm = defaultdict(float)
    for (r, _), v in s.items():
        norm[r] += v * v
    got = {(x["r"], x["t"]): (x["tf"], x["df"], x["score"]) for x in TS.tf_idf(df, "r", "u", "t").collect()}
    assert set(got) == set(tf)
    for k, (a, b, c) in got.items():
        assert (a, b) == (tf[k], dfs[k[1]]) and c == pytest.approx(s[k] / math.sqrt(norm[k[0]]), abs=1e-9)
    assert TS.tf_idf(df.limit(0), "r", "u", "t").count() == 0


def test_graph_terms_use_kept_nodes(spark):
    rows = [
        ("a", 0, "f.py::getItem", "function", "f.py", "def getItem(key)", None, 1), ("a", 1, "f.py::getItem", "function", "f.py", None, False, 1),
        ("a", 2, "f.py::x", "file", "f.py", None, False, 1), ("a", 3, "f.py::test_y", "function", "f.py", None, True, 1), ("a", 4, "plain", None, "f.py", "zzz", False, 1),
    ]
    df = spark.createDataFrame(rows, "instance_id string, node_idx bigint, id string, kind string, file string, sig string, test boolean, start int")
    got = {(r["id"], r["term"]) for r in TS.graph_terms(df).collect()}
    assert got == {("f.py::getItem", t) for t in ("getitem", "get", "item", "def", "key")}


# ---- top items


def want_top(rows, n):
    by = defaultdict(set)
    for g, s, h, t in rows:
        if g is not None and s is not None and s == s:
            by[g].add((s + 0.0, h, t))
    out = {}
    for g, items in by.items():
        order = sorted(items, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2] is None, x[2] or ""))
        out[g] = order[:n]
    return out


@pytest.mark.parametrize("bytes_", [TI.ROW_GROUP_BYTES, 1])
def test_top_like_sorting(spark, monkeypatch, bytes_):
    monkeypatch.setattr(TI, "ROW_GROUP_BYTES", bytes_)
    random.seed(3)
    rows = [(f"g{random.randrange(200)}", float(random.randrange(6)), random.choice([None, 0, 1, 2]), f"n{i % 997:04}") for i in range(3000)]
    rows += [("hot", float(random.randrange(500)), random.choice([None, 0, 1]), f"n{i:06}") for i in range(12000)]
    rows += [(None, 1.0, 1, "x"), ("g0", None, 1, "x"), ("g0", float("nan"), 1, "x"), ("g1", -0.0, None, None), ("", 2.0, 1, "ä")] + rows[:20]
    df = spark.createDataFrame(rows, "g string, s double, h int, t string").withColumn("_s", F.lit(1)).withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in TI.top_n(df, "g", "s", ["h", "t"], 5).orderBy("g", "rank").collect():
        got[r["g"]].append((r["s"], r["h"], r["t"]))
    assert dict(got) == want_top(rows, 5)


def test_skipping_reads_fewer_row_groups(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 5000
    t = pa.table({"_g": ["hot"] * n, "_s": [float(n - i) for i in range(n)], "_t0": [f"x{i}" for i in range(n)]})
    path = tmp_path / "f.parquet"
    pq.write_table(t, path, row_group_size=100)
    foot = pd.concat(TI._footers([pd.DataFrame({"uri": [f"file://{path}"]})], "_g", "_s"))
    assert len(foot) == 50 and set(foot["one"]) == {"hot"}
    read = []
    real = pq.ParquetFile.read_row_group
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda self, i, **k: read.append(i) or real(self, i, **k))
    best = TI._scan(foot[["uri", "rg", "one", "top"]], ["_g", "_s", "_t0"], 5)
    assert read == [0] and list(best["_s"]) == [5000.0, 4999.0, 4998.0, 4997.0, 4996.0]


def test_row_group_of_several_full_groups_is_skipped(tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = [("a", 10.0 - i, i) for i in range(8)] + [("b", 10.0 - i, i) for i in range(8)]
    order = [*rows[:4], *rows[8:12], *rows[4:8], *rows[12:]]  # the last row group holds the rest of both
    path = str(tmp_path / "x.parquet")
    with pq.ParquetWriter(path, pa.schema([("_g", pa.string()), ("_s", pa.float64()), ("_t0", pa.int64())])) as w:
        for part in (order[:4], order[4:8], order[8:]):
            w.write_table(pa.table({"_g": [r[0] for r in part], "_s": [r[1] for r in part], "_t0": [r[2] for r in part]}))
    read = []
    real = pq.ParquetFile.read_row_group
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda self, i, columns=None: read.append((i, tuple(columns))) or real(self, i, columns=columns))
    foot = pd.DataFrame({"uri": f"file://{path}", "rg": [0, 1, 2], "one": ["a", "b", None], "top": [10.0, 10.0, 6.0]})
    best = TI._scan(foot, ["_g", "_s", "_t0"], 3)
    assert read[-1] == (2, ("_g",)) and len(read) == 3
    assert best.groupby("_g")["_t0"].apply(list).to_dict() == {"a": [0, 1, 2], "b": [0, 1, 2]}
    # five of each: the third row group is needed
    assert TI._scan(foot, ["_g", "_s", "_t0"], 5).groupby("_g")["_t0"].apply(list).to_dict() == {g: [0, 1, 2, 3, 4] for g in "ab"}


def test_top_of_nothing(spark):
    df = spark.createDataFrame([], "g string, s double, t string")
    assert TI.top_n(df, "g", "s", ["t"], 5).count() == 0


def test_latest(spark):
    df = spark.createDataFrame([("k", 1, 5, 1.0), ("k", 1, 6, 2.0), ("k", None, 9, 3.0), ("k", 1, 6, 2.0)], "k string, at int, id int, v double")
    assert [tuple(r) for r in TI.latest(df, ["k"], ["at", "id"], ["v"]).collect()] == [("k", 2.0)]


# ---- packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_best_two_fit_is_a_packing(sizes):
    where = P.best_two_fit(np.array(sizes, np.int64), 40)
    fill = Counter()
    for s, c in zip(sizes, where):
        fill[c] += s
    assert (where >= 0).all() and all(v <= 40 for v in fill.values())
    # no two containers could be one: every container is more than half full but one
    assert sum(2 * v <= 40 for v in fill.values()) <= 1


def test_pair_replaces_smallest():
    # greedy: 6 + 3 leaves 1; the 3 makes room for 2 + 2
    where = P.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert where[0] == where[2] == where[3] != where[1]


def test_pack(spark):
    random.seed(4)
    rows = [(i, random.choice([random.randrange(1, 512), random.randrange(1, 60), random.randrange(500, 3000)])) for i in range(3000)]
    rows += [(9001, 512), (9002, 1024), (9003, 0), (9004, None), (9005, -3), (None, 5)]
    df = spark.createDataFrame(rows, "d bigint, n bigint").withColumn("_s", F.lit(1)).withColumn("piece", F.lit(1))
    got = P.pack(df, "d", "n", 512, shard_items=400).collect()
    size = {d: n for d, n in rows if d is not None and (n or 0) > 0}
    parts, fill, stated = defaultdict(list), Counter(), {}
    for r in got:
        parts[r["d"]].append((r["start"], r["size"]))
        fill[r["container"]] += r["size"]
        stated[r["container"]] = r["fill"]
    assert set(parts) == set(size)
    for d, p in parts.items():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        assert at == size[d] and len(p) == -(-size[d] // 512)
    assert dict(fill) == stated and max(fill.values()) <= 512
    assert sum(fill.values()) / (512 * len(fill)) > 0.98
    assert P.pack(df.limit(0), "d", "n", 512).count() == 0


# ---- mixing


def test_tempering():
    q = [0.7, 0.2, 0.1, 0.0]
    assert M.tempered(q, 1) == pytest.approx(q)
    assert M.tempered(q, 0) == pytest.approx([1 / 3, 1 / 3, 1 / 3, 0])
    a = M.exponent_for_entropy(q[:3], 1.0)
    assert M.entropy(M.tempered(q[:3], a)) == pytest.approx(1.0)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 5), st.integers(0, 10_000)), min_size=1, max_size=8))
def test_plan_never_exceeds_limits(raw):
    whole = sum(w for w, _, _ in raw) or 1
    sources = [(f"s{i}", w / whole, m, t) for i, (w, m, t) in enumerate(raw)]
    total = sum(t for *_, t in sources)
    got = M.plan(sources, total)
    for b, (_, w, m, t) in zip(got, sources):
        assert -1e-6 <= b.budget <= m * t + 1e-3
        assert b.limited == (m * t < w * total)
    assert sum(b.budget for b in got) <= total + 1e-3


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 500)
    random.seed(6)
    rows = [(i, random.choice(["a", "a", "a", "b", "c", None, "other"]), random.choice([0, None, 5, 20, 60])) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc bigint, source string, n bigint").withColumn("_n", F.lit("x")).withColumn("weight", F.lit(1))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 1), ("gone", 0.1, 5)], "source string, weight double, max_repeats int")
    mixture, report = M.mix(df, "doc", "source", "n", targets)
    got, rep = mixture.collect(), {r["source"]: r for r in report.collect()}
    assert len({r["doc"] for r in got}) == len(got)
    tokens = Counter()
    most = {"a": 1, "b": 2, "c": 1}
    of = {i: (s, n) for i, s, n in rows}
    for r in got:
        assert of[r["doc"]] == (r["source"], r["tokens"]) and 1 <= r["repeats"] <= most[r["source"]]
        tokens[r["source"]] += r["repeats"] * r["tokens"]
    assert set(rep) == {"a", "b", "c", "gone"} and rep["gone"]["limited"] and rep["gone"]["used"] == 0
    for s, r in rep.items():
        assert r["used"] == tokens[s] and r["budget"] - 60 <= r["used"] <= r["budget"] + 1e-6
    assert sum(r["share"] for r in rep.values()) == pytest.approx(1)
    assert {(r["doc"], r["repeats"]) for r in M.mix(df.repartition(7), "doc", "source", "n", targets)[0].collect()} == {(r["doc"], r["repeats"]) for r in got}
    empty = M.mix(df.limit(0), "doc", "source", "n", targets)
    assert empty[0].count() == 0 and empty[1].count() == 4


def test_source_shares_are_tempered():
    sources = [("big", 0.1, 1, 9000), ("mid", 0.1, 3, 900), ("small", 0.8, 4, 100), ("none", 0.0, 5, 0)]
    even = dict(M.tempered_weights(sources, 10_000))
    # the smallest source is repeated as often as it may, and would be more often at a lower exponent
    assert even["small"] * 10_000 == pytest.approx(400, rel=1e-6) and even["none"] == 0 and sum(even.values()) == pytest.approx(1)
    assert even["mid"] * 10_000 <= 2700 and even["big"] * 10_000 <= 9000
    for aim in (0.3, 0.7, 1.0):
        assert M.entropy([w for _, w in M.tempered_weights(sources, 10_000, aim)]) == pytest.approx(aim, abs=1e-6)
    assert M.tempered_weights([("a", 1.0, 1, 0)], 0) == [("a", 0.0)]


def test_mixture_of_tempered_shares(spark):
    docs = [(i, "big" if i % 10 else "small", 10) for i in range(2000)]
    df = spark.createDataFrame(docs, "d int, s string, n int")
    targets = spark.createDataFrame([("big", 0.5, 3), ("small", 0.5, 3), ("none", 0.0, 3)], "source string, weight double, max_repeats int")
    got = {r["source"]: r["used"] for r in M.mix(df, "d", "s", "n", targets, temper="limits")[1].collect()}
    assert got == {"big": 14_000, "small": 6_000, "none": 0}
