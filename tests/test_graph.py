"""Small graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from rankweave.operators import expand as X, lexical as L, rank as R
from rankweave.operators.corpus import indexed_nodes, resolved_edges, undirected, valid_instances

NODE = "instance_id string, node_idx bigint, id string, kind string, file string, sig string, test boolean, start int"


def adj(spark, pairs, instance="g"):
    rows = [(instance, a, b) for a, b in pairs] + [(instance, b, a) for a, b in pairs]
    return spark.createDataFrame(rows, "instance_id string, a int, b int").distinct()


def start(spark, nodes, instance="g"):
    return spark.createDataFrame([(instance, n, i + 1) for i, n in enumerate(nodes)], "instance_id string, idx int, seed_rank int")


def hops(df):
    return {r["idx"]: r["hop"] for r in df.collect()}


STAR = [(0, i) for i in range(1, 6)]


def test_path(spark):
    got = hops(X.bfs(start(spark, [0]), adj(spark, [(0, 1), (1, 2), (2, 3)]), ["instance_id"], 2))
    assert got == {0: 0, 1: 1, 2: 2}


@pytest.mark.parametrize(("cap", "check", "n"), [(0, "before", 1), (1, "before", 6), (None, "before", 6), (0, "after", 6)])
def test_cap(spark, cap, check, n):
    assert len(hops(X.bfs(start(spark, [0]), adj(spark, STAR), ["instance_id"], 3, cap=cap, cap_check=check))) == n


def test_reached_by_is_the_first_seed(spark):
    got = X.bfs(start(spark, [7, 8]), adj(spark, [(7, 1), (8, 1)]), ["instance_id"], 1)
    assert {r["idx"]: r["seed_rank"] for r in got.collect()}[1] == 1


def test_consensus_counts_seeds(spark):
    scores = spark.createDataFrame([("g", 7, 1.0, 1), ("g", 8, 0.5, 2)], "instance_id string, idx int, lex double, lex_rank int")
    got = X.seed_consensus(scores, adj(spark, [(7, 1), (8, 1)]), 2, 1)
    assert {r["idx"]: r["consensus"] for r in got.collect()}[1] == 2


def test_pagerank_loses_mass_at_isolated_seed(spark):
    none = adj(spark, [(5, 6)])
    got = X.pagerank(start(spark, [0]).select("instance_id", "idx"), none).collect()
    assert [(r["idx"], round(r["pr"], 9)) for r in got] == [(0, 0.15)]


def test_pagerank_against_loop(spark):
    pairs = [(0, 1), (1, 2), (2, 3), (3, 0), (1, 3)]
    near = {i: sorted({b for a, b in pairs if a == i} | {a for a, b in pairs if b == i}) for i in range(4)}
    p = restart = [0.5, 0.5, 0, 0]
    for _ in range(40):
        p = [0.15 * restart[i] + 0.85 * sum(p[j] / len(near[j]) for j in near[i]) for i in range(4)]
    got = X.pagerank(start(spark, [0, 1]).select("instance_id", "idx"), adj(spark, pairs)).collect()
    assert {r["idx"]: round(r["pr"], 9) for r in got} == {i: round(v, 9) for i, v in enumerate(p)}


def test_shortest_path_takes_least_index(spark):
    edges = adj(spark, [(0, 2), (0, 1), (1, 3), (2, 3)])
    reach = X.bfs(start(spark, [0]), edges, ["instance_id"], 3)
    end = spark.createDataFrame([("g", 3)], "instance_id string, idx int")
    got = X.shortest_paths(reach, edges, end, 3).orderBy("step").collect()
    assert [r["idx"] for r in got] == [3, 1, 0]


def test_nodes_and_edges(spark):
    nodes = spark.createDataFrame(
        [
            ("g", 0, "f.py::A", "class", "f.py", None, None, 1), ("g", 0, "f.py::A", "class", "f.py", None, None, 1), ("g", 1, "f.py::t", "function", "f.py", None, True, 1),
            ("g", 2, "f.py::b", "function", None, "def b(x)", False, None), ("g", 3, "f.py", "file", "f.py", None, False, 1), ("g", 4, "z", None, "f.py", None, False, 1),
            (None, 4, "z", "class", "f.py", None, False, 1), ("g", 5, None, "class", "f.py", None, False, 1),
        ],
        NODE,
    ).withColumn("src", F.lit("clash"))
    edges = spark.createDataFrame(
        [
            ("g", 0, '["f.py::A", "f.py::b", "calls"]'), ("g", 0, '["f.py::A", "f.py::b", "calls"]'), ("g", 1, '{"from": "f.py::b", "to": "f.py::A", "type": "inherits"}'),
            ("g", 2, '["f.py::A", "f.py::A", "calls"]'), ("g", 3, '["f.py::A", "f.py::t", "calls"]'), ("g", 4, '["f.py::A", "f.py::b", "contains"]'),
            ("g", 5, '["f.py::A", "f.py::b", "CALLS"]'), ("g", 6, '{"from": "f.py::A", "to": "f.py::b"}'), ("g", 7, "not json"), ("g", 8, None), ("g", 9, '["f.py::A", "f.py::b", "calls"]'),
        ],
        "instance_id string, edge_no bigint, edge string",
    )
    kept = indexed_nodes(nodes)
    assert [(r["idx"], r["id"]) for r in kept.orderBy("idx").collect()] == [(0, "f.py::A"), (1, "f.py::b")]
    assert indexed_nodes(nodes, keep_tests=True).count() == 3
    found = resolved_edges(edges, kept)
    assert sorted((r["edge_no"], r["src"], r["dst"]) for r in found.collect()) == [(0, 0, 1), (1, 1, 0), (9, 0, 1)]
    assert sorted(tuple(r)[1:] for r in undirected(found).collect()) == [(0, 1), (1, 0)]


def test_bm25_without_known_terms_orders_by_index(spark):
    docs = spark.createDataFrame([("g", 0, ["a"]), ("g", 1, []), ("g", 2, ["b", "b"])], "instance_id string, idx int, tokens array<string>")
    query = spark.createDataFrame([("g", "zzz")], "instance_id string, term string")
    got = L.ranked(L.bm25(docs, query, "instance_id", "idx", "tokens"), "instance_id", "idx").orderBy("lex_rank").collect()
    assert [(r["idx"], r["lex"]) for r in got] == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_empty_tables(spark):
    nodes = spark.createDataFrame([], NODE)
    kept = indexed_nodes(nodes)
    edges = resolved_edges(spark.createDataFrame([], "instance_id string, edge_no bigint, edge string"), kept)
    assert kept.count() == 0 and undirected(edges).count() == 0
    inst = spark.createDataFrame([("g", "text")], "instance_id string, issue string")
    scores = L.name_scores(kept, inst)
    assert scores.count() == 0
    assert X.bfs(X.seeds(scores, (10,)), undirected(edges), ["instance_id", "k"], 2).count() == 0


def test_valid_instances_take_latest(spark):
    schema = "instance_id string, repo string, base_commit string, problem_statement string, gold struct<entities:array<string>,files:array<string>,module_level:array<string>,added_files:array<string>>, created_at timestamp, ingested_at timestamp"
    import datetime as dt

    t = [dt.datetime(2024, 1, i + 1) for i in range(3)]
    df = spark.createDataFrame([("a", "r", "c", "old", None, t[0], t[0]), ("a", "r", "c", None, None, t[0], t[2]), ("a", "r", "c", "x", None, t[0], None), (None, "r", "c", "x", None, t[0], t[0])], schema)
    got = valid_instances(df).collect()
    assert [(r["instance_id"], r["issue"], r["entities"]) for r in got] == [("a", "", [])]


def test_lexical_first_keeps_published_order(spark):
    scores = spark.createDataFrame([("g", i, float(i), 4 - i) for i in range(4)], "instance_id string, idx int, lex double, lex_rank int")
    pool = scores.where("idx >= 2")
    got = R.lexical_first(scores, pool).orderBy("rank").collect()
    assert [r["idx"] for r in got] == [0, 1, 3, 2]
