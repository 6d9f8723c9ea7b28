"""Round trips through the file formats."""

import json

import numpy as np

from rankweave.operators.rank import loaded, localize_with_tests, localize
from rankweave.operators.corpus import corpus
from rankweave.sources import graphs as G, sinks


def test_graph_files(spark, tmp_path):
    (tmp_path / "a__b-1.json").write_text(
        json.dumps(
            {
                "meta": {"repo": "a/b"},
                "nodes": [{"id": "f::x", "kind": "function", "sig": "def x()"}, {"id": "f::y", "kind": "class", "file": "f"}, {"id": "f::t", "kind": "function", "test": True}],
                "links": [["f::x", "f::y", "calls"], {"from": "f::y", "to": "f::x", "type": "imports"}, {"from": "f::t", "to": "f::x", "type": "calls"}],
            },
            indent=1,
        )
    )
    (tmp_path / "c__d-2.json").write_text(json.dumps({"meta": {"instance_id": "named"}, "nodes": [{"id": "q", "kind": "class"}]}))
    (tmp_path / "e__f-3.json").write_text("{broken")
    nodes, edges, adj = loaded(*G.read_graphs(spark, str(tmp_path)))
    assert sorted((r["instance_id"], r["id"], r["idx"]) for r in nodes.collect()) == [("a__b-1", "f::x", 0), ("a__b-1", "f::y", 1), ("named", "q", 0)]
    assert sorted((r["src"], r["dst"], r["type"]) for r in edges.collect()) == [(0, 1, "calls"), (1, 0, "imports")]
    assert adj.count() == 2


def test_instances_last_line_counts(spark, tmp_path):
    lines = [{"instance_id": "a", "problem_statement": "old"}, {"instance_id": "a", "problem_statement": "new", "gold": {"entities": ["x"]}}, {"instance_id": "b"}]
    (tmp_path / "i.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{oops\n")
    got = {r["instance_id"]: r for r in G.read_instances(spark, str(tmp_path / "i.jsonl")).collect()}
    assert set(got) == {"a", "b"} and got["a"]["problem_statement"] == "new" and got["a"]["gold"]["entities"] == ["x"]


def test_runs(spark, tmp_path):
    (tmp_path / "r.csv").write_text("arm,edits_gold_function,resolved,skill_top15_has_gold,skill_top5_has_gold,location,failure,tool_calls,minutes,ran_tests\nbase,1,1,nan,,x,y,3, 2.5 ,None\nskill,0,0,1,1,x,y,oops,1,1\n")
    rows = G.read_runs(spark, str(tmp_path / "r.csv")).orderBy("arm").collect()
    assert (rows[0]["edits_gold_function"], rows[0]["resolved"], rows[0]["skill_top15_has_gold"], rows[0]["minutes"], rows[0]["ran_tests"]) == (1.0, True, None, 2.5, None)
    assert rows[1]["tool_calls"] is None


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "v.npz", a=np.array([1.0, 2.0]), b=np.array([3.0]))
    got = {r["key"]: r["embedding"] for r in G.read_npz(spark, [str(tmp_path / "v.npz")]).collect()}
    assert got == {"a": [1.0, 2.0], "b": [3.0]}


def test_discovery(tmp_path, monkeypatch):
    deep = tmp_path / "x" / "graphs"
    deep.mkdir(parents=True)
    for i in range(5):
        (deep / f"a__b-{i}.json").write_text("{}")
    assert G.find_graphs([str(tmp_path)]) == str(deep)
    assert G.find_graphs([str(tmp_path / "none")]) is None
    monkeypatch.setenv("GRAPHS_DIR", str(deep))
    assert G.find_graphs([]) == str(deep)
    (tmp_path / "x" / "o_r.json").write_text("{}")
    assert G.find_repo_graph("o/r", [str(tmp_path / "x")]) == str(tmp_path / "x" / "o_r.json")
    (tmp_path / "x" / "my_graph.json").write_text("{}")
    assert G.find_repo_graph("q/z", [str(tmp_path / "x")]) == str(tmp_path / "x" / "my_graph.json")
    assert G.options({"k": 1}, '{"k": 2, "z": 3}') == {"k": 2} and G.options({"k": 1}, "[") == {"k": 1}


def test_predictions_and_lines(spark, data, tmp_path):
    c = corpus(spark, data)
    got = sinks.predictions(localize(c), 3)
    sinks.write_json(got, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out")).collect()
    assert len(back) == got.count() and all(len(r["ranked"]) <= 3 for r in back)
    assert [x["rank"] for x in back[0]["ranked"]] == sorted(x["rank"] for x in back[0]["ranked"])
    line = sinks.report_lines(localize_with_tests(c)).where("rank = 1").first()["line"]
    assert line.startswith("1 ") and ":" in line


def test_result_document_and_report(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 0.5), ("b", None, 0.25)], "instance_id string, n int, cov double")
    path = f"file://{tmp_path}/result.json"
    sinks.write_result({"n": 2, "mean": 0.375}, rows, path)
    assert json.loads((tmp_path / "result.json").read_text())["rows"][1] == {"instance_id": "b", "n": None, "cov": 0.25}
    summary, back = sinks.read_result(spark, path)
    assert summary.collect()[0].asDict() == {"n": 2, "mean": 0.375}
    assert sorted((r["instance_id"], r["n"], r["cov"]) for r in back.collect()) == [("a", 1, 0.5), ("b", None, 0.25)]
    lines = [r["line"] for r in sinks.report_table(rows, {"instance_id": 4, "n": 3, "cov": 8}, "instance_id").collect()]
    assert lines == ["a     1   0.500", "b     -   0.250"]
