import duckdb
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from rankweave.functions import text as T
from rankweave.plans import sql_text as Q


def in_sql(texts, expression):
    """What DuckDB, whose regular expressions have no lookahead, makes of the texts."""
    con = duckdb.connect()
    con.register("t", pd.DataFrame({"i": range(len(texts)), "text": pd.Series(texts, dtype="object")}))
    return [list(x) for (x,) in con.sql(f"SELECT {expression} FROM t ORDER BY i").fetchall()]


def run(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", make(F.col("t")).alias("x"))
    return [r["x"] for r in rows.orderBy("i").collect()]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("HTTPServerError", ["httpservererror", "http", "server"]),
        ("_cstack", ["_cstack"]),
        ("__init__", ["__init__"]),
        ("get_x", ["get_x"]),
        ("A1b", ["a1b"]),
        ("the error in new_code", ["new_code"]),
        (None, []),
        ("", []),
    ],
)
def test_ident_tokens(spark, text, want):
    assert run(spark, [text], T.ident_tokens) == [want]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abAB_19. éthe", max_size=40), min_size=1, max_size=20))
def test_tokens_in_both_engines(spark, texts):
    assert run(spark, texts, T.ident_tokens) == in_sql(texts, Q.ident_tokens_sql("text"))
    assert run(spark, texts, T.words) == in_sql(texts, Q.words_sql("text"))


def test_words_emit_plain_words_twice(spark):
    assert run(spark, ["parseHTML of x1", None], T.words) == [["parsehtml", "parse", "html"], []]
    assert run(spark, ["parse"], T.words) == [["parse", "parse"]]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        (" Owner__Name.git ", "owner/name"), ("a/b/", "a/b"), ("a/b.git/", "a/b"), ("A/B\n", "a/b"), ("a/b/c", None), ("a b/c", None),
        ("unknown", None), ("?", None), ("", None), (None, None), ("a.b/c", None), ("a-1/b-2", "a-1/b-2"),
    ],
)
def test_normal_name(spark, name, want):
    assert run(spark, [name], T.normal_name) == [want]


def test_project_of_instance(spark):
    assert run(spark, [" A__b-12 ", "a__b", "a__b-c-7", None, "x-1"], T.project_of_instance) == ["a/b", None, "a/b-c", None, None]


def test_word_punct_count(spark):
    assert run(spark, ["a_b, c--d e", "", None, "… …", "äöü 12"], T.word_punct_count) == [6, 0, 0, 2, 2]


def test_paths(spark):
    assert run(spark, ["a/b.py::C.d", "x"], T.qualified_name) == ["C.d", "x"]
    assert run(spark, ["a/b.py::C::d", "x"], T.file_of) == ["a/b.py", "x"]


def test_stop_lists(spark):
    assert len(T.STOP_CORE) == 102 and set(T.STOP_CORE) == set(Q.STOP.split())
    assert len(T.STOP_SHORT) == 98 and set(T.STOP_SHORT) == set(Q.STOP_TOOL.split())
    assert run(spark, ["get_issues openIssues issue he"], T.ident_tokens) == [["get_issues", "get", "issues", "openissues", "open", "issues"]]
    assert "issues" in run(spark, ["issues"], T.ident_tokens)[0]
