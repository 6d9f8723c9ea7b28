"""Readers of graph, instance, run and vector files, and path discovery on the driver."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

NODE = "struct<id:string,kind:string,file:string,sig:string,test:boolean,start:int>"
GRAPH = f"meta struct<instance_id:string,repo:string,base_commit:string>, nodes array<{NODE}>, edges array<string>, links array<string>, _corrupt string"
INSTANCE = (
    "instance_id string, repo string, base_commit string, problem_statement string, "
    "gold struct<entities:array<string>,files:array<string>,module_level:array<string>,added_files:array<string>>, _corrupt string"
)
RUN_NUMBERS = ("edits_gold_function", "skill_top5_has_gold", "skill_top15_has_gold", "tool_calls", "minutes", "ran_tests")


def read_graphs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Raw node and edge tables of a folder of graph files, one JSON object each.

    Columns as in ``graph_nodes`` and ``graph_edges``. The instance is named by ``meta`` or else by
    the file. ``edges`` may be called ``links``; an edge keeps its raw JSON. A malformed file is
    skipped, a missing list is empty.
    """
    raw = spark.read.schema(GRAPH).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    ok = raw.select(
        F.coalesce("meta.instance_id", name).alias("instance_id"), "nodes", F.coalesce("edges", "links").alias("edges"), "_corrupt"
    ).where(F.col("_corrupt").isNull() & F.col("nodes").isNotNull())
    nodes = ok.select("instance_id", F.posexplode("nodes").alias("node_idx", "n")).select(
        "instance_id", F.col("node_idx").cast("bigint").alias("node_idx"), "n.id", "n.kind", "n.file", "n.sig", "n.test", "n.start"
    )
    edges = ok.select("instance_id", F.posexplode("edges").alias("edge_no", "edge"))
    return nodes, edges.withColumn("edge_no", F.col("edge_no").cast("bigint"))


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """Instances of JSON-lines files; malformed lines are skipped, of equal ids the last line counts."""
    raw = spark.read.schema(INSTANCE).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = raw.where(F.col("_corrupt").isNull() & F.col("instance_id").isNotNull()).drop("_corrupt")
    last = F.max_by(F.struct(*[c for c in rows.columns if c != "instance_id"]), F.struct("_f", "_p"))
    at = rows.withColumn("_f", F.col("_metadata.file_path")).withColumn("_p", F.monotonically_increasing_id())
    return at.groupBy("instance_id").agg(last.alias("r")).select("instance_id", "r.repo", "r.base_commit", "r.problem_statement", "r.gold")


def number(c):
    """A number from text: empty, ``nan`` and ``None`` are null, and so is what isn't a number."""
    s = F.trim(c)
    return F.when(~s.isin("", "nan", "None"), s.try_cast("double"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Agent runs of CSV files with a header, numbers parsed; ``resolved`` is compared as text."""
    raw = spark.read.option("header", True).csv(path)
    parsed = [number(F.col(c)).alias(c) if c in RUN_NUMBERS else F.col(c) for c in raw.columns if c != "resolved"]
    return raw.select(*parsed, F.coalesce(F.col("resolved") == "1", F.lit(False)).alias("resolved"))


def read_npz(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``path, key, embedding`` of NumPy archives: each key holds one vector. Read by the executors."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        from pyarrow import fs as pafs

        for batch in batches:
            for p in batch["path"]:
                system, inner = pafs.FileSystem.from_uri(p if "://" in p else f"file://{os.path.abspath(p)}")
                with system.open_input_file(inner) as f, np.load(f, allow_pickle=False) as z:
                    yield pd.DataFrame([(p, k, np.asarray(z[k], np.float32).tolist()) for k in z.files], columns=["path", "key", "embedding"])

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInPandas(load, "path string, key string, embedding array<float>")


# ---- discovery; a few directory listings on the driver

_GRAPH_NAME = re.compile(r".+__.+-\d+\.json$")


def looks_like_graphs(folder: str, least: int = 5) -> bool:
    """Whether a folder holds at least ``least`` files named like graphs."""
    try:
        return sum(bool(_GRAPH_NAME.match(f)) for f in os.listdir(folder)) >= least
    except OSError:
        return False


def find_graphs(candidates: Sequence[str], env: str = "GRAPHS_DIR", least: int = 5) -> str | None:
    """The folder the environment names, else the first candidate or folder below one that fits."""
    for folder in ([os.environ[env]] if os.environ.get(env) else []) + list(candidates):
        if looks_like_graphs(folder, least):
            return folder
    for top in candidates:
        for root, dirs, _ in os.walk(top):
            dirs.sort()
            if looks_like_graphs(root, least):
                return root
    return None


def find_repo_graph(repo: str, folders: Sequence[str]) -> str | None:
    """Graph file of one repository: by three names in each folder, else any ``*graph*.json`` below."""
    flat = repo.replace("/", "_")
    for folder in folders:
        for name in (f"{repo}.json", os.path.join(folder, "graphs", f"{repo}.json"), os.path.join(folder, f"{flat}.json")):
            if os.path.exists(name):
                return name
    for folder in folders:
        for root, dirs, names in os.walk(folder):
            dirs.sort()
            for name in sorted(names):
                if name.endswith(".json") and "graph" in name.lower():
                    return os.path.join(root, name)
    return None


def options(defaults: dict, overrides: str) -> dict:
    """Options with a JSON object laid over them; text that is no object changes nothing."""
    try:
        given = json.loads(overrides or "{}")
    except ValueError:
        given = {}
    return defaults | {k: v for k, v in given.items() if k in defaults} if isinstance(given, dict) else dict(defaults)
