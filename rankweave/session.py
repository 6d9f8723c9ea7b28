"""Where a query keeps its intermediate tables, and how it cuts lineage.

Long plans (loops, reused results) are cut by writing a Parquet table into the folder that
``spark.checkpoint.dir`` names. All executors share that folder, so a lost executor costs no
results. Only where the setting is absent (tests, local runs) a folder of our own is used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as a URI or path."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="rankweave-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + _OWN["dir"]


def _path(spark: SparkSession, uri: str):
    return spark._jvm.org.apache.hadoop.fs.Path(uri)


def _fs(spark: SparkSession, uri: str):
    return _path(spark, uri).getFileSystem(spark._jsc.hadoopConfiguration())


class Workspace:
    """A folder of intermediate tables for one query.

    >>> ws = Workspace(spark, "cc"); df = ws.keep(df); ws.drop("name")

    ``keep`` writes a table and returns a DataFrame that reads it, so the lineage ends there;
    the tables live until the session ends or ``drop`` is called.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/rankweave-{label}-{uuid.uuid4().hex[:12]}"
        self._at_exit(self.root)

    def _at_exit(self, uri: str) -> None:
        _fs(self.spark, uri).deleteOnExit(_path(self.spark, uri))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write ``df`` as table ``name`` and return it read back."""
        df.write.mode("overwrite").options(**options).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        _fs(self.spark, self.path(name)).delete(_path(self.spark, self.path(name)), True)

    def files(self, name: str) -> list[tuple[str, int]]:
        """URI and length of each data file of a kept table."""
        status = _fs(self.spark, self.path(name)).listStatus(_path(self.spark, self.path(name)))
        found = [(s.getPath().toString(), s.getLen()) for s in status]
        return sorted(f for f in found if f[0].endswith(".parquet"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(kept: DataFrame, *keys: str) -> DataFrame:
    """A kept table in at least as many partitions as there are cores.

    For work that costs much time per byte, such as splitting texts into tokens: a table of a few
    megabytes is one partition otherwise. A table with enough partitions stays as it is.
    """
    cores = kept.sparkSession.sparkContext.defaultParallelism
    return kept if kept.rdd.getNumPartitions() >= cores else kept.repartition(cores, *keys)
