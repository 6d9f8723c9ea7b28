"""Queries on uneven keys: totals, weighted means and exact quantiles of evaluation rows per repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankweave.functions.text import normal_name
from rankweave.operators.skew import exact_quantiles, key_profile
from rankweave.session import table

METRICS = ("lex20", "mix20", "hop20")
PROBS = (0.5, 0.9)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cross_repo").distinct().withColumn("repo", normal_name(F.col("repo")))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_profile(_rows(spark, sf_dir), "repo", "n", METRICS, PROBS)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir).where("repo IS NOT NULL AND share >= 0.05").select("repo")


def p1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _profile(spark, sf_dir).where("repo IS NOT NULL")
    return found.select(
        "repo", "rows", F.col("size").alias("n"), F.round("share", 9).alias("share"),
        *[F.round(m, 6).alias(m) for m in METRICS], F.col("q50").alias("n_median"), F.col("q90").alias("n_p90"),
    )


def p1_rate_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of lex20 per repository, each row counted n times."""
    found = exact_quantiles(_rows(spark, sf_dir).where("repo IS NOT NULL"), ["repo"], "lex20", (0.1, 0.5, 0.9), "n")
    return found.select("repo", "q", "value", F.col("rows").alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_totals, p1_rate_quantiles)}

NORMAL_NAME_SQL = """
  CASE WHEN regexp_full_match(NAMED, '[a-z0-9-]+/[a-z0-9-]+') THEN NAMED END"""


def normal_name_sql(column: str) -> str:
    """The normal name of a repository as a DuckDB expression."""
    s = rf"regexp_replace(lower({column}), '^\s+|\s+$', '', 'g')"
    s = rf"replace(regexp_replace(regexp_replace({s}, '/+$', ''), '\.git$', ''), '__', '/')"
    return NORMAL_NAME_SQL.replace("NAMED", s)


_R = f"""
r AS (SELECT {normal_name_sql("repo")} AS repo, coalesce(n, 0) AS n, lex20, mix20, hop20
      FROM (SELECT DISTINCT * FROM cross_repo))"""


def _mean(m: str) -> str:
    ok = f"{m} IS NOT NULL AND NOT isnan({m})"
    return f"round(sum(n * {m}) FILTER ({ok}) / nullif(sum(n) FILTER ({ok}), 0), 6) AS {m}"


ORACLES = {
    "p1_found": f"""
WITH {_R}
SELECT repo FROM r WHERE repo IS NOT NULL GROUP BY repo HAVING sum(n) >= 0.05 * (SELECT sum(n) FROM r)""",
    "p1_totals": f"""
WITH {_R}
SELECT repo, count(*) AS rows, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / (SELECT sum(n) FROM r), 9) AS share,
  {", ".join(_mean(m) for m in METRICS)}, quantile_disc(n, 0.5) AS n_median, quantile_disc(n, 0.9) AS n_p90
FROM r WHERE repo IS NOT NULL GROUP BY repo""",
    "p1_rate_quantiles": f"""
WITH {_R},
c AS (SELECT repo, lex20 AS v, sum(n) AS w FROM r
      WHERE repo IS NOT NULL AND n > 0 AND lex20 IS NOT NULL AND NOT isnan(lex20) GROUP BY ALL),
u AS (SELECT *, sum(w) OVER (PARTITION BY repo ORDER BY v) AS upto, sum(w) OVER (PARTITION BY repo) AS total FROM c),
q AS (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS q)
SELECT repo, q, min(v) AS value, CAST(any_value(total) AS BIGINT) AS n
FROM u, q WHERE upto >= greatest(1, total - floor(total - q * total)) GROUP BY repo, q""",
}
