"""Queries that evaluate rankings: coverage, accuracy, features, statistics, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankweave.functions import stats as S, text as T
from rankweave.operators import evaluate as E, features as X, measures as M, rank as R
from rankweave.operators.corpus import Corpus
from rankweave.operators.expand import CAPS
from rankweave.plans import sql_text as Q
from rankweave.plans.prefix import QN
from rankweave.plans.registry import query
from rankweave.plans.retrieval import ARITY_SQL, COMMAS_SQL, GRAPH_SUMMARY_SQL, LEXICAL_FIRST_SQL


def _grid(values, name: str) -> str:
    return f"(SELECT unnest([{', '.join(map(str, values))}])::INTEGER AS {name})"


def _ranked_sql(order: str, source: str, keys: str = "instance_id") -> str:
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS INTEGER) AS rank FROM {source}"


def _best_sql(ranked: str, keys: str = "instance_id") -> str:
    return f"SELECT {keys}, min(rank) AS best FROM {ranked} SEMI JOIN targets USING (instance_id, idx) GROUP BY {keys}"


HOP = "hop, lex DESC, idx"

# ---- coverage against budget

_COVERAGE = {
    "cov_h": _grid(range(5), "h"),
    "cov_ranked": _ranked_sql(HOP, "(SELECT r.instance_id, h.h, r.idx, r.hop, s.lex FROM reach r JOIN scores s USING (instance_id, idx), cov_h h WHERE r.k = 10 AND r.hop <= h.h)", "instance_id, h"),
    "cov_best": _best_sql("cov_ranked", "instance_id, h"),
    "cov_hit": f"""SELECT u.instance_id, u.repo, h.h, b.b AS budget, coalesce((x.best <= b.b)::INTEGER, 0) AS hit
  FROM usable u CROSS JOIN cov_h h CROSS JOIN {_grid(Q.COVERAGE_BUDGETS, "b")} b LEFT JOIN cov_best x ON x.instance_id = u.instance_id AND x.h = h.h""",
}


def by_depth(c: Corpus) -> DataFrame:
    """One ranking per depth 0 to 4; one search serves them all, for layers don't change with depth."""
    reached = c.reached(10, 4).join(c.scores, ["instance_id", "idx"])
    deep = reached.withColumn("h", F.explode(F.sequence("hop", F.lit(4))))
    return R.rank_by(deep, "hop", ["instance_id", "h"])


def depth_hits(c: Corpus) -> DataFrame:
    return E.hits(E.best_rank(by_depth(c), c.targets, ["h"]), c.usable, E.COVERAGE_BUDGETS, ["h"])


@query("ag1_coverage_curve", "SELECT h, budget, round(avg(hit), 6) AS coverage FROM cov_hit GROUP BY ALL", _COVERAGE)
def _(c: Corpus) -> DataFrame:
    return E.coverage(depth_hits(c), ["h", "budget"])


@query("ag1_lexical_coverage", f"""
SELECT b.b AS budget, round(avg(coalesce((x.best <= b.b)::INTEGER, 0)), 6) AS coverage FROM usable u CROSS JOIN {_grid(Q.COVERAGE_BUDGETS, "b")} b
LEFT JOIN (SELECT instance_id, min(lex_rank) AS best FROM scores SEMI JOIN targets USING (instance_id, idx) GROUP BY ALL) x USING (instance_id) GROUP BY ALL""")  # fmt: skip
def _(c: Corpus) -> DataFrame:
    best = E.best_rank(c.scores.withColumnRenamed("lex_rank", "rank"), c.targets)
    return E.coverage(E.hits(best, c.usable, E.COVERAGE_BUDGETS), ["budget"])


@query("ag26_median_pool", """
SELECT h, median(n) AS median_pool, median(r) AS median_radius FROM (
  SELECT c.h, c.instance_id, count(*) AS n, max(hop) AS r FROM cov_ranked c SEMI JOIN usable USING (instance_id) GROUP BY ALL) GROUP BY h""", _COVERAGE)  # fmt: skip
def _(c: Corpus) -> DataFrame:
    return pool_sizes(c)


def pool_sizes(c: Corpus) -> DataFrame:
    """``h, median_pool, median_radius`` of the usable instances."""
    per = by_depth(c).join(c.usable, "instance_id", "left_semi").groupBy("h", "instance_id").agg(F.count(F.lit(1)).alias("n"), F.max("hop").alias("r"))
    return per.groupBy("h").agg(F.median("n").alias("median_pool"), F.median("r").alias("median_radius"))


_AG28 = {
    "c28": "SELECT h, round(avg(hit), 6) AS cov200 FROM cov_hit WHERE budget = 200 GROUP BY h",
    "p28": """SELECT h, median(n) AS median_pool, median(r) AS median_radius FROM (
  SELECT c.h, c.instance_id, count(*) AS n, max(hop) AS r FROM cov_ranked c SEMI JOIN usable USING (instance_id) GROUP BY ALL) GROUP BY h""",
    "d50": "SELECT h, instance_id, hit FROM cov_hit WHERE budget = 50",
    "d28": """SELECT x.h, count(*) AS n, CAST(sum(x.hit) AS BIGINT) AS k, CAST(sum((x.hit > z.hit)::INTEGER) AS BIGINT) AS gained,
  CAST(sum((x.hit < z.hit)::INTEGER) AS BIGINT) AS lost FROM d50 x JOIN d50 z ON z.instance_id = x.instance_id AND z.h = 0 GROUP BY x.h""",
}
_W = S.wilson_sql("k", "n")


@query("ag28_depth_table", f"""
SELECT h, n, k, round({_W[0]}, 6) AS p, round({_W[1]}, 6) AS lo, round({_W[2]}, 6) AS hi, gained, lost,
  round({S.mcnemar_sql("gained", "lost")}, 9) AS pvalue, cov200, median_pool, median_radius FROM d28 JOIN c28 USING (h) JOIN p28 USING (h)""", _COVERAGE | _AG28)  # fmt: skip
def _(c: Corpus) -> DataFrame:
    x = depth_hits(c).where("budget = 50").select("h", "instance_id", "hit")
    z = x.where("h = 0").select("instance_id", F.col("hit").alias("hit0"))
    per = x.join(z, "instance_id").groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hit").cast("bigint").alias("k"), F.count_if(F.col("hit") > F.col("hit0")).alias("gained"),
        F.count_if(F.col("hit") < F.col("hit0")).alias("lost"),
    )
    p, lo, hi = S.wilson(F.col("k"), F.col("n"))
    wide = depth_hits(c).where("budget = 200").groupBy("h").agg(F.round(F.avg("hit"), 6).alias("cov200"))
    per = per.join(wide, "h").join(pool_sizes(c), "h")
    return per.select("h", "n", "k", "cov200", "median_pool", "median_radius", F.round(p, 6).alias("p"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"), "gained", "lost",
                      F.round(S.mcnemar_p(F.col("gained"), F.col("lost")), 9).alias("pvalue"))


# ---- accuracy grid, seed sizes, caps

_GRID = {
    "acc_ranked": _ranked_sql(HOP, "(SELECT r.instance_id, r.k, h.h, r.idx, r.hop, s.lex FROM reach r JOIN scores s USING (instance_id, idx), (SELECT unnest([1, 2, 3])::INTEGER AS h) h WHERE r.k IN (5, 10, 20) AND r.hop <= h.h)", "instance_id, k, h"),
    "acc_best": _best_sql("(SELECT * FROM acc_ranked WHERE rank <= 100)", "instance_id, k, h"),
    "lex_best": "SELECT instance_id, min(lex_rank) AS best FROM scores SEMI JOIN targets USING (instance_id, idx) GROUP BY ALL",
}


@query("ag2_accuracy_grid", f"""
SELECT g.k AS seed_k, h.h AS hops, b.b AS at, round(avg(coalesce((x.best <= b.b)::INTEGER, 0)), 6) AS acc,
  round(avg(coalesce((l.best <= b.b)::INTEGER, 0)), 6) AS lexical
FROM usable u CROSS JOIN (SELECT unnest([5, 10, 20])::INTEGER AS k) g CROSS JOIN (SELECT unnest([1, 2, 3])::INTEGER AS h) h CROSS JOIN {_grid(Q.ACC_KS, "b")} b
LEFT JOIN acc_best x ON x.instance_id = u.instance_id AND x.k = g.k AND x.h = h.h LEFT JOIN lex_best l ON l.instance_id = u.instance_id GROUP BY ALL""", _GRID)  # fmt: skip
def _(c: Corpus) -> DataFrame:
    reached = c.reach.where(F.col("k").isin(5, 10, 20) & (F.col("hop") <= 3)).join(c.scores, ["instance_id", "idx"])
    deep = reached.withColumn("h", F.explode(F.sequence(F.greatest("hop", F.lit(1)), F.lit(3))))
    ranked = R.rank_by(deep, "hop", ["instance_id", "k", "h"]).where("rank <= 100")
    ours = E.hits(E.best_rank(ranked, c.targets, ["k", "h"]), c.usable, E.ACC_KS, ["k", "h"])
    lexical = E.best_rank(c.scores.withColumnRenamed("lex_rank", "rank"), c.targets)
    base = E.coverage(E.hits(lexical, c.usable, E.ACC_KS), ["budget"]).withColumnRenamed("coverage", "lexical")
    got = ours.groupBy("k", "h", "budget").agg(F.round(F.avg("hit"), 6).alias("acc")).join(base, "budget")
    return got.select(F.col("k").alias("seed_k"), F.col("h").alias("hops"), F.col("budget").alias("at"), "acc", "lexical")


_SEED = {
    "sw_ranked": _ranked_sql(HOP, "(SELECT r.instance_id, r.k, r.idx, r.hop, s.lex FROM reach r JOIN scores s USING (instance_id, idx) WHERE r.k <> 3 AND r.hop <= 3)", "instance_id, k"),
    "sw_best": _best_sql("sw_ranked", "instance_id, k"),
}


@query("ag3_seed_sweep", f"""
SELECT g.k, b.b AS budget, round(avg(coalesce((x.best <= b.b)::INTEGER, 0)), 6) AS coverage FROM usable u
CROSS JOIN (SELECT unnest([1, 5, 10, 20, 50, 100])::INTEGER AS k) g CROSS JOIN {_grid(Q.SWEEP_BUDGETS, "b")} b
LEFT JOIN sw_best x ON x.instance_id = u.instance_id AND x.k = g.k GROUP BY ALL""", _SEED)  # fmt: skip
def _(c: Corpus) -> DataFrame:
    reached = c.reach.where("k <> 3 AND hop <= 3").join(c.scores, ["instance_id", "idx"])
    best = E.best_rank(R.rank_by(reached, "hop", ["instance_id", "k"]), c.targets, ["k"])
    return E.coverage(E.hits(best, c.usable, E.SWEEP_BUDGETS, ["k"]), ["k", "budget"])


_ABLATION = {
    "lf": LEXICAL_FIRST_SQL,
    "lf_best": "SELECT 'lexical_first' AS ordering, " + _best_sql("lf")[7:] + " UNION ALL SELECT 'hop_first', " + _best_sql("hf")[7:] + " UNION ALL SELECT 'all_lexical', instance_id, best FROM lex_best",
    "hf": _ranked_sql(HOP, "pool"),
    "lex_best": _GRID["lex_best"],
}


@query("ag4_ordering_ablation", f"""
SELECT o.ordering, b.b AS budget, round(avg(coalesce((x.best <= b.b)::INTEGER, 0)), 6) AS coverage FROM usable u
CROSS JOIN (SELECT unnest(['lexical_first', 'hop_first', 'all_lexical']) AS ordering) o CROSS JOIN {_grid(Q.SWEEP_BUDGETS, "b")} b
LEFT JOIN lf_best x ON x.instance_id = u.instance_id AND x.ordering = o.ordering GROUP BY ALL""", _ABLATION)  # fmt: skip
def _(c: Corpus) -> DataFrame:
    """The ablation as published, the hop order, and what the ablation was meant to be: all nodes by score."""
    both = {
        "lexical_first": R.lexical_first(c.scores, c.pool()), "hop_first": R.rank_by(c.pool(), "hop").select("instance_id", "idx", "rank"),
        "all_lexical": c.scores.select("instance_id", "idx", F.col("lex_rank").alias("rank")),
    }
    best = None
    for name, ranked in both.items():
        part = E.best_rank(ranked, c.targets).withColumn("ordering", F.lit(name))
        best = part if best is None else best.unionByName(part)
    return E.coverage(E.hits(best, c.usable, E.SWEEP_BUDGETS, ["ordering"]), ["ordering", "budget"])


_CAP = {
    "cap_ranked": _ranked_sql(HOP, "(SELECT r.instance_id, r.cap, r.idx, r.hop, s.lex FROM capped r JOIN scores s USING (instance_id, idx))", "instance_id, cap"),
    "cap_best": _best_sql("cap_ranked", "instance_id, cap"),
    "cap_size": "SELECT cap, avg(n) AS pool, avg(r) AS maxhop FROM (SELECT instance_id, cap, count(*) AS n, max(hop) AS r FROM capped SEMI JOIN usable USING (instance_id) GROUP BY ALL) GROUP BY cap",
}


@query("ag5_cap_sweep", f"""
SELECT g.cap, b.b AS budget, round(avg(coalesce((x.best <= b.b)::INTEGER, 0)), 6) AS coverage, round(any_value(z.pool), 6) AS mean_pool,
  round(any_value(z.maxhop), 6) AS mean_radius
FROM usable u CROSS JOIN {_grid(Q.CAPS, "cap")} g CROSS JOIN {_grid(Q.CAP_BUDGETS, "b")} b
LEFT JOIN cap_best x ON x.instance_id = u.instance_id AND x.cap = g.cap JOIN cap_size z ON z.cap = g.cap GROUP BY g.cap, b.b""", _CAP)  # fmt: skip
def _(c: Corpus) -> DataFrame:
    ranked = R.rank_by(c.capped.join(c.scores, ["instance_id", "idx"]), "hop", ["instance_id", "cap"])
    cov = E.coverage(E.hits(E.best_rank(ranked, c.targets, ["cap"]), c.usable, E.CAP_BUDGETS, ["cap"]), ["cap", "budget"])
    per = c.capped.join(c.usable, "instance_id", "left_semi").groupBy("instance_id", "cap").agg(F.count(F.lit(1)).alias("n"), F.max("hop").alias("r"))
    size = per.groupBy("cap").agg(F.round(F.avg("n"), 6).alias("mean_pool"), F.round(F.avg("r"), 6).alias("mean_radius"))
    return cov.join(size, "cap")


# ---- policies

_RULES = {
    "pool_pr": "SELECT p.*, coalesce(round(r.pr, 9), 0) AS pr FROM pool p LEFT JOIN pr39 r USING (instance_id, idx)",
    "rule_best": " UNION ALL ".join(
        f"SELECT '{p}' AS rule, instance_id, min(rank) AS best FROM ({_ranked_sql(Q.ORDERS[p], 'pool_pr')}) SEMI JOIN targets USING (instance_id, idx) GROUP BY ALL"
        for p in Q.ORDERS
    ),
}


@query("ag6_rule_split_means", f"""
SELECT r.rule, b.b AS k, CASE WHEN CAST('0x' || right(md5(u.instance_id), 1) AS INTEGER) % 2 = 0 THEN 'dev' ELSE 'test' END AS split,
  round(avg(coalesce((x.best <= b.b)::INTEGER, 0)), 6) AS acc
FROM usable u CROSS JOIN (SELECT unnest([{", ".join(f"'{p}'" for p in Q.ORDERS)}]) AS rule) r CROSS JOIN {_grid(Q.RULE_KS, "b")} b
LEFT JOIN rule_best x ON x.instance_id = u.instance_id AND x.rule = r.rule GROUP BY ALL""", _RULES)  # fmt: skip
def _(c: Corpus) -> DataFrame:
    pool = R.with_pagerank(c)
    best = R.best_ranks(pool, c.targets, list(R.POLICIES))
    hit = E.hits(best, c.usable, E.RULE_KS, ["rule"])
    split = F.when(S.md5_digit(F.col("instance_id")) % 2 == 0, "dev").otherwise("test")
    return hit.groupBy("rule", F.col("budget").alias("k"), split.alias("split")).agg(F.round(F.avg("hit"), 6).alias("acc"))


_POLICY = {
    "lo_best": "SELECT instance_id, min(rank) AS best FROM (" + _ranked_sql("lex DESC, idx", "pool") + ") SEMI JOIN targets USING (instance_id, idx) GROUP BY ALL",
    "bm_best": "SELECT instance_id, min(rank) AS best FROM (" + _ranked_sql(HOP, "pool") + ") SEMI JOIN targets USING (instance_id, idx) GROUP BY ALL",
    "pol": f"""SELECT u.instance_id, u.repo, b.b AS budget, coalesce((l.best <= b.b)::INTEGER, 0) AS lex, coalesce((m.best <= b.b)::INTEGER, 0) AS mix
  FROM usable u CROSS JOIN {_grid(Q.SWEEP_BUDGETS, "b")} b LEFT JOIN lo_best l USING (instance_id) LEFT JOIN bm_best m USING (instance_id)""",
    "hf_best7": "SELECT instance_id, min(rank) AS best FROM (" + _ranked_sql("hop ASC, lex DESC, idx ASC", "pool") + ") SEMI JOIN targets USING (instance_id, idx) GROUP BY ALL",
}


def policy_hits(c: Corpus, **more: str) -> DataFrame:
    """``instance_id, repo, budget, lex, mix``: hits of the lexical and the hop order in one pool, and of ``more``."""
    rules = {"lex": "lexical_only", "mix": "budget_mix", **more}
    best = R.best_ranks(c.pool(), c.targets, list(rules.values()))
    flags = [F.coalesce(F.max(F.when(F.col("rule") == p, F.col("hit"))), F.lit(0)).alias(n) for n, p in rules.items()]
    return E.hits(best, c.usable, E.SWEEP_BUDGETS, ["rule"]).groupBy("instance_id", "repo", "budget").agg(*flags)


@query("ag7_per_repository", """
SELECT repo, count(*) AS n, round(avg(lex), 6) AS lex20, round(avg(mix), 6) AS mix20, round(avg(coalesce((h.best <= 20)::INTEGER, 0)), 6) AS hop20,
  round(avg(mix - lex), 6) AS gain FROM pol LEFT JOIN hf_best7 h USING (instance_id) WHERE budget = 20 GROUP BY repo""", _POLICY)  # fmt: skip
def _(c: Corpus) -> DataFrame:
    rows = policy_hits(c, hop="hop_first").where("budget = 20")
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("lex"), 6).alias("lex20"), F.round(F.avg("mix"), 6).alias("mix20"), F.round(F.avg("hop"), 6).alias("hop20"),
                                    F.round(F.avg(F.col("mix") - F.col("lex")), 6).alias("gain"))


@query("ag8_policy_crossover", f"""
SELECT budget, round(avg(lex), 6) AS lexical, round(avg(mix), 6) AS budget_mix, round(avg(mix - lex), 6) AS gain,
  count(*) FILTER (mix > lex) AS improved, count(*) FILTER (mix < lex) AS worsened, count(*) FILTER (mix = lex) AS unchanged,
  round({S.mcnemar_sql("count(*) FILTER (mix > lex)", "count(*) FILTER (mix < lex)")}, 9) AS pvalue FROM pol GROUP BY budget""", _POLICY)  # fmt: skip
def _(c: Corpus) -> DataFrame:
    got = policy_hits(c).groupBy("budget").agg(
        F.avg("lex").alias("l"), F.avg("mix").alias("m"), F.avg(F.col("mix") - F.col("lex")).alias("g"),
        F.count_if(F.col("mix") > F.col("lex")).alias("improved"), F.count_if(F.col("mix") < F.col("lex")).alias("worsened"),
        F.count_if(F.col("mix") == F.col("lex")).alias("unchanged"),
    )
    return got.select("budget", F.round("l", 6).alias("lexical"), F.round("m", 6).alias("budget_mix"), F.round("g", 6).alias("gain"), "improved",
                      "worsened", "unchanged", F.round(S.mcnemar_p(F.col("improved"), F.col("worsened")), 9).alias("pvalue"))


@query("rk17_first_gain", "SELECT CAST(min(budget) AS DOUBLE) AS first_budget FROM (SELECT budget FROM pol GROUP BY budget HAVING sum(mix) > sum(lex))", _POLICY)
def _(c: Corpus) -> DataFrame:
    sums = policy_hits(c).groupBy("budget").agg(F.sum("mix").alias("m"), F.sum("lex").alias("l"))
    return sums.agg(F.min(F.when(F.col("m") > F.col("l"), F.col("budget"))).cast("double").alias("first_budget"))


# ---- hops and ranks

_HOPS = {
    "gh": """SELECT u.instance_id, u.repo, coalesce(min(r.hop), -1)::INTEGER AS hops FROM usable u
  LEFT JOIN (SELECT * FROM reach SEMI JOIN targets USING (instance_id, idx) WHERE k = 10) r USING (instance_id) GROUP BY ALL"""
}


@query("ag9_hop_histogram", """
SELECT CASE WHEN hops < 0 THEN 'unreachable' ELSE hops::VARCHAR END AS hop, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct,
  CASE WHEN hops >= 0 THEN round(100.0 * sum(CASE WHEN hops >= 0 THEN count(*) ELSE 0 END) OVER (ORDER BY hops ROWS UNBOUNDED PRECEDING)
    / sum(count(*)) OVER (), 6) END AS cum_pct FROM gh GROUP BY hops""", _HOPS)  # fmt: skip
def _(c: Corpus) -> DataFrame:
    per = M.gold_hops(c).groupBy("hops").agg(F.count(F.lit(1)).alias("n"))  # ten rows at most
    upto = Window.orderBy("hops").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.sum("n").over(Window.partitionBy())
    cum = F.sum(F.when(F.col("hops") >= 0, F.col("n")).otherwise(0)).over(upto)
    return per.select(F.when(F.col("hops") < 0, "unreachable").otherwise(F.col("hops").cast("string")).alias("hop"), "n",
                      F.round(100.0 * F.col("n") / whole, 6).alias("pct"),
                      F.when(F.col("hops") >= 0, F.round(100.0 * cum / whole, 6)).alias("cum_pct"))


@query("ag10_median_hops", "SELECT median(hops) AS median_hops, count(*) AS n FROM gh WHERE hops >= 0", _HOPS)
def _(c: Corpus) -> DataFrame:
    return M.gold_hops(c).where("hops >= 0").agg(F.median("hops").alias("median_hops"), F.count(F.lit(1)).alias("n"))


_RANKS = {
    "bgr": """SELECT i.instance_id, coalesce(min(s.lex_rank) - 1, 1000000000)::BIGINT AS r
  FROM inst i LEFT JOIN (SELECT * FROM scores SEMI JOIN targets USING (instance_id, idx)) s USING (instance_id) GROUP BY ALL"""
}
_QS = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


@query("ag11_rank_percentiles", " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, round(quantile_cont(r, {q}), 6) AS value FROM bgr WHERE r < 1000000000" for q in _QS), _RANKS)
def _(c: Corpus) -> DataFrame:
    got = M.best_gold_rank(c).where("best_rank < 1000000000").agg(F.percentile("best_rank", list(_QS)).alias("v"))
    return got.select(F.posexplode("v").alias("i", "value")).select(F.get(F.array(*[F.lit(q) for q in _QS]), F.col("i")).alias("q"), F.round("value", 6).alias("value"))


@query("ag12_rank_tail", """
SELECT t.t AS threshold, round(avg((r > t.t)::INTEGER), 6) AS with_sentinel, round(avg((r > t.t)::INTEGER) FILTER (r < 1000000000), 6) AS in_graph
FROM bgr, (SELECT unnest([10, 100, 1000, 5000])::INTEGER AS t) t GROUP BY ALL""", _RANKS)  # fmt: skip
def _(c: Corpus) -> DataFrame:
    """Both denominators: all instances, the sentinel included, and those with a target in the graph."""
    rows = M.best_gold_rank(c).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in (10, 100, 1000, 5000)])))
    over = (F.col("best_rank") > F.col("threshold")).cast("int")
    return rows.groupBy("threshold").agg(F.round(F.avg(over), 6).alias("with_sentinel"), F.round(F.avg(F.when(F.col("best_rank") < 10**9, over)), 6).alias("in_graph"))


# ---- labels

_PRIVATE = f"(starts_with({QN}, '_') AND NOT (starts_with({QN}, '__') AND ends_with({QN}, '__')))"
_LABELS = _RANKS | {
    "lab": """SELECT i.instance_id, i.repo, i.base_commit, length(i.files) AS n_gold_files, length(i.module_level) AS module_level_lines,
    count(g.id) AS n_targets, count(n.id) AS targets_in_graph, count(n.id) / greatest(count(g.id), 1)::DOUBLE AS coverage
  FROM inst i LEFT JOIN gold g USING (instance_id) LEFT JOIN nodes n ON n.instance_id = g.instance_id AND n.id = g.id GROUP BY ALL""",
    "lab_nodes": "SELECT instance_id, count(*) AS n_candidates, count(DISTINCT file) AS n_graph_files FROM nodes GROUP BY ALL",
}


def labels(c: Corpus) -> DataFrame:
    """One row per instance: sizes of gold and graph, share of targets in the graph, best lexical rank."""
    have = c.nodes.select("instance_id", "id", F.lit(1).alias("hit"))
    per = c.gold.join(have, ["instance_id", "id"], "left").groupBy("instance_id").agg(F.count(F.lit(1)).alias("g"), F.count("hit").alias("h"))
    graph = c.nodes.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("f"))
    rows = c.instances.join(per, "instance_id", "left").join(graph, "instance_id", "left").join(M.best_gold_rank(c), "instance_id")
    g, h = F.coalesce("g", F.lit(0)), F.coalesce("h", F.lit(0))
    return rows.select(
        "instance_id", "repo", "base_commit", F.size("files").cast("bigint").alias("n_gold_files"), F.size("module_level").cast("bigint").alias("module_level_lines"),
        g.alias("n_targets"), h.alias("targets_in_graph"), (h / F.greatest(g, F.lit(1))).alias("coverage"), F.coalesce("n", F.lit(0)).alias("n_candidates"),
        F.coalesce("f", F.lit(0)).alias("n_graph_files"), F.col("best_rank").alias("best_lexical_rank"),
    )


@query("lb1_label_records", """
SELECT l.instance_id, repo, base_commit, n_gold_files, module_level_lines, n_targets, targets_in_graph, round(coverage, 6) AS coverage,
  coalesce(n_candidates, 0) AS n_candidates, coalesce(n_graph_files, 0) AS n_graph_files, b.r AS best_lexical_rank
FROM lab l LEFT JOIN lab_nodes USING (instance_id) JOIN bgr b USING (instance_id)""", _LABELS)  # fmt: skip
def _(c: Corpus) -> DataFrame:
    return labels(c).withColumn("coverage", F.round("coverage", 6))


@query("ag13_label_summary", f"""
SELECT count(*) AS instances, round(avg(coverage), 6) AS graph_coverage, round((SELECT avg({_PRIVATE}::INTEGER) FROM gold), 6) AS share_private,
  median(b.r) AS median_best_rank, round(avg((b.r > 100)::INTEGER), 6) AS over_100, round(avg((b.r > 1000)::INTEGER), 6) AS over_1000,
  round((SELECT avg(contains({QN}, '.')::INTEGER) FROM gold), 6) AS share_method, round(avg((n_targets = 1)::INTEGER), 6) AS share_single,
  count(DISTINCT repo) AS repos, round(avg((coverage = 1)::INTEGER), 6) AS full_coverage, round(avg((coverage = 0)::INTEGER), 6) AS no_coverage
FROM lab JOIN bgr b USING (instance_id)""", _LABELS)  # fmt: skip
def _(c: Corpus) -> DataFrame:
    from rankweave.operators.measures import classify

    t = classify(c.gold, "id").agg(F.avg(F.col("private").cast("int")).alias("p"), F.avg(F.col("is_method").cast("int")).alias("m"))
    r = F.col("best_lexical_rank")

    def share(cond: Column) -> Column:
        return F.round(F.avg(cond.cast("int")), 6)

    got = labels(c).agg(
        F.count(F.lit(1)).alias("instances"), F.round(F.avg("coverage"), 6).alias("graph_coverage"), F.median("best_lexical_rank").alias("median_best_rank"),
        share(r > 100).alias("over_100"), share(r > 1000).alias("over_1000"), share(F.col("n_targets") == 1).alias("share_single"),
        F.count_distinct("repo").alias("repos"), share(F.col("coverage") == 1).alias("full_coverage"), share(F.col("coverage") == 0).alias("no_coverage"),
    )
    return got.crossJoin(t).withColumn("share_private", F.round("p", 6)).withColumn("share_method", F.round("m", 6)).drop("p", "m")


@query("ag14_task_shape", """
SELECT round(avg((n = 1)::INTEGER), 6) AS one, round(avg((n > 3)::INTEGER), 6) AS over_three, round(avg((n = 0)::INTEGER), 6) AS none,
  round(avg(n), 6) AS mean, median(n) AS median, max(n) AS most FROM (SELECT length(entities) AS n FROM inst)""")  # fmt: skip
def _(c: Corpus) -> DataFrame:
    n = F.size("entities").cast("bigint")
    return c.instances.select(n.alias("n")).agg(
        F.round(F.avg((F.col("n") == 1).cast("int")), 6).alias("one"), F.round(F.avg((F.col("n") > 3).cast("int")), 6).alias("over_three"),
        F.round(F.avg((F.col("n") == 0).cast("int")), 6).alias("none"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"), F.max("n").alias("most"),
    )


@query("ag27_instances_per_repo", "SELECT repo, count(*) AS n FROM inst GROUP BY repo")
def _(c: Corpus) -> DataFrame:
    return c.instances.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@query("ag30_vocabulary", """
SELECT d.instance_id, count(DISTINCT term) AS vocabulary, round(any_value(g.mean_deg), 6) AS mean_deg
FROM (SELECT instance_id, unnest(toks) AS term FROM docs) d JOIN gs g USING (instance_id) GROUP BY ALL""", {"gs": GRAPH_SUMMARY_SQL})  # fmt: skip
def _(c: Corpus) -> DataFrame:
    from rankweave.operators.lexical import name_documents

    docs = name_documents(c.nodes.join(c.instances.select("instance_id"), "instance_id", "left_semi"))
    vocab = docs.select("instance_id", F.explode("tokens").alias("term")).groupBy("instance_id").agg(F.count_distinct("term").alias("vocabulary"))
    return vocab.join(M.graph_summary(c), "instance_id").select("instance_id", "vocabulary", F.round("mean_deg", 6).alias("mean_deg"))


# ---- reach by number of seeds

_REACH = {
    "kmin": "SELECT instance_id, k, min(hop) AS h FROM reach SEMI JOIN targets USING (instance_id, idx) GROUP BY ALL",
    "kk": "SELECT u.instance_id, s.k, m.h FROM usable u CROSS JOIN (SELECT unnest([1, 3, 5, 10, 20, 50, 100])::INTEGER AS k) s LEFT JOIN kmin m ON m.instance_id = u.instance_id AND m.k = s.k",
}


def target_hops(c: Corpus) -> DataFrame:
    """``instance_id, k, h``: least hop of a target for each seed size, null if none is reached."""
    near = c.reach.join(c.targets, ["instance_id", "idx"], "left_semi").groupBy("instance_id", "k").agg(F.min("hop").alias("h"))
    sizes = c.usable.select("instance_id", F.explode(F.array(*[F.lit(k) for k in (1, 3, 5, 10, 20, 50, 100)])).alias("k"))
    return sizes.join(near, ["instance_id", "k"], "left")


def _share(cond: Column) -> Column:
    return F.round(F.avg(F.coalesce(cond.cast("int"), F.lit(0))), 6)


@query("ag16_reach_at_k", """
SELECT k, round(avg(coalesce((h = 0)::INTEGER, 0)), 6) AS bm25_acc, round(avg(coalesce((h <= 3)::INTEGER, 0)), 6) AS reach3,
  round(avg(h) FILTER (h <= 3), 6) AS mean_hops FROM kk WHERE k <= 50 GROUP BY k""", _REACH)  # fmt: skip
def _(c: Corpus) -> DataFrame:
    rows = target_hops(c).where("k <= 50")
    h = F.col("h")
    return rows.groupBy("k").agg(_share(h == 0).alias("bm25_acc"), _share(h <= 3).alias("reach3"), F.round(F.avg(F.when(h <= 3, h)), 6).alias("mean_hops"))


@query("ag17_divergence", """
SELECT k, round(avg(coalesce((h <= 2)::INTEGER, 0)), 6) AS within2, round(avg(coalesce((h <= 6)::INTEGER, 0)), 6) AS reachable,
  round(1 - avg(coalesce((h <= 6)::INTEGER, 0)), 6) AS unreachable FROM kk GROUP BY k""", _REACH)  # fmt: skip
def _(c: Corpus) -> DataFrame:
    h = F.col("h")
    got = target_hops(c).groupBy("k").agg(_share(h <= 2).alias("within2"), F.avg(F.coalesce((h <= 6).cast("int"), F.lit(0))).alias("r"))
    return got.select("k", "within2", F.round("r", 6).alias("reachable"), F.round(1 - F.col("r"), 6).alias("unreachable"))


@query("ag17_file_hit5", """
SELECT round(avg((f.instance_id IS NOT NULL)::INTEGER), 6) AS file_hit5 FROM usable u LEFT JOIN (
  SELECT DISTINCT n.instance_id FROM targets t JOIN nodes n USING (instance_id, idx) SEMI JOIN (
    SELECT n.instance_id, n.file FROM scores s JOIN nodes n USING (instance_id, idx) WHERE s.lex_rank <= 5) x USING (instance_id, file)) f USING (instance_id)""")  # fmt: skip
def _(c: Corpus) -> DataFrame:
    files = c.nodes.select("instance_id", "idx", "file")
    top = c.scores.where("lex_rank <= 5").join(files, ["instance_id", "idx"]).select("instance_id", "file").distinct()
    hit = c.targets.join(files, ["instance_id", "idx"]).join(top, ["instance_id", "file"], "left_semi").select("instance_id").distinct().withColumn("x", F.lit(1))
    return c.usable.join(hit, "instance_id", "left").agg(F.round(F.avg(F.coalesce("x", F.lit(0))), 6).alias("file_hit5"))


@query("ag25_gold_file_rank", """
SELECT round(avg((r = 0)::INTEGER), 6) AS same_file_at_1, median(r) AS median_rank FROM (
  SELECT u.instance_id, min(f.lex_rank) - 1 AS r FROM usable u JOIN targets t USING (instance_id) JOIN nodes n USING (instance_id, idx)
  JOIN scores_file f USING (instance_id, file) GROUP BY ALL)""")  # fmt: skip
def _(c: Corpus) -> DataFrame:
    """Rank of the target's file by file BM25, which is what the published metric meant."""
    from rankweave.operators.lexical import file_scores

    files = c.targets.join(c.nodes.select("instance_id", "idx", "file"), ["instance_id", "idx"])
    best = files.join(file_scores(c.nodes, c.instances), ["instance_id", "file"]).groupBy("instance_id").agg((F.min("lex_rank") - 1).alias("r"))
    return best.agg(F.round(F.avg((F.col("r") == 0).cast("int")), 6).alias("same_file_at_1"), F.median("r").alias("median_rank"))


_SETS = {
    "t_seeds": "SELECT s.instance_id, k.k, s.idx, s.lex_rank AS seed_rank FROM tfidf s, (SELECT unnest([1, 5, 20, 50])::INTEGER AS k) k WHERE s.lex_rank <= k.k",
    "t_h1": "SELECT DISTINCT s.instance_id, s.k, a.b AS idx FROM t_seeds s JOIN adj a ON a.instance_id = s.instance_id AND a.a = s.idx",
    "t_h2": "SELECT DISTINCT s.instance_id, s.k, a.b AS idx FROM t_h1 s JOIN adj a ON a.instance_id = s.instance_id AND a.a = s.idx",
    "t_hit": """SELECT u.instance_id, k.k, max((d.k IS NOT NULL)::INTEGER) AS direct, max((d.k IS NOT NULL OR e.k IS NOT NULL)::INTEGER) AS exp1,
    max((d.k IS NOT NULL OR e.k IS NOT NULL OR f.k IS NOT NULL)::INTEGER) AS exp2
  FROM usable u CROSS JOIN (SELECT unnest([1, 5, 20, 50])::INTEGER AS k) k
  LEFT JOIN (SELECT DISTINCT instance_id, k FROM t_seeds SEMI JOIN targets USING (instance_id, idx)) d ON d.instance_id = u.instance_id AND d.k = k.k
  LEFT JOIN (SELECT DISTINCT instance_id, k FROM t_h1 SEMI JOIN targets USING (instance_id, idx)) e ON e.instance_id = u.instance_id AND e.k = k.k
  LEFT JOIN (SELECT DISTINCT instance_id, k FROM t_h2 SEMI JOIN targets USING (instance_id, idx)) f ON f.instance_id = u.instance_id AND f.k = k.k
  GROUP BY ALL""",
}


def set_hits(c: Corpus) -> DataFrame:
    """``instance_id, k, direct, exp1, exp2``: hits of TF-IDF seeds and their 1- and 2-hop sets."""

    def make() -> DataFrame:
        from rankweave.operators.expand import bfs, seeds

        reached = bfs(seeds(M.tfidf(c), (1, 5, 20, 50)), c.adj, ["instance_id", "k"], 2)
        near = reached.join(c.targets, ["instance_id", "idx"], "left_semi").groupBy("instance_id", "k").agg(F.min("hop").alias("h"))
        grid = c.usable.select("instance_id", F.explode(F.array(*[F.lit(k) for k in (1, 5, 20, 50)])).alias("k"))
        h = F.col("h")
        flags = [F.coalesce((h <= i).cast("int"), F.lit(0)).alias(n) for i, n in enumerate(("direct", "exp1", "exp2"))]
        return grid.join(near, ["instance_id", "k"], "left").select("instance_id", "k", *flags)

    return c.keep("set_hits", make)


@query("ag18_set_reach", "SELECT k, round(avg(direct), 6) AS direct, round(avg(exp1), 6) AS exp1, round(avg(exp2), 6) AS exp2 FROM t_hit GROUP BY k", _SETS)
def _(c: Corpus) -> DataFrame:
    return set_hits(c).groupBy("k").agg(*[F.round(F.avg(x), 6).alias(x) for x in ("direct", "exp1", "exp2")])


# ---- agent runs

def runs(c: Corpus) -> DataFrame:
    """Agent runs, derived from the evaluation rows: arm, outcome, what the retriever had."""
    e = F.col("eval_id")
    return c.raw("cross_repo").distinct().select(
        "eval_id", F.when(e % 2 == 0, "base").otherwise("skill").alias("arm"), F.col("lex20").alias("edited"), F.coalesce(F.col("mix20") == 1, F.lit(False)).alias("resolved"),
        F.col("hop20").alias("top15"), F.when(e % 3 == 0, F.col("hop20")).alias("top5"), F.coalesce("run_id", F.lit("none")).alias("location"),
        F.concat(F.lit("f"), (e % 7).cast("string")).alias("failure"), F.col("n").alias("tool_calls"), ((e % 97) / 10.0).cast("double").alias("minutes"),
        F.when(e % 5 == 0, F.lit(None)).otherwise(e % 2).alias("ran_tests"),
    )


_COND = "SELECT (edited = 1) AS edited, count(*) AS n, count(*) FILTER (resolved) AS k FROM (SELECT coalesce(edited, 0) AS edited, resolved FROM runs) GROUP BY ALL"


@query("st1_resolved_given_edited", f"SELECT edited, n, k, round({_W[0]}, 6) AS p, round({_W[1]}, 6) AS lo, round({_W[2]}, 6) AS hi FROM ({_COND})")
def _(c: Corpus) -> DataFrame:
    per = runs(c).groupBy(F.coalesce(F.col("edited") == 1, F.lit(False)).alias("edited")).agg(F.count(F.lit(1)).alias("n"), F.count_if("resolved").alias("k"))
    p, lo, hi = S.wilson(F.col("k"), F.col("n"))
    return per.select("edited", "n", "k", F.round(p, 6).alias("p"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


_CELLS = """SELECT count(*) FILTER (coalesce(edited, 0) <> 1 AND resolved) AS b, count(*) FILTER (coalesce(edited, 0) = 1 AND NOT resolved) AS c,
  count(*) FILTER (coalesce(edited, 0) = 1 AND resolved) AS a, count(*) FILTER (coalesce(edited, 0) <> 1 AND NOT resolved) AS d FROM runs"""
_CHI = "(a + b + c + d) * power(a::DOUBLE * d - b::DOUBLE * c, 2) / nullif((a + c)::DOUBLE * (b + d) * (a + b) * (c + d), 0)"


@query("st6_risk_ratio", f"""
SELECT a, b, c, d, round(p1 / greatest(p0, 1e-9), 6) AS risk_ratio, round(exp(ln(p1 / p0) - 1.96 * se), 6) AS lo, round(exp(ln(p1 / p0) + 1.96 * se), 6) AS hi,
  round({_CHI}, 4) AS chi2, round({S.mcnemar_sql("b", "c")}, 9) AS mcnemar
FROM (SELECT *, a / (a + c)::DOUBLE AS p1, b / (b + d)::DOUBLE AS p0, sqrt(1.0 / a - 1.0 / (a + c) + 1.0 / b - 1.0 / (b + d)) AS se FROM ({_CELLS}))""")  # fmt: skip
def _(c: Corpus) -> DataFrame:
    """Risk ratio of editing the gold function; the interval and chi-square are extensions.

    ``mcnemar`` applies the paired test to the unpaired cells, as published.
    """
    edited, res = F.coalesce(F.col("edited") == 1, F.lit(False)), F.col("resolved")
    x = runs(c).agg(F.count_if(edited & res).alias("a"), F.count_if(~edited & res).alias("b"), F.count_if(edited & ~res).alias("c"), F.count_if(~edited & ~res).alias("d"))
    a, b, cc, d = (F.col(v).cast("double") for v in "abcd")
    p1, p0 = a / (a + cc), b / (b + d)
    se = F.sqrt(1 / a - 1 / (a + cc) + 1 / b - 1 / (b + d))
    chi = F.try_divide((a + b + cc + d) * F.pow(a * d - b * cc, 2), (a + cc) * (b + d) * (a + b) * (cc + d))
    return x.select(
        "a", "b", "c", "d", F.round(S.risk_ratio(p1, p0), 6).alias("risk_ratio"), F.round(F.exp(F.log(p1 / p0) - 1.96 * se), 6).alias("lo"),
        F.round(F.exp(F.log(p1 / p0) + 1.96 * se), 6).alias("hi"), F.round(chi, 4).alias("chi2"), F.round(S.mcnemar_p(F.col("b"), F.col("c")), 9).alias("mcnemar"),
    )


_ADH = "SELECT count(*) AS n, count(*) FILTER (edited = 1) AS adhered, count(*) FILTER (edited = 0) AS k FROM runs WHERE arm = 'skill' AND top15 = 1"


@query("st8_adherence_gap", f"SELECT n, adhered, k AS ignored, round({_W[0]}, 6) AS gap, round({_W[1]}, 6) AS lo, round({_W[2]}, 6) AS hi FROM ({_ADH})")
def _(c: Corpus) -> DataFrame:
    x = runs(c).where("arm = 'skill' AND top15 = 1").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("edited") == 1).alias("adhered"), F.count_if(F.col("edited") == 0).alias("k"))
    p, lo, hi = S.wilson(F.col("k"), F.col("n"))
    return x.select("n", "adhered", F.col("k").alias("ignored"), F.round(p, 6).alias("gap"), F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@query("ag19_gap_breakdown", """
SELECT 'location' AS what, location AS value, count(*) AS n FROM runs WHERE arm = 'skill' AND top15 = 1 AND edited = 0 GROUP BY ALL
UNION ALL SELECT 'failure', failure, count(*) FROM runs WHERE arm = 'skill' AND top15 = 1 AND edited = 0 GROUP BY ALL""")  # fmt: skip
def _(c: Corpus) -> DataFrame:
    gap = runs(c).where("arm = 'skill' AND top15 = 1 AND edited = 0")
    long = gap.select(F.expr("stack(2, 'location', location, 'failure', failure) AS (what, value)"))
    return long.groupBy("what", "value").agg(F.count(F.lit(1)).alias("n"))


@query("ag20_arm_summary", """
SELECT arm, count(*) AS n, round(avg(tool_calls), 6) AS tool_calls, round(avg(minutes), 6) AS minutes, round(avg((ran_tests = 1)::INTEGER), 6) AS ran_tests,
  round(avg(resolved::INTEGER) FILTER (ran_tests = 1), 6) AS resolved_ran, round(avg(resolved::INTEGER) FILTER (ran_tests = 0), 6) AS resolved_skipped FROM runs GROUP BY arm""")  # fmt: skip
def _(c: Corpus) -> DataFrame:
    res = F.col("resolved").cast("int")
    return runs(c).groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("tool_calls"), 6).alias("tool_calls"), F.round(F.avg("minutes"), 6).alias("minutes"),
        F.round(F.avg((F.col("ran_tests") == 1).cast("int")), 6).alias("ran_tests"), F.round(F.avg(F.when(F.col("ran_tests") == 1, res)), 6).alias("resolved_ran"),
        F.round(F.avg(F.when(F.col("ran_tests") == 0, res)), 6).alias("resolved_skipped"),
    )


@query("ag24_headroom", """
SELECT count(*) FILTER (top5 = 1) AS top5, count(*) FILTER (top15 = 1) AS top15, count(*) FILTER (top15 = 1) - count(*) FILTER (top5 = 1) AS headroom,
  count(*) FILTER (top15 IS NULL) AS unknown, count(*) AS n FROM runs WHERE arm = 'skill'""")  # fmt: skip
def _(c: Corpus) -> DataFrame:
    x = runs(c).where("arm = 'skill'").agg(F.count_if(F.col("top5") == 1).alias("top5"), F.count_if(F.col("top15") == 1).alias("top15"),
                                           F.count_if(F.col("top15").isNull()).alias("unknown"), F.count(F.lit(1)).alias("n"))
    return x.select("top5", "top15", (F.col("top15") - F.col("top5")).alias("headroom"), "unknown", "n")


# ---- paired statistics

_DRAWS = """
SELECT r.rep, CAST('0x' || left(md5(r.rep || '|' || i.i), 8) AS BIGINT) % i.m AS i
FROM (SELECT unnest(range(0, 4000)) AS rep) r CROSS JOIN (SELECT unnest(range(0, m)) AS i, m FROM (SELECT count(*) AS m FROM usable)) i"""
_BOOT = """
SELECT d.rep, t.k, sum(t.direct)::BIGINT AS direct, sum(t.exp1)::BIGINT AS exp1, sum(t.exp2)::BIGINT AS exp2, count(*) AS m
FROM draws d JOIN bi t USING (i) GROUP BY ALL"""
_BI = {"bi": "SELECT instance_id, k, direct, exp1, exp2, row_number() OVER (PARTITION BY k ORDER BY instance_id) - 1 AS i FROM t_hit"}


#: Resamples of the published intervals.
RESAMPLES = 4_000
_ARMS = [(k, x) for k in (1, 5, 20, 50) for x in ("direct", "exp1", "exp2")]


def bootstrap(c: Corpus, reps: int = RESAMPLES) -> DataFrame:
    """``rep, k, direct, exp1, exp2, m``: hits in resamples of m, drawn by md5 of repetition and position.

    The twelve outcomes of an instance are one number, sent to all executors; draws are counted
    by repetition and outcomes before the shuffle.
    """
    flag = [F.max(F.when(F.col("k") == k, F.col(x))).cast("int") * (1 << b) for b, (k, x) in enumerate(_ARMS)]
    per = set_hits(c).groupBy("instance_id").agg(sum(flag[1:], flag[0]).alias("bits"))
    rows = per.select("bits", (F.row_number().over(Window.orderBy("instance_id")) - 1).cast("bigint").alias("i"))
    m = c.usable.agg(F.count(F.lit(1)).alias("m"))
    tasks = min(reps, 4 * c.spark.sparkContext.defaultParallelism)
    draws = c.spark.range(0, reps, 1, tasks).toDF("rep").crossJoin(F.broadcast(m)).select("rep", "m", F.explode(F.expr("sequence(0, m - 1)")).alias("j"))
    pick = F.pmod(S.md5_number(F.concat_ws("|", F.col("rep").cast("string"), F.col("j").cast("string"))), F.col("m"))
    drawn = draws.select(F.col("rep").cast("int").alias("rep"), pick.alias("i"))
    n = drawn.join(F.broadcast(rows), "i").groupBy("rep", "bits").agg(F.count(F.lit(1)).alias("n"))
    of = [F.struct(F.lit(k).alias("k"), *[F.expr(f"shiftright(bits, {b}) & 1").alias(x) for b, (k_, x) in enumerate(_ARMS) if k_ == k]) for k in (1, 5, 20, 50)]
    long = n.where("n > 0").select("rep", "n", F.inline(F.array(*of)))
    return long.groupBy("rep", "k").agg(F.sum("n").alias("m"), *[F.sum(F.col("n") * F.col(x)).alias(x) for x in ("direct", "exp1", "exp2")])


_BOOT_FINAL = """SELECT k, round(sum(exp2 - direct) / sum(m)::DOUBLE, 6) AS mean, round(quantile_cont((exp2 - direct) / m::DOUBLE, 0.025), 6) AS lo,
  round(quantile_cont((exp2 - direct) / m::DOUBLE, 0.975), 6) AS hi FROM boot GROUP BY k"""
_BOOT_CTES = _SETS | _BI | {"draws": _DRAWS, "boot": _BOOT}


def _mean(of: Column) -> Column:
    return F.round(F.sum(of) / F.sum("m"), 6)


def _bounds(of: Column) -> Column:
    return F.percentile(of / F.col("m"), [0.025, 0.975])


@query("st3_bootstrap_gain", _BOOT_FINAL, _BOOT_CTES)
def _(c: Corpus) -> DataFrame:
    gain = F.col("exp2") - F.col("direct")
    got = bootstrap(c).groupBy("k").agg(_mean(gain).alias("mean"), _bounds(gain).alias("p"))
    return got.select("k", "mean", F.round(F.col("p")[0], 6).alias("lo"), F.round(F.col("p")[1], 6).alias("hi"))


@query("st4_bootstrap_arms", """
SELECT k, round(sum(direct) / sum(m)::DOUBLE, 6) AS direct, round(sum(exp1) / sum(m)::DOUBLE, 6) AS exp1, round(sum(exp2) / sum(m)::DOUBLE, 6) AS exp2,
  round(sum(exp1 - direct) / sum(m)::DOUBLE, 6) AS gain1, round(sum(exp2 - direct) / sum(m)::DOUBLE, 6) AS gain2,
  round(quantile_cont(direct / m::DOUBLE, 0.025), 6) AS direct_lo, round(quantile_cont(direct / m::DOUBLE, 0.975), 6) AS direct_hi FROM boot GROUP BY k""", _BOOT_CTES)  # fmt: skip
def _(c: Corpus) -> DataFrame:
    got = bootstrap(c).groupBy("k").agg(
        *[_mean(F.col(x)).alias(x) for x in ("direct", "exp1", "exp2")],
        *[_mean(F.col(x) - F.col("direct")).alias(g) for x, g in (("exp1", "gain1"), ("exp2", "gain2"))], _bounds(F.col("direct")).alias("p"),
    )
    return got.select("k", "direct", "exp1", "exp2", "gain1", "gain2", F.round(F.col("p")[0], 6).alias("direct_lo"), F.round(F.col("p")[1], 6).alias("direct_hi"))


@query("st2_mcnemar", f"""
SELECT k, gained, lost, round({S.mcnemar_sql("gained", "lost")}, 9) AS pvalue FROM (
  SELECT k, count(*) FILTER (exp2 > direct) AS gained, count(*) FILTER (exp2 < direct) AS lost FROM t_hit GROUP BY k)""", _SETS)  # fmt: skip
def _(c: Corpus) -> DataFrame:
    x = set_hits(c).groupBy("k").agg(F.count_if(F.col("exp2") > F.col("direct")).alias("gained"), F.count_if(F.col("exp2") < F.col("direct")).alias("lost"))
    return x.select("k", "gained", "lost", F.round(S.mcnemar_p(F.col("gained"), F.col("lost")), 9).alias("pvalue"))


# ---- windows, features

@query("win4_rank_in_pool", "SELECT instance_id, idx, round((row_number() OVER (PARTITION BY instance_id ORDER BY lex DESC, idx) - 1) / count(*) OVER (PARTITION BY instance_id)::DOUBLE, 6) AS rank_in_pool FROM pool")
def _(c: Corpus) -> DataFrame:
    per = Window.partitionBy("instance_id")
    r = (F.row_number().over(per.orderBy(F.col("lex").desc(), "idx")) - 1) / F.count(F.lit(1)).over(per)
    return c.pool().select("instance_id", "idx", F.round(r, 6).alias("rank_in_pool"))


_BASE = {
    "pb": f"""SELECT p.*, n.id, n.kind, n.file, n.sig, {QN} AS qn, coalesce(d.deg, 0) AS deg, coalesce(o.outs, 0) AS outs, (f.file IS NOT NULL) AS seed_file,
    list_distinct({Q.ident_tokens_sql(QN)}) AS a, list_distinct({Q.ident_tokens_sql("sig")}) AS g, i.toks AS b
  FROM pool p JOIN nodes n USING (instance_id, idx) LEFT JOIN deg d USING (instance_id, idx) LEFT JOIN outs o USING (instance_id, idx)
  LEFT JOIN (SELECT DISTINCT instance_id, file FROM pool JOIN nodes USING (instance_id, idx) WHERE hop = 0) f USING (instance_id, file)
  JOIN (SELECT instance_id, list_distinct({Q.ident_tokens_sql("issue")}) AS toks FROM inst) i USING (instance_id)""",
}
_DUNDER = "(starts_with(qn, '__') AND ends_with(qn, '__'))"
_JAC = "coalesce(length(list_intersect(a, b)) / nullif(length(list_distinct(list_concat(a, b))), 0)::DOUBLE, 0)"
_NORM = "lex / coalesce(nullif(max(lex) OVER (PARTITION BY instance_id), 0), 1)"
_FEATURES_SQL = {
    "lex_norm": _NORM, "hop": "hop::DOUBLE", "consensus": "ln(1 + flag)", "seed_flag": "(hop = 0)::INTEGER::DOUBLE", "degree_norm": "ln(1 + deg) / 10",
    "in_degree": "ln(1 + greatest(deg - outs, 0)) / 10", "out_degree": "ln(1 + outs) / 10", "same_file_seed": "seed_file::INTEGER::DOUBLE",
    "name_in_issue": "(length(list_intersect(a, b)) > 0)::INTEGER::DOUBLE", "sig_overlap": _JAC, "is_private": "starts_with(qn, '_')::INTEGER::DOUBLE",
    "is_dunder": f"{_DUNDER}::INTEGER::DOUBLE", "is_test_adjacent": f"regexp_matches(file, '{Q.TEST_PATH}')::INTEGER::DOUBLE", "n_args": ARITY_SQL,
    "size_norm": "least(ln(1 + deg), 6) / 6", "is_method": "(contains(id, '::') AND NOT starts_with(qn, '__'))::INTEGER::DOUBLE", "reach_mass": "power(0.5, hop)",
    "rank_in_pool": "(row_number() OVER (PARTITION BY instance_id ORDER BY lex DESC, idx) - 1) / count(*) OVER (PARTITION BY instance_id)::DOUBLE",
}


@query("ft1_node_features", f"SELECT instance_id, idx, {', '.join(f'round({v}, 6) AS {k}' for k, v in _FEATURES_SQL.items())} FROM pb", _BASE)
def _(c: Corpus) -> DataFrame:
    return X.node_features(c)


_SHORT = [
    _NORM, "hop::DOUBLE", "least(deg, 60) / 60.0::DOUBLE", _JAC, "(length(list_intersect(a, b)) > 0)::INTEGER::DOUBLE", "starts_with(qn, '_')::INTEGER::DOUBLE",
    f"{_DUNDER}::INTEGER::DOUBLE", f"least({COMMAS_SQL}, 12) / 12.0::DOUBLE", "seed_file::INTEGER::DOUBLE", "least(hop, 3) / 3.0::DOUBLE",
    "least(length(list_intersect(g, b)), 40) / 40.0::DOUBLE", "coalesce(kind = 'class', false)::INTEGER::DOUBLE",
]


@query("ft3_short_features", f"SELECT instance_id, idx, {', '.join(f'round({v}, 6) AS f{i}' for i, v in enumerate(_SHORT, 1))} FROM pb", _BASE)
def _(c: Corpus) -> DataFrame:
    return X.short_features(c)


def _count(pattern: str) -> str:
    return f"length(regexp_extract_all(issue, '{pattern}'))::DOUBLE"


_ISSUE_SQL = f"""SELECT instance_id, {_count(Q.NAME)} AS n_words, regexp_matches(issue, '{X.TRACE}')::INTEGER::DOUBLE AS has_trace, contains(issue, '```')::INTEGER::DOUBLE AS has_fence,
  {_count("```")} / 2.0 AS n_fence, {_count(X.TEST_WORDS)} AS test_words, {_count(X.MOCK_WORDS)} AS mock_words, {_count(X.PUNCT)} AS punct,
  round(length(regexp_replace(issue, '[^\\p{{Lu}}]', '', 'g')) / greatest(length(issue), 1)::DOUBLE, 6) AS upper_ratio FROM inst"""


@query("ft4_issue_features", _ISSUE_SQL)
def _(c: Corpus) -> DataFrame:
    return X.issue_features(c.instances)


@query("ft6_gold_features", """SELECT instance_id, length(entities) AS n_gold, length(files) AS n_gold_files, length(module_level) AS module_level, length(added_files) AS added_files FROM inst""")
def _(c: Corpus) -> DataFrame:
    return c.instances.select("instance_id", *[F.size(a).cast("bigint").alias(n) for a, n in (("entities", "n_gold"), ("files", "n_gold_files"), ("module_level", "module_level"), ("added_files", "added_files"))])


_TRI = {
    "gs": GRAPH_SUMMARY_SQL,
    "fi": _ISSUE_SQL,
    "tri": """SELECT fi.*, gs.n_nodes::DOUBLE AS n_nodes, gs.mean_deg, gs.n_files::DOUBLE AS n_files, gs.cross_file, length(i.entities)::DOUBLE AS n_gold,
    length(i.files)::DOUBLE AS n_gold_files, length(i.module_level)::DOUBLE AS n_module_level, length(i.added_files)::DOUBLE AS n_added_files
  FROM fi JOIN gs USING (instance_id) JOIN inst i USING (instance_id)""",
}
_TRIAGE = ["n_words", "has_trace", "has_fence", "n_fence", "test_words", "mock_words", "punct", "upper_ratio", "n_nodes", "mean_deg", "n_files", "cross_file",
           "n_gold", "n_gold_files", "n_module_level", "n_added_files"]
_SEVEN = ["n_words", "has_trace", "n_fence", "test_words", "n_nodes", "mean_deg", "n_files"]


def _corr_sql(features: list[str], target: str) -> str:
    one = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x, ({target})::INTEGER::DOUBLE AS y FROM tri" for f in features)
    return f"SELECT feature, round(corr(x, y), 6) AS r FROM ({one}) GROUP BY feature HAVING stddev_pop(x) > 0 AND stddev_pop(y) > 0"


@query("ag21_triage_correlations", _corr_sql(_TRIAGE, "n_gold > 0"), _TRI)
def _(c: Corpus) -> DataFrame:
    return X.correlations(X.triage(c), _TRIAGE, F.col("n_gold") > 0)


@query("ft7_triage_module_level", _corr_sql(_SEVEN, "n_module_level > 0"), _TRI)
def _(c: Corpus) -> DataFrame:
    return X.correlations(X.triage(c), _SEVEN, F.col("n_module_level") > 0)


@query("mth5_rank_histogram", """
SELECT least(floor(log10(r + 1) / 0.25), 20)::INTEGER AS bucket, count(*) AS n FROM bgr WHERE r < 1000000000 GROUP BY ALL""", _RANKS)  # fmt: skip
def _(c: Corpus) -> DataFrame:
    """Buckets of a quarter decade of the best lexical rank."""
    bucket = F.least(F.floor(F.log10(F.col("best_rank") + 1) / 0.25), F.lit(20)).cast("int")
    return M.best_gold_rank(c).where("best_rank < 1000000000").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_FOLD = "SELECT repo, CAST((row_number() OVER (ORDER BY md5(coalesce(repo, '')), repo) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT repo FROM usable)"


@query("ml2_folds", _FOLD)
def _(c: Corpus) -> DataFrame:
    order = Window.orderBy(F.md5(F.coalesce("repo", F.lit(""))), "repo")  # one row a repository
    return c.usable.select("repo").distinct().select("repo", ((F.row_number().over(order) - 1) % 5).alias("fold"))


@query("ml4_rerank_gbt")
def _(c: Corpus) -> DataFrame:
    from rankweave.operators.model import rerank

    return rerank(c).select("instance_id", "idx", "fold", "rank")


@query("ml5_rerank_accuracy")
def _(c: Corpus) -> DataFrame:
    from rankweave.operators.model import rerank

    ours = E.hits(E.best_rank(rerank(c), c.targets), c.usable, (1, 5, 10, 20, 50))
    base = E.hits(E.best_rank(R.rank_by(c.pool(), "lex"), c.targets), c.usable, (1, 5, 10, 20, 50)).select("instance_id", "budget", F.col("hit").alias("lex"))
    both = ours.join(base, ["instance_id", "budget"])
    got = both.groupBy("budget").agg(F.avg("lex").alias("l"), F.avg("hit").alias("m"), F.count_if(F.col("hit") > F.col("lex")).alias("gains"), F.count_if(F.col("hit") < F.col("lex")).alias("losses"))
    return got.select(F.col("budget").alias("k"), F.round("l", 6).alias("lexical"), F.round("m", 6).alias("reranked"), "gains", "losses",
                      F.round(S.mcnemar_p(F.col("gains"), F.col("losses")), 9).alias("pvalue"))
