"""Queries on sources, text functions, lexical scores, graphs and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rankweave.functions import text as T
from rankweave.operators import lexical as L, measures as M, rank as R
from rankweave.operators.corpus import Corpus
from rankweave.operators.expand import bfs, seed_consensus, seeds, shortest_paths
from rankweave.plans import sql_text as Q
from rankweave.plans.prefix import QN
from rankweave.plans.registry import query

# ---- sources and filters


@query("src1_graph_nodes", "SELECT instance_id, idx, id, kind, file, sig FROM nodes")
def _(c: Corpus) -> DataFrame:
    return c.nodes.select("instance_id", "idx", "id", "kind", "file", "sig")


@query("src1_graph_edges", "SELECT instance_id, edge_no, src, dst, type FROM edges")
def _(c: Corpus) -> DataFrame:
    return c.edges


@query("src3_nodes_with_tests", "SELECT instance_id, idx, id, is_test, start FROM nodes_all")
def _(c: Corpus) -> DataFrame:
    return c.nodes_with_tests.select("instance_id", "idx", "id", "is_test", "start")


@query(
    "src5_instances",
    "SELECT instance_id, repo, base_commit, length(issue) AS issue_chars, length(entities) AS n_gold FROM inst",
)
def _(c: Corpus) -> DataFrame:
    return c.instances.select(
        "instance_id", "repo", "base_commit", F.length("issue").cast("bigint").alias("issue_chars"), F.size("entities").cast("bigint").alias("n_gold")
    )


@query(
    "src7_vectors",
    "SELECT vec_id, instance_id, emb_key, length(embedding) AS dim FROM node_vectors WHERE embedding IS NOT NULL",
)
def _(c: Corpus) -> DataFrame:
    v = c.raw("node_vectors").where("embedding IS NOT NULL")
    return v.select("vec_id", "instance_id", "emb_key", F.size("embedding").cast("bigint").alias("dim"))


@query(
    "src13_embedding_presence",
    """SELECT count(*) FILTER (v.instance_id IS NOT NULL) AS found, count(*) FILTER (v.instance_id IS NULL) AS missing
FROM inst i LEFT JOIN (SELECT DISTINCT instance_id FROM node_vectors WHERE embedding IS NOT NULL) v USING (instance_id)""",
)
def _(c: Corpus) -> DataFrame:
    have = c.raw("node_vectors").where("embedding IS NOT NULL").select("instance_id").distinct().withColumn("x", F.lit(1))
    return c.instances.join(have, "instance_id", "left").agg(F.count("x").alias("found"), F.count_if(F.col("x").isNull()).alias("missing"))


@query(
    "src14_graph_profile",
    """SELECT instance_id, 'kind:' || coalesce(kind, 'none') AS what, count(*) AS n FROM (SELECT DISTINCT * FROM graph_nodes) GROUP BY ALL
UNION ALL SELECT instance_id, 'edge:' || type, count(*) FROM edges GROUP BY ALL""",
)
def _(c: Corpus) -> DataFrame:
    kinds = c.raw("graph_nodes").distinct().select("instance_id", F.concat(F.lit("kind:"), F.coalesce("kind", F.lit("none"))).alias("what"))
    types = c.edges.select("instance_id", F.concat(F.lit("edge:"), "type").alias("what"))
    return kinds.unionByName(types).groupBy("instance_id", "what").agg(F.count(F.lit(1)).alias("n"))


@query(
    "prj6_classify",
    f"""SELECT instance_id, id, string_split(id, '::')[1] AS file, {QN} AS symbol,
  starts_with({QN}, '_') AND NOT (starts_with({QN}, '__') AND ends_with({QN}, '__')) AS private,
  starts_with({QN}, '__') AND ends_with({QN}, '__') AS dunder, contains({QN}, '.') AS is_method FROM gold""",
)
def _(c: Corpus) -> DataFrame:
    return M.classify(c.gold, "id")


@query("prj8_usable", "SELECT instance_id, repo FROM usable")
def _(c: Corpus) -> DataFrame:
    return c.usable


# ---- text functions


@query(
    "str3_ident_tokens",
    f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({Q.ident_tokens_sql('text')}) AS term FROM documents) GROUP BY ALL",
)
def _(c: Corpus) -> DataFrame:
    docs = c.raw("documents").select("doc_id", F.explode(T.ident_tokens(F.col("text"))).alias("term"))
    return docs.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


@query(
    "str4_short_stop_list",
    f"SELECT term, count(*) AS n FROM (SELECT unnest({Q.ident_tokens_sql('text', Q.STOP_TOOL)}) AS term FROM documents) GROUP BY ALL",
)
def _(c: Corpus) -> DataFrame:
    docs = c.raw("documents").select(F.explode(T.ident_tokens(F.col("text"), T.STOP_SHORT)).alias("term"))
    return docs.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("str5_words", f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({Q.words_sql('text')}) AS term FROM documents) GROUP BY ALL")
def _(c: Corpus) -> DataFrame:
    docs = c.raw("documents").select("doc_id", F.explode(T.words(F.col("text"))).alias("term"))
    return docs.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


@query("str2_camel_parts", f"SELECT instance_id, idx, part, count(*) AS n FROM (SELECT instance_id, idx, unnest({Q.camel_sql(QN)}) AS part FROM nodes) GROUP BY ALL")
def _(c: Corpus) -> DataFrame:
    parts = F.explode(F.regexp_extract_all(T.qualified_name(F.col("id")), F.lit(T.CAMEL), F.lit(0)))
    return c.nodes.select("instance_id", "idx", parts.alias("part")).groupBy("instance_id", "idx", "part").agg(F.count(F.lit(1)).alias("n"))


@query("str6_test_paths", f"SELECT file, regexp_matches(file, '{Q.TEST_PATH}') AS is_test_path FROM (SELECT DISTINCT coalesce(file, '') AS file FROM graph_nodes)")
def _(c: Corpus) -> DataFrame:
    return c.raw("graph_nodes").select(F.coalesce("file", F.lit("")).alias("file")).distinct().select("file", F.col("file").rlike(T.TEST_PATH).alias("is_test_path"))


COMMAS_SQL = "(length(sig) - length(replace(sig, ',', '')))"
ARITY_SQL = f"(CASE WHEN regexp_matches(sig, '^\\s*(async )?def ') THEN least({COMMAS_SQL} + 1, 12) ELSE 0 END / 12.0::DOUBLE)"


@query("str7_arity", f"SELECT instance_id, idx, round({ARITY_SQL}, 6) AS n_args, round(least({COMMAS_SQL}, 12) / 12.0::DOUBLE, 6) AS n_commas FROM nodes")
def _(c: Corpus) -> DataFrame:
    return c.nodes.select(
        "instance_id", "idx", F.round(M.arity(F.col("sig")), 6).alias("n_args"), F.round(F.least(M.commas(F.col("sig")), F.lit(12)) / 12, 6).alias("n_commas")
    )


NAME_TOKENS_SQL = f"list_distinct({Q.ident_tokens_sql(QN)})"


@query(
    "arr1_name_issue_overlap",
    f"""SELECT instance_id, idx, length(list_intersect(a, b)) > 0 AS overlaps,
  round(coalesce(length(list_intersect(a, b)) / nullif(length(list_distinct(list_concat(a, b))), 0)::DOUBLE, 0), 6) AS jaccard
FROM (SELECT n.instance_id, n.idx, {NAME_TOKENS_SQL} AS a, list_distinct({Q.ident_tokens_sql("issue")}) AS b FROM nodes n JOIN inst USING (instance_id))""",
)
def _(c: Corpus) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    issues = c.instances.select("instance_id", F.array_distinct(T.ident_tokens(F.col("issue"))).alias("b"))
    both = c.nodes.select("instance_id", "idx", F.array_distinct(T.ident_tokens(T.qualified_name(F.col("id")))).alias("a")).join(issues, "instance_id")
    jaccard = F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
    return both.select("instance_id", "idx", F.arrays_overlap(a, b).alias("overlaps"), F.round(jaccard, 6).alias("jaccard"))


@query("hsh1_split", "SELECT instance_id, CASE WHEN CAST('0x' || right(md5(instance_id), 1) AS INTEGER) % 2 = 0 THEN 'dev' ELSE 'test' END AS split FROM inst")
def _(c: Corpus) -> DataFrame:
    from rankweave.functions.stats import md5_digit

    return c.instances.select("instance_id", F.when(md5_digit(F.col("instance_id")) % 2 == 0, "dev").otherwise("test").alias("split"))


# ---- lexical retrieval


@query("lex1_index", """
SELECT s.instance_id, term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf, n, round(avgdl, 6) AS avgdl
FROM (SELECT instance_id, term, count(DISTINCT idx) AS df FROM (SELECT instance_id, idx, unnest(toks) AS term FROM docs) GROUP BY ALL) t
JOIN scores_stat s USING (instance_id)""")  # fmt: skip
def _(c: Corpus) -> DataFrame:
    docs = L.name_documents(c.nodes.join(c.instances.select("instance_id"), "instance_id", "left_semi"))
    df = L.postings(docs, "instance_id", "idx", "tokens").groupBy("instance_id", "term").agg(F.count(F.lit(1)).alias("df"))
    n, d = F.col("n"), F.col("df")
    return df.join(L.corpus_stats(docs, "instance_id", "tokens"), "instance_id").select(
        "instance_id", "term", "df", F.round(F.log(1 + (n - d + 0.5) / (d + 0.5)), 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl")
    )


def _shown(scores: DataFrame) -> DataFrame:
    return scores.withColumn("lex", L.six_places(F.col("lex")))


@query("lex2_bm25_scores", "SELECT instance_id, idx, floor(lex * 1e6 + 0.5) / 1e6 AS lex, lex_rank FROM scores")
def _(c: Corpus) -> DataFrame:
    return _shown(c.scores)


@query("lex4_file_bm25", "SELECT instance_id, file, floor(lex * 1e6 + 0.5) / 1e6 AS lex, lex_rank FROM scores_file")
def _(c: Corpus) -> DataFrame:
    return _shown(L.file_scores(c.nodes, c.instances))


@query("lex6_seeds", "SELECT instance_id, k, idx, seed_rank FROM seeds")
def _(c: Corpus) -> DataFrame:
    from rankweave.operators.expand import SEED_SIZES

    return seeds(c.scores, SEED_SIZES)


@query("lex7_best_gold_rank", """
SELECT i.instance_id, coalesce(min(s.lex_rank) - 1, 1000000000)::BIGINT AS best_rank
FROM inst i LEFT JOIN (SELECT * FROM scores SEMI JOIN targets USING (instance_id, idx)) s USING (instance_id) GROUP BY ALL""")  # fmt: skip
def _(c: Corpus) -> DataFrame:
    return M.best_gold_rank(c)


@query("lex9_tfidf_cosine", "SELECT instance_id, idx, floor(lex * 1e6 + 0.5) / 1e6 AS lex, lex_rank FROM tfidf")
def _(c: Corpus) -> DataFrame:
    return _shown(M.tfidf(c))


@query("lex10_bm25_with_tests", "SELECT instance_id, idx, floor(lex * 1e6 + 0.5) / 1e6 AS lex, lex_rank FROM scores_all")
def _(c: Corpus) -> DataFrame:
    return _shown(R.skill_tables(c)[1])


@query("lex11_pool_normalized", """
SELECT instance_id, idx, round(lex / coalesce(nullif(max(lex) OVER (PARTITION BY instance_id), 0), 1), 6) AS lex_norm FROM pool""")  # fmt: skip
def _(c: Corpus) -> DataFrame:
    return c.pool().select("instance_id", "idx", F.round(M.pool_norm(), 6).alias("lex_norm"))


# ---- joins


@query("jn4_missing_targets", """
SELECT i.instance_id, count(g.id) AS n_gold, count(n.id) AS in_graph, count(g.id) - count(n.id) AS missing,
  round(count(n.id) / greatest(count(g.id), 1)::DOUBLE, 6) AS coverage
FROM inst i LEFT JOIN gold g USING (instance_id) LEFT JOIN nodes n ON n.instance_id = g.instance_id AND n.id = g.id GROUP BY ALL""")  # fmt: skip
def _(c: Corpus) -> DataFrame:
    have = c.nodes.select("instance_id", "id", F.lit(1).alias("hit"))
    rows = c.instances.select("instance_id").join(c.gold, "instance_id", "left").join(have, ["instance_id", "id"], "left")
    got = rows.groupBy("instance_id").agg(F.count("id").alias("n_gold"), F.count("hit").alias("in_graph"))
    share = F.col("in_graph") / F.greatest("n_gold", F.lit(1))
    return got.select("instance_id", "n_gold", "in_graph", (F.col("n_gold") - F.col("in_graph")).alias("missing"), F.round(share, 6).alias("coverage"))


@query("jn9_id_set_difference", """
SELECT (SELECT count(*) FROM (SELECT instance_id FROM inst EXCEPT SELECT instance_id FROM nodes)) AS only_instances,
  (SELECT count(*) FROM (SELECT instance_id FROM nodes EXCEPT SELECT instance_id FROM inst)) AS only_graphs""")  # fmt: skip
def _(c: Corpus) -> DataFrame:
    ids, graphs = c.instances.select("instance_id"), c.nodes.select("instance_id").distinct()
    left = ids.join(graphs, "instance_id", "left_anti").agg(F.count(F.lit(1)).alias("only_instances"))
    return left.crossJoin(graphs.join(ids, "instance_id", "left_anti").agg(F.count(F.lit(1)).alias("only_graphs")))


# ---- graphs


@query("gr1_adjacency", "SELECT instance_id, a, b FROM adj")
def _(c: Corpus) -> DataFrame:
    return c.adj


@query("gr2_out_edges", "SELECT instance_id, src AS idx, type, count(*) AS n FROM edges GROUP BY ALL")
def _(c: Corpus) -> DataFrame:
    return c.edges.groupBy("instance_id", F.col("src").alias("idx"), "type").agg(F.count(F.lit(1)).alias("n"))


@query("gr3_bfs_hops", "SELECT instance_id, idx, hop FROM reach WHERE k = 10 AND hop <= 3")
def _(c: Corpus) -> DataFrame:
    return c.reached(10, 3).select("instance_id", "idx", "hop")


@query("gr4_reached_by", """
SELECT r.instance_id, r.idx, r.hop, s.idx AS reached_by FROM reach r
JOIN scores s ON s.instance_id = r.instance_id AND s.lex_rank = r.seed_rank WHERE r.k = 10 AND r.hop <= 2""")  # fmt: skip
def _(c: Corpus) -> DataFrame:
    by = c.scores.select("instance_id", F.col("lex_rank").alias("seed_rank"), F.col("idx").alias("reached_by"))
    return c.reached(10, 2).join(by, ["instance_id", "seed_rank"]).select("instance_id", "idx", "hop", "reached_by")


@query("gr5_reached_flag", "SELECT instance_id, idx, flag FROM pool")
def _(c: Corpus) -> DataFrame:
    return c.pool().select("instance_id", "idx", "flag")


@query("gr6_seed_consensus", "SELECT instance_id, idx, count(*) AS consensus FROM cons GROUP BY ALL")
def _(c: Corpus) -> DataFrame:
    return seed_consensus(c.scores, c.adj, 10, 3)


@query("gr7_bfs_depth8", "SELECT instance_id, idx, hop FROM reach WHERE k = 10")
def _(c: Corpus) -> DataFrame:
    return c.reached(10, 8).select("instance_id", "idx", "hop")


@query("gr8_bfs_depth6", "SELECT instance_id, k, count(*) AS n FROM reach WHERE hop <= 6 GROUP BY ALL")
def _(c: Corpus) -> DataFrame:
    return c.reach.where("hop <= 6").groupBy("instance_id", "k").agg(F.count(F.lit(1)).alias("n"))


@query("gr9_bfs_cap_after", "SELECT instance_id, idx, hop FROM after")
def _(c: Corpus) -> DataFrame:
    """The cap is checked after each hop."""
    return bfs(seeds(c.scores, (10,)), c.adj, ["instance_id", "k"], 3, cap=20_000, cap_check="after").select("instance_id", "idx", "hop")


@query("gr9_bfs_cap_after_100", "SELECT instance_id, idx, hop FROM after_100")
def _(c: Corpus) -> DataFrame:
    """The same with a cap that these graphs reach."""
    return bfs(seeds(c.scores, (10,)), c.adj, ["instance_id", "k"], 3, cap=100, cap_check="after").select("instance_id", "idx", "hop")


@query("gr10_bfs_capped", "SELECT instance_id, cap, idx, hop FROM capped")
def _(c: Corpus) -> DataFrame:
    return c.capped.select("instance_id", "cap", "idx", "hop")


@query("gr12_bfs_with_tests", "SELECT instance_id, idx, hop FROM skill")
def _(c: Corpus) -> DataFrame:
    return R.skill_tables(c)[2].select("instance_id", "idx", "hop")


@query("gr14_pagerank", "SELECT instance_id, idx, round(pr, 9) AS pr FROM pr39")
def _(c: Corpus) -> DataFrame:
    return R.ten_seeds_pagerank(c).select("instance_id", "idx", F.round("pr", 9).alias("pr"))


_PATH = {
    "p_reach": "SELECT instance_id, idx, hop FROM reach WHERE k = 10",
    "p0": """
  SELECT instance_id, idx, hop FROM p_reach SEMI JOIN targets USING (instance_id, idx)
  QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY hop, idx) = 1""",
    **{
        f"p{i}": f"""
  SELECT p.instance_id, r.idx, r.hop FROM p{i - 1} p JOIN adj a ON a.instance_id = p.instance_id AND a.a = p.idx
  JOIN p_reach r ON r.instance_id = a.instance_id AND r.idx = a.b AND r.hop = p.hop - 1
  QUALIFY row_number() OVER (PARTITION BY p.instance_id ORDER BY r.idx) = 1"""
        for i in range(1, 9)
    },
}


@query("gr15_shortest_path", " UNION ALL ".join(f"SELECT instance_id, {i} AS step, idx FROM p{i}" for i in range(9)), _PATH)
def _(c: Corpus) -> DataFrame:
    """From the nearest target of each instance (least index of those) back to a seed."""
    reach = c.reached(10, 8).select("instance_id", "idx", "hop")
    near = reach.join(c.targets, ["instance_id", "idx"], "left_semi").groupBy("instance_id").agg(F.min(F.struct("hop", "idx")).alias("s"))
    return shortest_paths(reach, c.adj, near.select("instance_id", F.col("s.idx").alias("idx")), 8)


@query("gr16_gold_hops", """
SELECT u.instance_id, u.repo, coalesce(min(r.hop), -1)::INTEGER AS hops FROM usable u
LEFT JOIN (SELECT * FROM reach SEMI JOIN targets USING (instance_id, idx) WHERE k = 10) r USING (instance_id) GROUP BY ALL""")  # fmt: skip
def _(c: Corpus) -> DataFrame:
    return M.gold_hops(c)


@query("gr17_degrees", """
SELECT n.instance_id, n.idx, coalesce(deg, 0) AS deg, coalesce(outs, 0) AS outs, greatest(coalesce(deg, 0) - coalesce(outs, 0), 0) AS ins
FROM nodes n LEFT JOIN deg USING (instance_id, idx) LEFT JOIN outs USING (instance_id, idx)""")  # fmt: skip
def _(c: Corpus) -> DataFrame:
    return M.degrees(c).withColumn("ins", F.greatest(F.col("deg") - F.col("outs"), F.lit(0)))


GRAPH_SUMMARY_SQL = """
  SELECT n.instance_id, count(*) AS n_nodes, sum(coalesce(d.deg, 0)) / count(*)::DOUBLE AS mean_deg, count(DISTINCT n.file) AS n_files,
    coalesce(any_value(x.cross_file), 0) AS cross_file
  FROM nodes n LEFT JOIN deg d USING (instance_id, idx)
  LEFT JOIN (SELECT e.instance_id, avg((s.file <> t.file)::INTEGER) AS cross_file FROM edges e
    JOIN nodes s ON s.instance_id = e.instance_id AND s.idx = e.src JOIN nodes t ON t.instance_id = e.instance_id AND t.idx = e.dst
    GROUP BY ALL) x USING (instance_id)
  GROUP BY n.instance_id"""


@query("gr18_graph_summary", "SELECT instance_id, n_nodes, round(mean_deg, 6) AS mean_deg, n_files, round(cross_file, 6) AS cross_file FROM gs", {"gs": GRAPH_SUMMARY_SQL})
def _(c: Corpus) -> DataFrame:
    return M.graph_summary(c).withColumn("mean_deg", F.round("mean_deg", 6)).withColumn("cross_file", F.round("cross_file", 6))


@query("gr19_radius", "SELECT instance_id, k, max(hop) AS radius, count(*) AS pool FROM reach GROUP BY ALL")
def _(c: Corpus) -> DataFrame:
    return c.reach.groupBy("instance_id", "k").agg(F.max("hop").alias("radius"), F.count(F.lit(1)).alias("pool"))


# ---- rankings

_POOL_PR = {"pool_pr": "SELECT p.*, coalesce(round(r.pr, 9), 0) AS pr FROM pool p LEFT JOIN pr39 r USING (instance_id, idx)"}


def _policy(i: int, policy: str) -> None:
    source = "pool_pr" if policy.startswith("pr_") or policy == "pagerank" else "pool"
    sql = f"SELECT instance_id, idx, CAST(row_number() OVER (PARTITION BY instance_id ORDER BY {Q.ORDERS[policy]}) AS INTEGER) AS rank FROM {source}"

    @query(f"rk{i}_{policy}", sql, _POOL_PR)
    def _(c: Corpus) -> DataFrame:
        pool = R.with_pagerank(c) if source == "pool_pr" else c.pool()
        return R.rank_by(pool, policy).select("instance_id", "idx", "rank")


for _i, _p in enumerate(("lex", "hop", "cons", "hopcons", "pagerank", "pr_hop", "lex_hop", "cons_hop"), 1):
    _policy(_i, _p)

LEXICAL_FIRST_SQL = """
  SELECT s.instance_id, s.idx, CAST(row_number() OVER (PARTITION BY s.instance_id ORDER BY (p.idx IS NOT NULL)::INTEGER,
    CASE WHEN p.idx IS NOT NULL THEN -s.lex ELSE 0 END, s.idx) AS INTEGER) AS rank
  FROM scores s LEFT JOIN pool p USING (instance_id, idx)"""


@query("rk11_lexical_first", LEXICAL_FIRST_SQL)
def _(c: Corpus) -> DataFrame:
    return R.lexical_first(c.scores, c.pool())


def localize_sql(where: str, source: str = "reach", top_n: int = 100) -> str:
    return f"""
SELECT r.instance_id, r.rank, n.id AS node, n.file, n.kind, r.hop AS hops, CASE WHEN r.hop = 0 THEN 'seed' ELSE 'hop' || r.hop END AS via,
  floor(r.lex * 1e6 + 0.5) / 1e6 AS lexical, m.id AS reached_by
FROM (SELECT x.*, s.lex, CAST(row_number() OVER (PARTITION BY x.instance_id ORDER BY x.hop, s.lex DESC, x.idx) AS INTEGER) AS rank
  FROM {source} x JOIN scores s USING (instance_id, idx) WHERE {where}) r
JOIN nodes n USING (instance_id, idx) JOIN scores b ON b.instance_id = r.instance_id AND b.lex_rank = r.seed_rank
JOIN nodes m ON m.instance_id = b.instance_id AND m.idx = b.idx WHERE r.rank <= {top_n}"""


@query("loc1_localize", localize_sql("x.k = 10 AND x.hop <= 2"))
def _(c: Corpus) -> DataFrame:
    return R.localize(c)


@query("loc3_localize_capped", localize_sql("x.cap = 200 AND x.hop <= 2", "capped", 25))
def _(c: Corpus) -> DataFrame:
    return R.localize(c, cap=200, top_n=25)


@query("loc4_localize_with_tests", f"""
SELECT instance_id, rank, round(lex / coalesce(nullif(max(lex) OVER (PARTITION BY instance_id), 0), 1), 6) AS score, hop AS hops, file, start,
  {QN} AS symbol, id AS node
FROM (SELECT k.instance_id, k.hop, s.lex, n.file, n.start, n.id,
    CAST(row_number() OVER (PARTITION BY k.instance_id ORDER BY k.hop, s.lex DESC, k.idx) AS INTEGER) AS rank
  FROM skill k JOIN scores_all s USING (instance_id, idx) JOIN nodes_all n USING (instance_id, idx) WHERE NOT n.is_test)
WHERE rank <= 20""")  # fmt: skip
def _(c: Corpus) -> DataFrame:
    return R.localize_with_tests(c)


# ---- extensions


@query("ext_khop_subgraph", """
SELECT e.instance_id, e.src, e.dst, e.type, count(*) AS n FROM edges e
SEMI JOIN (SELECT * FROM pool WHERE hop <= 1) a ON a.instance_id = e.instance_id AND a.idx = e.src
SEMI JOIN (SELECT * FROM pool WHERE hop <= 1) b ON b.instance_id = e.instance_id AND b.idx = e.dst GROUP BY ALL""")  # fmt: skip
def _(c: Corpus) -> DataFrame:
    """Edges among the seeds and their neighbours."""
    near = c.pool(hops=1).select("instance_id", "idx")
    inside = c.edges.join(near.withColumnRenamed("idx", "src"), ["instance_id", "src"], "left_semi")
    inside = inside.join(near.withColumnRenamed("idx", "dst"), ["instance_id", "dst"], "left_semi")
    return inside.groupBy("instance_id", "src", "dst", "type").agg(F.count(F.lit(1)).alias("n"))
