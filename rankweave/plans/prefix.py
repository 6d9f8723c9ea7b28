"""Common table expressions from which the DuckDB counterparts of the core queries are put together."""

from __future__ import annotations

import re

from rankweave.plans.sql_text import B, CAP_AFTER, CAPS, K1, SEED_SIZES, STOP_TOOL, ident_tokens_sql, words_sql

QN = "list_extract(string_split(id, '::'), -1)"


def _nodes(tests: str) -> str:
    return f"""
  SELECT instance_id, id, file, sig, start, kind, is_test,
    CAST(row_number() OVER (PARTITION BY instance_id ORDER BY node_idx NULLS FIRST, id) - 1 AS INTEGER) AS idx
  FROM (
    SELECT instance_id, id, node_idx, kind, coalesce(file, '') AS file, coalesce(sig, '') AS sig,
      coalesce(test, false) AS is_test, coalesce(start, 0) AS start
    FROM graph_nodes
    WHERE kind IN ('function', 'class') AND id IS NOT NULL AND instance_id IS NOT NULL {tests}
    QUALIFY row_number() OVER (PARTITION BY instance_id, id ORDER BY node_idx NULLS FIRST, coalesce(file, ''), coalesce(sig, ''),
      coalesce(start, 0), kind, coalesce(test, false)) = 1)"""


def _edges(nodes: str) -> str:
    return f"""
  SELECT e.instance_id, e.edge_no, s.idx AS src, d.idx AS dst, e.type
  FROM (SELECT instance_id, edge_no,
      CASE WHEN edge LIKE '[%' THEN edge::JSON ->> '$[0]' ELSE edge::JSON ->> '$.from' END AS src_id,
      CASE WHEN edge LIKE '[%' THEN edge::JSON ->> '$[1]' ELSE edge::JSON ->> '$.to' END AS dst_id,
      CASE WHEN edge LIKE '[%' THEN edge::JSON ->> '$[2]' ELSE edge::JSON ->> '$.type' END AS type
    FROM (SELECT DISTINCT instance_id, edge_no, edge FROM graph_edges)) e
  JOIN {nodes} s ON s.instance_id = e.instance_id AND s.id = e.src_id
  JOIN {nodes} d ON d.instance_id = e.instance_id AND d.id = e.dst_id
  WHERE e.type IN ('calls', 'imports', 'inherits') AND s.idx <> d.idx"""


def _adj(edges: str) -> str:
    return f"SELECT instance_id, src AS a, dst AS b FROM {edges} UNION SELECT instance_id, dst, src FROM {edges}"


def bm25_ctes(name: str, docs: str, doc: str, queries: str) -> dict[str, str]:
    """CTEs that end in ``name``: instance_id, doc, lex, lex_rank."""
    return {
        f"{name}_post": f"""
  SELECT p.instance_id, p.{doc}, p.term, count(*) AS tf
  FROM (SELECT instance_id, {doc}, unnest(toks) AS term FROM {docs}) p
  SEMI JOIN {queries} q ON q.instance_id = p.instance_id AND q.term = p.term GROUP BY ALL""",
        f"{name}_df": f"SELECT instance_id, term, count(*) AS df FROM {name}_post GROUP BY ALL",
        f"{name}_stat": f"""
  SELECT instance_id, count(*) AS n, CASE WHEN sum(length(toks)) > 0 THEN sum(length(toks)) / count(*)::DOUBLE ELSE 1.0 END AS avgdl
  FROM {docs} GROUP BY ALL""",
        f"{name}_sum": f"""
  SELECT p.instance_id, p.{doc}, sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * ({K1} + 1)
    / (p.tf + {K1} * (1 - {B} + {B} * length(d.toks) / s.avgdl))) AS score
  FROM {name}_post p JOIN {name}_df f USING (instance_id, term) JOIN {docs} d USING (instance_id, {doc})
  JOIN {name}_stat s USING (instance_id) GROUP BY ALL""",
        name: f"""
  SELECT instance_id, {doc}, lex, CAST(row_number() OVER (PARTITION BY instance_id ORDER BY lex DESC, {doc}) AS INTEGER) AS lex_rank
  FROM (SELECT d.instance_id, d.{doc}, round(coalesce(s.score, 0), 9) AS lex FROM {docs} d LEFT JOIN {name}_sum s USING (instance_id, {doc}))""",
    }


def bfs_ctes(name: str, start: str, keys: list[str], adj: str, hops: int, cap: str | None = None, after: bool = False) -> dict[str, str]:
    """CTEs that end in ``name``: keys, idx, hop, seed_rank; one CTE a hop."""
    ks = ", ".join(keys)
    fk = ", ".join(f"f.{k}" for k in keys)
    out = {f"{name}_h0": f"SELECT {ks}, idx, CAST(min(seed_rank) AS INTEGER) AS seed_rank, 0 AS hop FROM {start} GROUP BY {ks}, idx"}
    for h in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT {ks}, idx FROM {name}_h{i}" for i in range(h))
        limit = ""
        if cap is not None and (not after or h > 1):
            limit = f"SEMI JOIN (SELECT {ks} FROM ({seen}) GROUP BY {ks} HAVING count(*) <= {cap}) l USING ({ks})"
        out[f"{name}_h{h}"] = f"""
  SELECT * FROM (
    SELECT {fk}, a.b AS idx, CAST(min(f.seed_rank) AS INTEGER) AS seed_rank, {h} AS hop
    FROM (SELECT * FROM {name}_h{h - 1} {limit}) f JOIN {adj} a ON a.instance_id = f.instance_id AND a.a = f.idx
    GROUP BY {fk}, a.b) n
  ANTI JOIN ({seen}) s USING ({ks}, idx)"""
    out[name] = " UNION ALL ".join(f"SELECT {ks}, idx, hop, seed_rank FROM {name}_h{h}" for h in range(hops + 1))
    return out


CTES: dict[str, str] = {
    "nodes": _nodes("AND NOT coalesce(test, false)"),
    "nodes_all": _nodes(""),
    "edges": _edges("nodes"),
    "edges_all": _edges("nodes_all"),
    "adj": _adj("edges"),
    "adj_all": _adj("edges_all"),
    "inst": """
  SELECT instance_id, repo, base_commit, coalesce(problem_statement, '') AS issue, coalesce(gold.entities, []) AS entities,
    coalesce(gold.files, []) AS files, coalesce(gold.module_level, []) AS module_level, coalesce(gold.added_files, []) AS added_files
  FROM instances WHERE instance_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY ingested_at DESC NULLS LAST, problem_statement DESC NULLS LAST,
    created_at DESC NULLS LAST) = 1""",
    "gold": "SELECT DISTINCT instance_id, id FROM (SELECT instance_id, unnest(entities) AS id FROM inst) WHERE id IS NOT NULL",
    "targets": "SELECT n.instance_id, n.idx FROM nodes n SEMI JOIN gold g USING (instance_id, id)",
    "usable": "SELECT instance_id, repo FROM inst SEMI JOIN targets USING (instance_id)",
    "docs": f"""
  SELECT instance_id, idx, list_concat({ident_tokens_sql(QN)}, {ident_tokens_sql("sig")}) AS toks
  FROM nodes SEMI JOIN inst USING (instance_id)""",
    "docs_all": f"""
  SELECT instance_id, idx, list_concat({ident_tokens_sql(QN, STOP_TOOL)}, {ident_tokens_sql("sig", STOP_TOOL)}) AS toks
  FROM nodes_all SEMI JOIN inst USING (instance_id)""",
    "docs_file": f"""
  SELECT instance_id, file, list_distinct({ident_tokens_sql("file")}) AS toks
  FROM (SELECT DISTINCT instance_id, file FROM nodes SEMI JOIN inst USING (instance_id))""",
    "qterms": f"SELECT DISTINCT instance_id, term FROM (SELECT instance_id, unnest({ident_tokens_sql('issue')}) AS term FROM inst)",
    "qterms_tool": f"SELECT DISTINCT instance_id, term FROM (SELECT instance_id, unnest({ident_tokens_sql('issue', STOP_TOOL)}) AS term FROM inst)",
    **bm25_ctes("scores", "docs", "idx", "qterms"),
    **bm25_ctes("scores_all", "docs_all", "idx", "qterms_tool"),
    **bm25_ctes("scores_file", "docs_file", "file", "qterms"),
    "seeds": f"""
  SELECT s.instance_id, k.k, s.idx, s.lex_rank AS seed_rank
  FROM scores s, (SELECT unnest([{", ".join(map(str, SEED_SIZES))}])::INTEGER AS k) k WHERE s.lex_rank <= k.k""",
    **bfs_ctes("reach", "seeds", ["instance_id", "k"], "adj", 8),
    "cap_seeds": f"""
  SELECT s.*, c.cap FROM seeds s, (SELECT unnest([{", ".join(map(str, CAPS))}])::INTEGER AS cap) c WHERE s.k = 10""",
    **bfs_ctes("capped", "cap_seeds", ["instance_id", "k", "cap"], "adj", 12, "cap"),
    "after_seeds": "SELECT * FROM seeds WHERE k = 10",
    **bfs_ctes("after", "after_seeds", ["instance_id", "k"], "adj", 3, str(CAP_AFTER), after=True),
    **bfs_ctes("after_100", "after_seeds", ["instance_id", "k"], "adj", 3, "100", after=True),
    "cons_seeds": "SELECT instance_id, idx, idx AS seed, seed_rank FROM seeds WHERE k = 10",
    **bfs_ctes("cons", "cons_seeds", ["instance_id", "seed"], "adj", 3),
    "skill_seeds": "SELECT instance_id, idx, lex_rank AS seed_rank FROM scores_all WHERE lex_rank <= 10",
    **bfs_ctes("skill", "skill_seeds", ["instance_id"], "adj_all", 2, "200"),
    "pool": """
  SELECT r.instance_id, r.idx, r.hop, r.seed_rank, s.lex, s.lex_rank, CAST(r.hop > 0 AS INTEGER) AS flag
  FROM reach r JOIN scores s USING (instance_id, idx) WHERE r.k = 10 AND r.hop <= 3""",
    "tdocs": f"SELECT instance_id, idx, list_concat({words_sql(QN)}, {words_sql('sig')}) AS toks FROM nodes SEMI JOIN inst USING (instance_id)",
    "tpost": "SELECT instance_id, idx, term, count(*) AS tf FROM (SELECT instance_id, idx, unnest(toks) AS term FROM tdocs) GROUP BY ALL",
    "tw": """
  SELECT p.instance_id, p.idx, p.term, (1 + ln(p.tf)) * ln(n.n / (1 + f.df)::DOUBLE) AS w FROM tpost p
  JOIN (SELECT instance_id, term, count(*) AS df FROM tpost GROUP BY ALL) f USING (instance_id, term)
  JOIN (SELECT instance_id, count(*) AS n FROM tdocs GROUP BY ALL) n USING (instance_id)""",
    "tq": f"SELECT instance_id, term, count(*) AS qt FROM (SELECT instance_id, unnest({words_sql('issue')}) AS term FROM inst) GROUP BY ALL",
    "tdot": """
  SELECT w.instance_id, w.idx, sum(q.qt * w.w) AS dot FROM tw w JOIN tq q USING (instance_id, term) GROUP BY ALL""",
    "tfidf": """
  SELECT instance_id, idx, lex, CAST(row_number() OVER (PARTITION BY instance_id ORDER BY lex DESC, idx) AS INTEGER) AS lex_rank
  FROM (SELECT d.instance_id, d.idx, round(coalesce(t.dot / (CASE WHEN n.norm > 0 THEN n.norm ELSE 1 END) / q.qn, 0), 9) AS lex
    FROM tdocs d LEFT JOIN tdot t USING (instance_id, idx)
    LEFT JOIN (SELECT instance_id, idx, sqrt(sum(w * w)) AS norm FROM tw GROUP BY ALL) n USING (instance_id, idx)
    LEFT JOIN (SELECT instance_id, sqrt(sum(qt * qt)) AS qn FROM tq GROUP BY ALL) q USING (instance_id))""",
    "deg": "SELECT instance_id, a AS idx, count(*) AS deg FROM adj GROUP BY ALL",
    "outs": "SELECT instance_id, src AS idx, count(*) AS outs FROM edges GROUP BY ALL",
    "pr_seeds": """
  SELECT s.instance_id, s.idx, 1.0::DOUBLE / count(*) OVER (PARTITION BY s.instance_id) AS pr FROM seeds s WHERE k = 10""",
    "steps": """
  SELECT a.instance_id, a.a, a.b, 0.85 / count(*) OVER (PARTITION BY a.instance_id, a.a) AS w FROM adj a""",
    **{
        f"pr{i}": f"""
  SELECT instance_id, idx, sum(pr) AS pr FROM (
    SELECT p.instance_id, s.b AS idx, p.pr * s.w AS pr FROM {"pr_seeds" if i == 0 else f"pr{i - 1}"} p
    JOIN steps s ON s.instance_id = p.instance_id AND s.a = p.idx
    UNION ALL SELECT instance_id, idx, 0.15 * pr FROM pr_seeds) GROUP BY ALL"""
        for i in range(40)
    },
    "runs": """
  SELECT eval_id, CASE WHEN eval_id % 2 = 0 THEN 'base' ELSE 'skill' END AS arm, lex20 AS edited,
    coalesce(mix20 = 1, false) AS resolved, hop20 AS top15, CASE WHEN eval_id % 3 = 0 THEN hop20 END AS top5,
    coalesce(run_id, 'none') AS location, 'f' || (eval_id % 7) AS failure, n AS tool_calls, (eval_id % 97) / 10.0::DOUBLE AS minutes,
    CASE WHEN eval_id % 5 = 0 THEN NULL ELSE eval_id % 2 END AS ran_tests
  FROM (SELECT DISTINCT * FROM cross_repo)""",
}


def with_ctes(final: str, extra: dict[str, str] | None = None) -> str:
    """``final`` with the CTEs it names, and those they name, before it."""
    known = CTES | (extra or {})
    order: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b[a-z_][a-z_0-9]*\b(?!\.)", text)):
            if name in known and name not in order and name not in pending:
                pending.add(name)
                need(known[name])
                order.append(name)

    pending: set[str] = set()
    need(final)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({known[n]})" for n in order) + "\n" + final
