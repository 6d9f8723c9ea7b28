"""What DuckDB answers to the queries of this package that SQL can express."""

from __future__ import annotations

from rankweave.plans.skew import normal_name_sql
from rankweave.plans.sql_text import ident_tokens_sql

_QUALIFIED = "list_extract(string_split(id, '::'), -1)"
_TERMS = f"""
k AS (SELECT DISTINCT instance_id, id, coalesce(sig, '') AS sig FROM graph_nodes
      WHERE kind IN ('function', 'class') AND NOT coalesce(test, false)),
t AS (SELECT instance_id, id, unnest(list_distinct(list_concat({ident_tokens_sql(_QUALIFIED)}, {ident_tokens_sql("sig")}))) AS term
      FROM k WHERE instance_id IS NOT NULL AND id IS NOT NULL),
f AS (SELECT instance_id, term, count(DISTINCT id) AS tf FROM t GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM f GROUP BY term)"""

_VALID = """
v AS (SELECT * FROM prediction_ranked WHERE lexical IS NOT NULL AND NOT isnan(lexical) AND instance_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY instance_id, node ORDER BY scored_at DESC NULLS LAST, pred_id DESC NULLS LAST) = 1),
r AS (SELECT instance_id, node, lexical, hops, row_number() OVER (
        PARTITION BY instance_id ORDER BY lexical DESC, hops ASC NULLS LAST, node ASC NULLS LAST) AS place
      FROM v QUALIFY place <= 5)"""

# white space as the tokenizer's \s means it, in a syntax that knows no Unicode class for it
_SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_TOKENS = rf"length(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]+'))"
_SOURCES = f"""
w AS (SELECT lower(trim(source)) AS source, sum({_TOKENS}) AS own FROM documents GROUP BY 1),
m AS (SELECT t.source, t.weight, t.max_repeats, coalesce(w.own, 0) AS own FROM mix_targets t LEFT JOIN w USING (source))"""

# the part of an instance id before its last hyphen and number
_NAMED = r"regexp_replace(regexp_replace(instance_id, '^\s+|\s+$', '', 'g'), '-[0-9]+$', '')"
_ENDS = r"regexp_matches(regexp_replace(instance_id, '^\s+|\s+$', '', 'g'), '-[0-9]+$')"

ORACLES: dict[str, str] = {
    "p3_found": """
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM node_vectors
  WHERE length(embedding) = 64 AND length(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND length(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.92""",
    "p4_found": f"""
WITH RECURSIVE n AS (
  SELECT DISTINCT repo, named FROM (SELECT {normal_name_sql("repo")} AS repo, CASE WHEN {_ENDS} THEN {normal_name_sql(_NAMED)} END AS named FROM repo_graphs)),
e AS (SELECT repo AS a, named AS b FROM n WHERE repo <> named UNION SELECT named, repo FROM n WHERE repo <> named),
w AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a)
SELECT a AS repo_a, b AS repo_b FROM w WHERE a < b""",
    "p5_found": f"WITH {_TERMS} SELECT instance_id, term FROM f JOIN d USING (term) WHERE tf >= 5 AND df <= 3",
    "p5_scores": f"""
WITH {_TERMS},
s AS (SELECT *, tf * ln(((SELECT count(DISTINCT instance_id) FROM f) + 1) / (df + 0.5)) AS s FROM f JOIN d USING (term))
SELECT instance_id, term, tf, df, round(coalesce(s / nullif(sqrt(sum(s * s) OVER (PARTITION BY instance_id)), 0), 0), 6) AS score
FROM s""",
    "p6_found": f"WITH {_VALID} SELECT instance_id, node FROM r",
    "p6_top_nodes": f"WITH {_VALID} SELECT instance_id, CAST(place AS INTEGER) AS rank, node, lexical, CAST(hops AS DOUBLE) AS hops FROM r",
    "p7_found": f"SELECT doc_id FROM documents WHERE {_TOKENS} > 512",
    "p8_found": f"WITH {_SOURCES} SELECT source FROM m WHERE own * max_repeats < weight * (SELECT sum(own) FROM m)",
}
