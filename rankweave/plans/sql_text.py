"""Text functions and parameters as DuckDB sees them.

The SQL that checks the queries has values of its own here, written out and taken from nowhere
else in the library, so that a wrong value on one side shows.
"""

from __future__ import annotations

# The words that carry no localization signal (core list, 102 words).
STOP = """a an the and or of to in is are was were be been being for on at by with as from that this it its we you they he she i not no
do does did done can could should would will shall may might must have has had if then else when while but so such into over under about
error errors issue bug bugs python code line lines function functions class classes file files repo repository traceback stack trace
expected actual got where which what why how use used using new old version versions please thanks thank hi hello"""
# The list of the command-line tool (98 words).
STOP_TOOL = """a an the and or of to in is are was were be been being for on at by with as from that this it its we you they i not no
do does did done can could should would will shall may might must have has had if then else when while but so such into over under about
error errors issue bug bugs python code line lines function functions class classes file files repo repository traceback stack trace
expected actual got where which what why how use used using new old version versions please thanks thank"""

# Patterns and parameters.
IDENT = r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+"
NAME = r"[A-Za-z_][A-Za-z0-9_]*"
TEST_PATH = r"(^|/)(tests?|testing)/|(^|/)test_[^/]*\.py$|_test\.py$|conftest\.py$"
K1, B = 1.5, 0.75
SEED_SIZES = (1, 3, 5, 10, 20, 50, 100)
CAPS = (50, 100, 200, 400, 800, 10**9)
CAP_AFTER = 20_000
COVERAGE_BUDGETS = (1, 3, 5, 10, 20, 30, 50, 100, 200, 400, 800)
SWEEP_BUDGETS = (5, 10, 20, 30, 50, 100, 200, 400, 800)
CAP_BUDGETS = (20, 50, 100, 200)
ACC_KS = (1, 5, 10, 20, 50, 100)
RULE_KS = (10, 20, 50)
# The order of each policy.
ORDERS = {
    "lex": "lex DESC, idx ASC",
    "hop": "hop ASC, lex DESC, idx ASC",
    "cons": "flag DESC, lex DESC, idx ASC",
    "hopcons": "hop ASC, idx ASC",
    "pagerank": "pr DESC, idx ASC",
    "pr_hop": "pr DESC, lex DESC, idx ASC",
    "lex_hop": "lex DESC, hop ASC, idx ASC",
    "hop2_lex2": "hop ASC, lex DESC, idx ASC",
    "cons_hop": "lex DESC, flag DESC, hop ASC, idx ASC",
}


def stop_sql(stop: str = STOP) -> str:
    return "(" + ", ".join(f"'{w}'" for w in stop.split()) + ")"


def camel_sql(token: str) -> str:
    """Camel-case parts as a DuckDB list; its regular expressions have no lookahead."""
    spaced = rf"regexp_replace({token}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')"
    return f"regexp_extract_all({spaced}, '[A-Z][a-z][a-z0-9]*|[A-Z]+|[a-z0-9]+')"


def ident_tokens_sql(text: str, stop: str = STOP) -> str:
    """``ident_tokens`` as a DuckDB expression."""
    parts = f"list_filter({camel_sql('t')}, lambda p: length(p) > 1)"
    few = f"list_filter(list_transform({parts}, lambda p: lower(p)), lambda p: p NOT IN {stop_sql(stop)})"
    return (
        f"flatten(list_transform(list_filter(regexp_extract_all(coalesce({text}, ''), '{IDENT}'), "
        f"lambda t: lower(t) NOT IN {stop_sql(stop)}), "
        f"lambda t: CASE WHEN length({parts}) > 1 THEN list_concat([lower(t)], {few}) ELSE [lower(t)] END))"
    )


def words_sql(text: str) -> str:
    """``words`` as a DuckDB expression."""
    camel = f"list_transform({camel_sql('t')}, lambda p: lower(p))"
    every = f"list_transform(regexp_extract_all(coalesce({text}, ''), '{NAME}'), lambda t: list_concat([lower(t)], {camel}))"
    return f"list_filter(flatten({every}), lambda t: length(t) > 2)"
