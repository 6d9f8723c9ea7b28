"""Text functions as Column expressions: they run inside the JVM, no Python worker is needed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The words that carry no localization signal (core list).
STOP_CORE = tuple(
    dict.fromkeys(
        """
a an the and or of to in is are was were be been being for on at by with as from that this
it its we you they he she i not no do does did done can could should would will shall may
might must have has had if then else when while but so such into over under about
error errors issue bug issue bugs python code line lines function functions class classes
file files repo repository traceback stack trace expected actual got when where which
what why how use used using new old version versions please thanks thank hi hello
""".split()
    )
)
# The shorter list lacks these four words.
STOP_SHORT = tuple(w for w in STOP_CORE if w not in ("he", "she", "hi", "hello"))

# Identifier and camel-case patterns, test paths, issue patterns.
IDENT = r"[A-Za-z_][A-Za-z0-9_]*|\p{Nd}+"
NAME = r"[A-Za-z_][A-Za-z0-9_]*"
CAMEL = r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]+|[a-z0-9]+"
TEST_PATH = r"(^|/)(tests?|testing)/|(^|/)test_[^/]*\.py$|_test\.py$|conftest\.py$"
WORD_PUNCT = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def ident_tokens(text: Column, stop: tuple[str, ...] = STOP_CORE) -> Column:
    """ARRAY<STRING> of identifier sub-tokens, the whole identifier first.

    A stop word yields nothing, its parts included. Parts follow only if at least two of more
    than one character exist. Null text gives an empty array.
    """

    def one(tok: Column) -> Column:
        low = F.lower(tok)
        parts = F.filter(_all(tok, CAMEL), lambda p: F.length(p) > 1)
        pieces = F.filter(F.transform(parts, lambda p: F.lower(p)), lambda p: ~p.isin(*stop))
        return F.when(low.isin(*stop), F.array().cast("array<string>")).otherwise(
            F.when(F.size(parts) > 1, F.concat(F.array(low), pieces)).otherwise(F.array(low))
        )

    return F.flatten(F.transform(_all(F.coalesce(text, F.lit("")), IDENT), one))


def words(text: Column) -> Column:
    """Tokens of the independent check: each identifier whole and in camel pieces, longer than two."""

    def one(tok: Column) -> Column:
        return F.concat(F.array(F.lower(tok)), F.transform(_all(tok, CAMEL), lambda p: F.lower(p)))

    toks = F.flatten(F.transform(_all(F.coalesce(text, F.lit("")), NAME), one))
    return F.filter(toks, lambda t: F.length(t) > 2)


def qualified_name(node_id: Column) -> Column:
    """Text after the last ``::`` of a node id; the whole id if there is none."""
    return F.element_at(F.split(node_id, "::", -1), -1)


def file_of(node_id: Column) -> Column:
    """Text before the first ``::`` of a node id."""
    return F.split(node_id, "::", -1)[0]


def word_punct_count(text: Column) -> Column:
    """Number of word-punct tokens; null and empty text have none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PUNCT)).cast("bigint")


def normal_name(name: Column) -> Column:
    """Normal name ``owner/name`` of a repository, null where it is missing.

    Lower case; surrounding white space, trailing slashes and a final ``.git`` removed; ``__``
    written as ``/``. What then isn't letters, digits and hyphens around one slash is missing.
    """
    s = F.regexp_replace(F.lower(name), r"^\s+|\s+$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"/+$", ""), r"\.git$", "")
    s = F.replace(s, F.lit("__"), F.lit("/"))
    return F.when(s.rlike(r"^[a-z0-9-]+/[a-z0-9-]+\z"), s)


def project_of_instance(instance_id: Column) -> Column:
    """Normal name that an instance id carries before its last hyphen and number."""
    s = F.regexp_replace(instance_id, r"^\s+|\s+$", "")
    return F.when(s.rlike(r"-[0-9]+\z"), normal_name(F.regexp_replace(s, r"-[0-9]+\z", "")))


def source_key(source: Column) -> Column:
    """A source name trimmed and in lower case."""
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))
