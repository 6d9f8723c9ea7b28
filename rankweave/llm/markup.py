"""Markup residue in texts: HTML, Markdown, wiki (MediaWiki, Trac, Jira) and LaTeX to clean text (problem 2).

Code blocks and formulas are set aside first, so nothing inside them is read as a mark. What is
left becomes one tree: HTML tags make its nodes, and the lines inside a text node make headings,
list items, quotes, tables and paragraphs. Each node knows which language it came from.

Which part of the tree is the document is decided by composite text density: characters per tag
of a node, lowered by the share of characters and tags in links; the node with the greatest sum
of its children's densities holds the document, and the least density on the path from it to the
body is the threshold. A statement has no page around it as a rule, so headings, lists, code,
formulas, quotes and tables are kept wherever they stand; what falls below the threshold goes only
in parts of several links whose characters are mostly link text, such as a bar of page links.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"
LANGUAGES = (HTML, MARKDOWN, WIKI, LATEX)

_OPEN, _CLOSE = "\ue000", "\ue001"  # around the number of a part that was set aside
_HELD = re.compile(f"{_OPEN}(\\d+){_CLOSE}")

# Tags that are HTML; anything else in angle brackets is text.
TAGS = frozenset(
    """a abbr address article aside b blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt
    em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i img input ins kbd li link main mark meta nav ol
    option p pre q s samp script section select small span strike strong style sub summary sup table tbody td textarea tfoot th
    thead title tr tt u ul var""".split()
)
_VOID = frozenset("br hr img input link meta col".split())
_IMPLIED = {  # an opening tag ends these open ones
    "li": ({"li", "p"}, {"ul", "ol"}), "p": ({"p"}, {"div", "td", "li", "blockquote"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "option": ({"option"}, {"select"}),
}
# Attributes that stand without a value; other bare words are text, as in "a <b and c> d".
_BARE = "allowfullscreen|async|autofocus|checked|compact|controls|default|defer|disabled|hidden|ismap|loop|multiple|muted|novalidate|nowrap|noshade|open|readonly|required|reversed|selected"
_TAG = re.compile(
    rf"<!--.*?-->|<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+(?:[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+)|(?i:{_BARE})(?![\w:-])))*)\s*(/?)>", re.S
)
# Tags that mean nothing unless something ends them.
_PAIRED = frozenset("a b i q s u".split())
_ENTITY = re.compile(r"&(?:lt|gt|amp|quot|apos|nbsp|le|ge|ne|mdash|ndash|hellip|copy|times|middot|#\d{2,6}|#x[0-9a-fA-F]{2,5});")

# LaTeX environments whose content is code, or a formula.
_CODE_ENV = "verbatim|lstlisting|minted|Verbatim"
_MATH_ENV = "equation|align|gather|multline|eqnarray|math|displaymath|matrix|pmatrix|bmatrix|cases"
# LaTeX commands of running text.
_COMMANDS = (
    "part|chapter|section|subsection|subsubsection|paragraph|title|author|caption|emph|textbf|textit|texttt|textsc|textsf|textrm"
    "|underline|verb|footnote|ref|eqref|cite|label|url|href|includegraphics|begin|end|item|documentclass|usepackage|maketitle"
    "|newcommand|bibitem|footnotesize|noindent|centering|hline|frac|sqrt|mathrm|mathbf|text"
)
_COMMAND = re.compile(rf"(?<![\w\\:])\\({_COMMANDS})(?![A-Za-z])\*?")
_MATHY = re.compile(r"\\[a-zA-Z]+|[A-Za-z0-9)}]\s*[_^]\s*[{\w]|^[A-Za-z]$|^[A-Za-z]\s*[=<>+\-*/]\s*[\w]+$")


#: Depth of the tree; the walks below are recursive.
DEPTH = 100


@dataclass(eq=False)
class Node:
    """A node of the document tree."""

    tag: str
    lang: str | None = None
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    text: str = ""
    info: str = ""
    level: int = 0
    density: float = 0.0
    kept: bool = False

    def add(self, tag: str, lang: str | None = None, text: str = "", info: str = "") -> Node:
        node = Node(tag, lang, self, text=text, info=info, level=self.level + 1)
        self.children.append(node)
        return node


# ---------------------------------------------------------------- program text


_CODE_LINE = re.compile(
    r"""^\s*(?:
      (?:>>>|\.\.\.)(?:\s|$)
    | (?:for|while|if|elif|with|try|except|else|finally|def|class)\b[^.?!]*:\s*$
    | (?:assert|del|return|raise|import|yield|await|print|from\s+[\w.]+\s+import)\s+[\w.*,\s()'"\[\]]+(?:(?:==|!=|<=?|>=?|\bin\b|\bis\b).*)?$
    | (?:pass|break|continue)\s*$
    | [A-Za-z_][\w.]*(?:\[[^\]]*\])?\s*(?:=|\+=|-=|\*=|:=)\s*(?!=)\S.*
    | [A-Za-z_][\w.]*\(.*\)\s*[;:]?\s*$
    | [}\])]+[;,]?\s*$
    | @\w[\w.]*(?:\(.*\))?\s*$
    | File\s+".*",\s+line\s+\d+.* | Traceback\s+\(most\s+recent.*
    )""",
    re.X,
)
_THREE_WORDS = re.compile(r"(?<![a-z])[a-z]{2,}\s+[a-z]{2,}\s+[a-z]{2,}")
_COMMENT = re.compile(r"^\s*(?:#|//|--)\s?(?!#)")


def _sentence(line: str) -> bool:
    """Whether three words in a row and no quote after them lead up to a full stop."""
    return line[-1:] in (".", "?", "!") and bool(_THREE_WORDS.search(line, max(line.rfind("'"), line.rfind('"')) + 1, len(line) - 1))


def program_lines(lines: list[str]) -> list[bool]:
    """Which lines are program text without marks; a comment counts next to such a line."""
    code = [bool(_CODE_LINE.match(x)) and not re.match(r"^\s*[-*+]\s", x) for x in lines]
    # a sentence may begin like a statement
    code = [c and not _sentence(x) for c, x in zip(code, lines, strict=True)]
    start = 0
    while start < len(lines):
        end = start
        while end < len(lines) and lines[end].strip():
            end += 1
        if any(code[start:end]):
            for i in range(start, end):
                if _COMMENT.match(lines[i]):
                    code[i] = True
        start = end + 1
    return code


# ---------------------------------------------------------------- parts set aside


class _Shelf:
    """Code blocks, formulas and inline code, replaced by a number in the text."""

    def __init__(self):
        self.parts: list[Node] = []

    def put(self, tag: str, lang: str, text: str, info: str = "") -> str:
        self.parts.append(Node(tag, lang, text=text, info=info))
        return f"{_OPEN}{len(self.parts) - 1}{_CLOSE}"


_FENCE = re.compile(r"^([ ]{0,3}|[ ]*[-*+>]\s+)(`{3,}|~{3,})\s*([^`\n]*)$")
_WIKI_CODE = re.compile(r"^\s*\{(noformat|code)(:[^}]*)?\}\s*(.*)$")


def _block_code(text: str, shelf: _Shelf) -> str:
    """Code blocks that begin on a line of their own, whichever comes first."""
    out, lines, i = [], text.split("\n"), 0
    code = program_lines(lines)
    while i < len(lines):
        line = lines[i]
        if m := _FENCE.match(line):
            mark, info, j = m[2], m[3].strip(), i + 1
            while j < len(lines) and not re.match(rf"^\s*(?:>\s*)?{re.escape(mark[0])}{{{len(mark)},}}\s*$", lines[j]):
                j += 1
            out.append(m[1] + shelf.put("code", MARKDOWN, "\n".join(lines[i + 1 : j]), info))
            i = j + 1
        elif re.match(r"^\s*\{\{\{\s*(#!\S*.*)?$", line):
            j, depth = i + 1, 1
            while j < len(lines):
                depth += bool(re.match(r"^\s*\{\{\{\s*(#!.*)?$", lines[j])) - bool(re.match(r"^\s*\}\}\}\s*$", lines[j]))
                if depth == 0:
                    break
                j += 1
            out.append(shelf.put("code", WIKI, "\n".join(lines[i + 1 : j]), line.strip()[3:].strip().lstrip("#!")))
            i = j + 1
        elif m := _WIKI_CODE.match(line):
            end = "{" + m[1] + "}"
            rest, j, after = [m[3]] if m[3] else [], i, ""
            if rest and end in rest[0]:
                rest[0], after = rest[0].split(end, 1)
            else:
                j += 1
                while j < len(lines) and end not in lines[j]:
                    rest.append(lines[j])
                    j += 1
                if j < len(lines):
                    last, after = lines[j].split(end, 1)
                    rest += [last] if last.strip() else []
            out.append(shelf.put("code", WIKI, "\n".join(rest), (m[2] or "").lstrip(":")) + after.rstrip())
            i = j + 1
        elif m := re.match(rf"^\s*\\begin\{{({_CODE_ENV})\*?\}}", line):
            j = i + 1
            while j < len(lines) and f"\\end{{{m[1]}" not in lines[j]:
                j += 1
            out.append(shelf.put("code", LATEX, "\n".join(lines[i + 1 : j])))
            i = j + 1
        elif re.search(r"<pre\b", line, re.I) and not code[i]:
            j = i
            while j < len(lines) and not re.search(r"</pre\s*>", lines[j], re.I):
                j += 1
            whole = "\n".join(lines[i : j + 1])
            if m := re.search(r"^(.*?)<pre\b[^>]*>(.*?)(?:</pre\s*>(.*))?$", whole, re.S | re.I):
                inner = html.unescape(re.sub(r"</?code\b[^>]*>|</?(?:span|b|i)\b[^>]*>", "", m[2], flags=re.I))
                out.append(m[1] + shelf.put("code", HTML, inner.strip("\n")) + (m[3] or ""))
            i = j + 1
        elif code[i]:
            j = i
            while j < len(lines) and code[j]:
                j += 1
            out.append(shelf.put("plaincode", "", "\n".join(lines[i:j])))
            i = j
        else:
            out.append(line)
            i += 1
    return "\n".join(out)


class _Next:
    """The next match of a pattern; the positions asked for must not fall."""

    def __init__(self, pattern: str, text: str):
        self.search, self.text = re.compile(pattern).search, text
        self.found = self.search(text)

    def __call__(self, pos: int) -> re.Match | None:
        if self.found and self.found.start() < pos:
            self.found = self.search(self.text, pos)
        return self.found


_MATH_BEGIN = re.compile(rf"\\begin\{{((?:{_MATH_ENV})\*?)\}}")
_DISPLAY = re.compile(r"\\\[")
_PAREN = re.compile(r"\\\(")
_HTML_CODE = re.compile(r"<(code|tt|kbd|samp)\b", re.I)


def _enclosed(
    text: str, opening: re.Pattern, closing: Callable[[re.Match], str], put: Callable[[re.Match, str], str], least: int = 0, head: str = ""
) -> str:
    """Replaces each opening mark with all up to the next closing one; one that isn't closed stays.

    ``least`` characters are enclosed at least; ``head`` ends the opening mark. Every closing mark
    is looked for once, so the time is linear whatever is enclosed.
    """
    out, pos, done = [], 0, 0
    ends: dict[str, _Next] = {}
    heads = _Next(re.escape(head), text)
    while m := opening.search(text, pos):
        pos = m.end()
        begin = heads(pos)
        if begin is None:
            break
        start = begin.end() if head else pos
        close = closing(m)
        if close not in ends:
            ends[close] = _Next(close, text)
        end = ends[close](start + least)
        if end is not None:
            out += text[done : m.start()], put(m, text[start : end.start()])
            done = pos = end.end()
    return "".join([*out, text[done:]])


def _inline_code_and_math(text: str, shelf: _Shelf) -> str:
    def put(tag: str, lang: str):
        return lambda m: shelf.put(tag, lang, m[m.lastindex].strip())

    def block(m: re.Match, inner: str) -> str:
        return shelf.put("formula", LATEX, inner.strip(), "block")

    text = _enclosed(text, _MATH_BEGIN, lambda m: re.escape(f"\\end{{{m[1]}}}"), block)
    text = _enclosed(text, _DISPLAY, lambda m: r"\\\]", block, 1)
    text = re.sub(r"(?<![\\$])\$\$([^$]+?)\$\$", lambda m: shelf.put("formula", LATEX, m[1].strip(), "block"), text, flags=re.S)
    text = _enclosed(text, _PAREN, lambda m: r"\\\)", lambda m, inner: shelf.put("formula", LATEX, inner.strip()), 1)
    text = re.sub(r"\{\{\{([^\n]+?)\}\}\}", put("icode", WIKI), text)
    text = re.sub(r"(?<!`)(`+)(?!`)([^\n]+?)(?<!`)\1(?!`)", put("icode", MARKDOWN), text)
    text = re.sub(r"<(nowiki|syntaxhighlight|source)\b[^>]*>(.*?)</\1>", put("icode", WIKI), text, flags=re.S | re.I)
    text = re.sub(r"\\verb\*?([|!+@])(.+?)\1", put("icode", LATEX), text)
    text = _enclosed(
        text, _HTML_CODE, lambda m: rf"(?i:</{m[1].lower()}\s*>)",
        lambda m, inner: shelf.put("code" if "\n" in inner else "icode", HTML, html.unescape(re.sub(r"<[^>]*>", "", inner))), head=">",
    )

    def dollars(m: re.Match) -> str:
        return shelf.put("formula", LATEX, m[1]) if _MATHY.search(m[1]) else m[0]

    return re.sub(r"(?<![\\$\w])\$(?!\s)([^$\n]+?)(?<![\s\\])\$(?![\w$])", dollars, text)


# ---------------------------------------------------------------- the tree


def _tree(text: str) -> Node:
    """HTML nodes; the rest of the text stays in text nodes."""
    body = Node("body")
    at, pos = body, 0
    closing = {t.lower() for t in re.findall(r"</([A-Za-z][A-Za-z0-9]*)\s*>", text)}

    def words(s: str) -> None:
        if s:
            at.add("text", HTML if _ENTITY.search(s) else None, s)

    for m in _TAG.finditer(text):
        tag = (m[2] or "").lower()
        if m[0].startswith("<!--"):
            words(text[pos : m.start()])
            at.add("comment", HTML)
            pos = m.end()
            continue
        if tag not in TAGS:
            continue
        # List<b> is a type and x <b> y a comparison, unless something ends it
        if tag not in closing and not m[1]:
            if tag in _PAIRED and not m[3] or len(tag) == 1 and re.match(r"\w", text[m.start() - 1 : m.start()]):
                continue
        words(text[pos : m.start()])
        pos = m.end()
        if m[1]:
            up = at
            while up is not body and up.tag != tag:
                up = up.parent
            if up is not body:
                at = up.parent
            else:
                at.add("stray", HTML)
            continue
        if tag in _IMPLIED:
            ends, until = _IMPLIED[tag]
            up = at
            while up is not body and up.tag not in until:
                if up.tag in ends:
                    at = up.parent
                up = up.parent
        node = at.add(tag, HTML, info=html.unescape(m[3] or ""))
        # what is nested deeper than this hangs on the same node; no text is lost
        if tag not in _VOID and not m[4] and node.level < DEPTH:
            at = node
    words(text[pos:])
    return body


_HEAD_MD = re.compile(r"^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
_HEAD_WIKI = re.compile(r"^\s*(={1,6})\s*([^=\s].*?)\s*\1\s*$")
_HEAD_JIRA = re.compile(r"^\s*h([1-6])\.\s+(.*)$")
_RULE = re.compile(r"^\s{0,3}([=-])\1{2,}\s*$")
_ITEM = re.compile(r"^(\s*)([-*+•]|\d{1,3}[.)])\s+(.*)$")
_TASK = re.compile(r"^\s*[-*+]\s+\[[ xX]\]\s+")
_QUOTE = re.compile(r"^\s{0,3}>\s?(.*)$")
_MD_SEP = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$|^\s*\|\s*:?-{3,}:?\s*\|\s*$")
_ROW = re.compile(r"^\s*\|.*\|\s*$")
_DEF = re.compile(r"^\s{0,3}\[[^\]\n]+\]:\s+\S+")


def _lines(node: Node) -> None:
    """Replaces a text node's text by block nodes."""
    lines = node.text.split("\n")
    inside = node.parent
    if len(lines) == 1 and inside is not None and inside.tag != "body":
        _inline(node)
        return
    text, node.text, node.tag = lines, "", "lines"
    i = 0
    while i < len(text):
        line = text[i]
        after = text[i + 1] if i + 1 < len(text) else ""
        if not line.strip():
            node.add("gap")
        elif m := _HEAD_MD.match(line):
            _inline(node.add("heading", MARKDOWN, m[2], str(len(m[1]))))
        elif m := _HEAD_WIKI.match(line):
            _inline(node.add("heading", WIKI, m[2], str(len(m[1]))))
        elif m := _HEAD_JIRA.match(line):
            _inline(node.add("heading", WIKI, m[2], m[1]))
        elif _RULE.match(after) and not _ITEM.match(line) and not _ROW.match(line) and not _RULE.match(line) and not _QUOTE.match(line):
            _inline(node.add("heading", MARKDOWN, line.strip(), "1" if "=" in after else "2"))
            i += 1
        elif _RULE.match(line):
            node.add("rule")
        elif re.match(r"^\s*\{\|", line):  # MediaWiki table
            table = node.add("table", WIKI)
            i += 1
            while i < len(text) and not re.match(r"^\s*\|\}", text[i]):
                if not re.match(r"^\s*\|-|^\s*\|\+", text[i]):
                    row = table.add("row", WIKI)
                    for cell in re.split(r"\|\||!!", re.sub(r"^\s*[|!]", "", text[i])):
                        _inline(row.add("cell", None, re.sub(r"^[^|\[]*=[^|\[]*\|", "", cell).strip()))
                i += 1
        elif _ROW.match(line) and (_MD_SEP.match(after) or line.strip().startswith("||") or _ROW.match(after)):
            j = i
            while j < len(text) and _ROW.match(text[j]):
                j += 1
            lang = MARKDOWN if any(_MD_SEP.match(x) for x in text[i:j]) else WIKI
            table = node.add("table", lang)
            for x in text[i:j]:
                if not _MD_SEP.match(x):
                    row = table.add("row", lang)
                    for cell in re.split(r"\|\|?", x.strip().strip("|")):
                        _inline(row.add("cell", None, cell.strip()))
            i = j - 1
        elif m := re.match(r"^([^&\n]+(?:&[^&\n]*)+)\\\\\s*(?:\\hline)?\s*$", line):  # LaTeX table row
            row = node.add("row", LATEX)
            for cell in m[1].split("&"):
                _inline(row.add("cell", None, cell.strip()))
        elif m := _QUOTE.match(line):
            _inline(node.add("quote", MARKDOWN, m[1]))
        elif re.match(r"^\s*bq\.\s+", line):
            _inline(node.add("quote", WIKI, re.sub(r"^\s*bq\.\s+", "", line)))
        elif _DEF.match(line):
            node.add("def", MARKDOWN)
        elif m := re.match(r"^\s*\\item\b(?:\[([^\]]*)\])?\s*(.*)$", line):
            _inline(node.add("item", LATEX, f"{m[1]}: {m[2]}" if m[1] else m[2], "-"))
        elif m := _ITEM.match(line):
            task = bool(_TASK.match(line))
            _inline(node.add("item", MARKDOWN if task else None, m[3], m[2] if m[2][0].isdigit() else "-"))
        else:
            _inline(node.add("para", None, line.strip() if not _HELD.search(line) else line))
        i += 1


class _Link:
    """A mark whose label may hold further opening brackets, with a ``sub`` like that of a pattern.

    The label goes from ``opening`` to the next of the characters ``stop``, where ``after`` must
    match; with ``close`` all up to that character, on the same line, belongs to the mark. What
    follows a stop is looked at once, so a line of nothing but brackets takes linear time.
    """

    def __init__(self, opening: str, stop: str, after: str, close: str = "", least: int = 1, pipe: bool = False, label: Callable[[str], str] = str):
        self.opening, self.stop, self.after = re.compile(opening), stop, re.compile(after)
        self.close, self.least, self.pipe, self.label = close, least, pipe, label

    def sub(self, kept: str, s: str) -> str:
        out, pos, done, at, end, bars = [], 0, 0, -1, None, (-1, -1)
        stops, closes = _Next(self.stop, s), _Next(rf"[{re.escape(self.close)}\n]", s)
        while m := self.opening.search(s, pos):
            pos, begin, stop = m.start() + 1, m.end(), stops(m.end())
            if stop is None:
                break
            if stop.start() != at:
                at = stop.start()
                end = self._end(s, at, closes)
                last = s.rfind("|", begin, at) if self.pipe else -1
                bars = last, s.rfind("|", begin, last) if last >= 0 else -1
            if end is None or bars[1] >= begin or max(begin, bars[0] + 1) >= at:
                continue
            out += s[done : m.start()], self.label(s[max(begin, bars[0] + 1) : at])
            done = pos = end
        return "".join([*out, s[done:]])

    def _end(self, s: str, at: int, closes: _Next) -> int | None:
        m = self.after.match(s, at)
        if m is None or not self.close:
            return m and m.end()
        c = closes(m.end())
        fits = c is not None and c[0] == self.close and c.start() - m.end() >= self.least
        # an address in parentheses doesn't end in a space
        return c.end() if fits and not (self.close == ")" and s[c.start() - 1].isspace()) else None


_BRACKET = r"(?<![\w\])])\["

# Marks inside a line: pattern, language, what stays.
_MARKS: tuple[tuple[re.Pattern | _Link, str, str], ...] = (
    (re.compile(r"(?<![\w\\])\{(quote|color|panel|note|info|tip|warning|anchor)(?::[^}\n]*)?\}"), WIKI, ""),
    (re.compile(r"(?<![\w\]])!\[([^\]\n]*)\]\([^)\s]+(?:\s+\"[^\"]*\")?\)"), MARKDOWN, r"\1"),
    (_Link(r"(?i:\[\[(?:Image|File|Datei|Fichier|Archivo)[:(])", r"[\]\n]", r"\]\]", label=lambda x: x[:-1] if x.endswith(")") and x != ")" else x), WIKI, r"\1"),
    (_Link(_BRACKET + r"\[(?!\s*\d)", r"[\]\n]", r"\]\]", pipe=True), WIKI, r"\1"),
    (_Link(_BRACKET + r"(?:https?|ftp|mailto|wiki|ticket|source):\S+\s", r"[\]\n]", r"\]", label=lambda x: x.lstrip() or x[-1:]), WIKI, r"\1"),
    (_Link(_BRACKET, r"[\]|\n]", r"\|(?:https?://|[#^~]|mailto:)", "]"), WIKI, r"\1"),
    (_Link(_BRACKET, r"[\]\n]", r"\]\((?!\s)", ")"), MARKDOWN, r"\1"),
    (_Link(_BRACKET, r"[\]\n]", r"\]\[", "]", 0), MARKDOWN, r"\1"),
    (re.compile(r"(?<![\w{$#])\{\{(?!\{)([^{}|\n]+)\}\}(?!\})"), WIKI, r"\1"),
    (re.compile(r"(?<![\w{$#])\{\{(?!\{)([^{}|\n]+)\|([^{}\n]*)\}\}(?!\})"), WIKI, r"\2"),
    (re.compile(r"(?<![\w'=(\[])'''(?![\s'])([^'\n]+?)(?<!\s)'''(?![\w'])"), WIKI, r"\1"),
    (re.compile(r"(?<![\w'=(\[])''(?![\s'])([^'\n]+?)(?<!\s)''(?![\w'])"), WIKI, r"\1"),
    (re.compile(r"(?<![\w*/\\])(\*{1,3})(?![\s*])([^*\n]+?)(?<![\s*])\1(?![\w*])"), MARKDOWN, r"\2"),
    # with underscores two words at least: __init__ and _private_ are identifiers
    (re.compile(r"(?<![\w*/\\.])(_{1,2})(?![\s_])((?:(?:[^\W_]|[-',])+[^\S\n]+)+(?:[^\W_]|[-',])*[^\W_])\1(?![\w(])"), MARKDOWN, r"\2"),
    (re.compile(r"(?<![\w~])~~(?![\s~])([^~\n]+?)(?<![\s~])~~(?![\w~])"), MARKDOWN, r"\1"),
    (re.compile(r"(?<!\w)!(\S+\.(?:png|jpe?g|gif|svg))(?:\|[^!\n]*)?!(?!\w)"), WIKI, r"\1"),
    (re.compile(r"\\href\{[^{}]*\}\{([^{}]*)\}"), LATEX, r"\1"),
    (re.compile(r"\\(?:section|subsection|subsubsection|chapter|paragraph)\*?\{([^{}\n]*)\}"), LATEX, r"\1"),
    (re.compile(r"(?<![\w\\:])\\(?:footnote|ref|eqref|cite|label)\{([^{}\n]*)\}"), LATEX, r" (\1)"),
    (re.compile(r"(?<![\w\\:])\\(?:begin|end)\{[^{}\n]*\}(?:\{[^{}\n]*\}|\[[^\]\n]*\])*"), LATEX, ""),
    (re.compile(rf"(?<![\w\\:])\\(?:{_COMMANDS})\*?(?:\[[^\]\n]*\])?\{{([^{{}}\n]*)\}}"), LATEX, r"\1"),
    (re.compile(rf"(?<![\w\\:])\\(?:{_COMMANDS})(?![A-Za-z{{])"), LATEX, ""),
)
_URL = re.compile(r"(?<![\[(|=\"'])\bhttps?://[^\s\])>|]+")
_SECTION = re.compile(r"^\s*\\((?:sub)*section|chapter|part|paragraph)\*?\{(.*)\}\s*$")


def _inline(node: Node) -> None:
    """Removes marks inside the line; a language that was found becomes a child of the node."""
    s = node.text
    if m := _SECTION.match(s):
        node.tag, node.lang, node.info, s = "heading", LATEX, str(1 + m[1].count("sub")), m[2]
    if node.lang is None and _ENTITY.search(s):
        node.lang = HTML
    s = html.unescape(s) if _ENTITY.search(s) else s
    for pattern, lang, kept in _MARKS:
        new = pattern.sub(kept, s)
        if new != s:
            node.add("mark", lang)
            s = new
    node.text = s


# ---------------------------------------------------------------- density


_KEEP = frozenset("heading item quote table row cell code icode plaincode formula h1 h2 h3 h4 h5 h6 li pre blockquote td th dd dt summary".split())


# Entries of an HTML list.
_ENTRY = frozenset("li dd dt".split())
# Tags that stand inside a line of text.
_RUNNING = frozenset("a abbr address b br cite code comment del dfn em font i img input ins kbd mark q s samp small span stray strike strong sub sup tt u var".split())


def _measure(node: Node, sums: dict[int, tuple[int, int, int, int]]) -> tuple[int, int, int, int]:
    """Characters, tags, link characters and link tags below a node."""
    c, t, lc, lt = len(_HELD.sub("code", node.text).strip()), 0, 0, 0
    for x in node.children:
        a = _measure(x, sums)
        c, t, lc, lt = c + a[0], t + a[1], lc + a[2], lt + a[3]
        if x.lang == HTML and x.tag not in ("text", "comment"):
            t += 1
    if node.tag == "a":
        lc, lt = c, lt + 1
    sums[id(node)] = (c, t, lc, lt)
    return c, t, lc, lt


def select(body: Node) -> float:
    """Marks the nodes of the document as kept and returns the threshold."""
    sums: dict[int, tuple[int, int, int, int]] = {}
    _measure(body, sums)
    body_c, _, body_lc, _ = sums[id(body)]
    nodes: list[Node] = []

    def walk(node: Node) -> None:
        nodes.append(node)
        c, t, lc, lt = sums[id(node)]
        if c == 0:
            node.density = 0.0
        else:
            # the published formula; counts of 0 stand as 1
            t, link, links, other = max(1, t), max(1, lc), max(1, lt), max(1, c - lc)
            base = math.log(c / other * link + body_lc / max(1, body_c) * c + math.e)
            node.density = c / t * math.log(c / link * t / links, base)
        for x in node.children:
            walk(x)

    walk(body)
    inner = [n for n in nodes if n.children]
    best = max(inner, key=lambda n: sum(x.density for x in n.children), default=body)
    threshold, up = best.density, best
    while up is not None:
        threshold = min(threshold, up.density)
        up = up.parent

    plain: dict[int, bool] = {}  # nothing but running text below

    def running(node: Node) -> bool:
        below = [running(x) for x in node.children]
        plain[id(node)] = node.tag in ("text", "lines") or (node.tag in _RUNNING and all(below))
        return plain[id(node)]

    def mostly_links(run: list[Node], around: bool) -> bool:
        c, _, lc, lt = (sum(v) for v in zip(*(sums[id(x)] for x in run), strict=True))
        return 2 * lc > c and (lt > 1 or around)

    def keep(node: Node, safe: bool, bar: bool) -> None:
        # an entry of a list of links is no more than its link
        entry = node.tag in _ENTRY and bar and mostly_links([node], True)
        safe = safe or (node.tag in _KEEP and not entry) or bool(_HELD.search(node.text))
        node.kept = safe or not bar or node.density >= threshold or node.tag in ("body", "gap", "lines")
        if plain.get(id(node), True):
            for x in node.children:
                keep(x, safe, bar)
            return
        # a link counts with the text it stands in
        for inline, part in itertools.groupby(node.children, lambda x: plain[id(x)]):
            nodes = list(part)
            for run in [nodes] if inline else [[x] for x in nodes]:
                of = mostly_links(run, bar)
                for x in run:
                    keep(x, safe, of)

    running(body)
    keep(body, not sums[id(body)][2], False)
    return threshold


# ---------------------------------------------------------------- text


_BLOCKS = frozenset("p div ul ol table tr h1 h2 h3 h4 h5 h6 pre blockquote details summary section article dl dt dd li center hr br form".split())


def _render(node: Node, shelf: _Shelf, out: list[str], depth: int = 0) -> None:
    if not node.kept and node.tag not in _BLOCKS:
        return
    text = _HELD.sub(lambda m: _shelved(shelf.parts[int(m[1])]), node.text)
    if node.tag == "heading" or re.fullmatch("h[1-6]", node.tag):
        level = int(node.info or 1) if node.tag == "heading" else int(node.tag[1])
        inner: list[str] = [text]
        for x in node.children:
            _render(x, shelf, inner, depth)
        out.append(f"\n\n{'#' * level} {' '.join(''.join(inner).split())}\n\n")
        return
    if node.tag in ("item", "li"):
        number = node.info if node.tag == "item" else "-"
        if node.tag == "li" and node.parent is not None and node.parent.tag == "ol":
            number = f"{1 + [x for x in node.parent.children if x.tag == 'li'].index(node)}."
        inner = [text]
        for x in node.children:
            _render(x, shelf, inner, depth + 1)
        new_line = "" if out and out[-1].endswith("\n") else "\n"
        out.append(f"{new_line}{number} {''.join(inner).strip()}\n")
        return
    if node.tag in ("row", "tr"):
        cells = []
        for x in node.children:
            inner = []
            _render(x, shelf, inner, depth)
            if x.tag in ("cell", "td", "th"):
                cells.append(" ".join("".join(inner).split()))
        out.append("\n| " + " | ".join(cells) + " |\n")
        return
    if node.tag in ("quote", "blockquote"):
        inner = [text]
        for x in node.children:
            _render(x, shelf, inner, depth)
        out.append("\n> " + "".join(inner).strip().replace("\n", "\n> ") + "\n")
        return
    if node.tag == "gap":
        out.append("\n\n")
    elif node.tag in ("para",):
        out.append(text + "\n")
    elif node.tag in ("br", "hr"):
        out.append("\n")
    else:
        if node.tag in _BLOCKS:
            out.append("\n")
        out.append(text)
    for x in node.children:
        _render(x, shelf, out, depth)
    if node.tag in _BLOCKS:
        out.append("\n")


def _shelved(part: Node) -> str:
    inner = _HELD.sub("", part.text)
    if part.tag in ("code", "plaincode"):
        return f"\n```{part.info.split()[0] if part.info else ''}\n{inner}\n```\n"
    if part.tag == "formula":
        return f"\n$${inner}$$\n" if part.info == "block" else f"${inner}$"
    return f"`{inner}`"


@dataclass
class Cleaned:
    text: str
    languages: list[str]
    headings: int
    items: int
    code_blocks: int
    formulas: int


def clean(text: str | None) -> Cleaned | None:
    """Clean text and structure of one document; null for null, empty for empty.

    Headings come out as ``#`` lines, list items with ``-`` or their number, code blocks between
    fences, formulas between dollars, table rows between bars. ``languages`` are those whose
    marks the text uses; marks inside code don't count, and list marks alone decide nothing.
    """
    if text is None:
        return None
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace(_OPEN, "").replace(_CLOSE, "")
    shelf = _Shelf()
    rest = _block_code(text, shelf)
    rest = _inline_code_and_math(rest, shelf)
    found = {p.lang for p in shelf.parts if p.lang}
    body = _tree(_URL.sub(lambda m: m[0], rest))
    stack, nodes = [body], []
    while stack:
        n = stack.pop()
        if n.tag == "text":
            _lines(n)
        nodes.append(n)
        stack.extend(n.children)
    found |= {n.lang for n in nodes if n.lang}
    if LATEX in found:
        for n in nodes:
            n.text = re.sub(r"~(?=\s*\()", "", re.sub(r"\\([_%&#$])", r"\1", n.text))
    select(body)
    out: list[str] = []
    _render(body, shelf, out)
    lines = [x.rstrip() for x in "".join(out).split("\n")]
    clean_ = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")
    tags = [n.tag for n in nodes] + [p.tag for p in shelf.parts]
    return Cleaned(
        clean_,
        [x for x in LANGUAGES if x in found],
        sum(t == "heading" or bool(re.fullmatch("h[1-6]", t)) for t in tags),
        sum(t in ("item", "li") for t in tags),
        sum(t in ("code", "plaincode") for t in tags),
        sum(t == "formula" for t in tags),
    )


def clean_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text, languages, headings, items, code_blocks, formulas`` of each row with a text."""
    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("t IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, c.text, c.languages, c.headings, c.items, c.code_blocks, c.formulas) for k, c in zip(pdf["k"], map(clean, pdf["t"]), strict=True)]
            yield pd.DataFrame(rows, columns=["k", "t", "l", "h", "i", "c", "f"])

    found = slim.mapInPandas(run, f"k {kind}, t string, l array<string>, h int, i int, c int, f int")
    return found.toDF(key, text, "languages", "headings", "items", "code_blocks", "formulas")


def valid_statements(instances: DataFrame) -> DataFrame:
    """``instance_id, problem_statement``: of each instance the row ingested last.

    Rows with a null id are ignored; a null time is the earliest; of equal times the greatest
    statement counts, so the choice doesn't depend on the order of rows.
    """
    order = Window.partitionBy("instance_id").orderBy(
        F.col("ingested_at").desc_nulls_last(), F.col("problem_statement").desc_nulls_last()
    )
    rows = instances.where("instance_id IS NOT NULL").select("instance_id", "problem_statement", "ingested_at").distinct()
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("instance_id", "problem_statement")
