"""Markup cleaning and residue detection."""

import time

import pytest
from pyspark.sql import functions as F

from rankweave.llm import markup as M, residue as R

CODE = "x = f(1)\nprint('**a** == b == <p>')"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []), ("Only words here.", []), ("- a\n- b\n\n1. c\n2) d\n* e\n + f", []), (CODE, []), (f"Text.\n\n{CODE}\n\nMore.", []),
        ("# note\nx = 1\ny = 2", []), ("It calls handlers[0](x) with **kwargs and a * b * c.", []), ("List<String> in <module> of <class 'x'>, x < 3 and y > 0", []),
        ("costs $5 here and $7 there, $HOME/.x, C:\\data\\new and \\d+\\s*", []), ("a == b == c, {'a': {'b': 1}}, v[[0, 1]], 4.1 | 64 bit | 5", []), ("see https://x.example/a_b*c and #12", []),
        ("# Head\n\ntext", ["markdown"]), ("Head\n====\n\ntext", ["markdown"]), (f"```py\n<b>\n```", ["markdown"]), ("~~~\n{{{\n~~~", ["markdown"]), ("> quoted", ["markdown"]),
        ("- [ ] task", ["markdown"]), ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]), ("look at `x` or *y*", ["markdown"]), ("[here](http://x.y)", ["markdown"]), ("[a][1]\n\n[1]: http://x", ["markdown"]),
        ("<p>Hi</p>", ["html"]), ("a &lt; b", ["html"]), ("<pre>**x**</pre>", ["html"]), ("line<br>next", ["html"]), ("<!-- c -->", ["html"]),
        ("== Head ==", ["wiki"]), ("h3. Head", ["wiki"]), ("{{{\n**x**\n}}}", ["wiki"]), ("{noformat}\n<p>\n{noformat}", ["wiki"]), ("''x'' and [[Page|name]]", ["wiki"]), ("{| class=\"t\"\n|-\n| a || b\n|}", ["wiki"]),
        ("||a||b||\n|1|2|", ["wiki"]), ("[http://x.y the log]", ["wiki"]), ("{quote}x{quote}", ["wiki"]),
        ("\\section{A}\n\\begin{itemize}\n\\item x\n\\end{itemize}", ["latex"]), ("\\(a^2\\)", ["latex"]), ("$\\alpha_1$", ["latex"]), ("\\begin{verbatim}\n<p>\n\\end{verbatim}", ["latex"]), ("\\begin{quote}x\\end{quote}", ["latex"]),
        ("<p>x</p>\n\n# Head", ["html", "markdown"]),
    ],
)
def test_languages(text, want):
    assert M.clean(text).languages == want
    assert M.clean(text.replace("\n", "\r\n")).languages == want


def test_structure_stays():
    html = '<html><body><h2>Title &amp; more</h2><ul><li>one<li>two</ul><p>It is <b>bold</b>.</p><pre><code class="py">a &lt; b</code></pre><table><tr><th>n<th>v</tr><tr><td>x</td><td>1</td></tr></table></body></html>'
    got = M.clean(html)
    assert got.text.split("\n\n")[0] == "## Title & more"
    for part in ("- one\n- two", "It is bold.", "```\na < b\n```", "| n | v |", "| x | 1 |"):
        assert part in got.text
    tex = M.clean("\\section{A b}\n\n\\begin{enumerate}\n\\item first\n\\end{enumerate}\n\nIs \\emph{not} $\\frac{a}{b}$.\n\n\\[ x^2 \\]")
    for part in ("# A b", "- first", "Is not $\\frac{a}{b}$.", "$$x^2$$"):
        assert part in tex.text
    wiki = M.clean("== T ==\n * a\n\n{{{#!python\nx = 1\n}}}\n\n'''b''' and {{c}}")
    for part in ("## T", "- a", "```python\nx = 1\n```", "b and c"):
        assert part in wiki.text
    md = M.clean("T\n---\n\n1. a\n2. b\n\n> q\n\n~~~\ncode\n~~~\n\nsee **b** [l](http://x)")
    for part in ("## T", "1. a\n2. b", "> q", "```\ncode\n```", "see b l"):
        assert part in md.text
    assert (md.headings, md.items, md.code_blocks) == (1, 2, 1)


def test_link_bars_go_and_text_stays():
    nav = "<div>" + "".join(f'<a href="/{i}">menu {i}</a> ' for i in range(40)) + "</div>"
    body = "<div>" + "".join(f"<p>{'This sentence is the content of the page. ' * 6}</p>" for _ in range(5)) + "</div>"
    got = M.clean(f"<html><body>{nav}{body}</body></html>")
    assert "menu 7" not in got.text and got.text.count("content of the page") == 30


def test_links_in_text_stay():
    body = "".join(f"<p>{'A sentence of the statement. ' * 7}</p>" for _ in range(10))
    inline = "<p>See <a href=x>the manual</a> for details of it.</p>"
    assert "See the manual for details of it." in M.clean(body + inline).text
    assert "Read the long report of the case" in M.clean(f"{body}<p>Read <a href=x>the long report of the case</a></p>").text
    plain = M.clean(f"{'A long line of the statement. ' * 20}\n\nSee <a href=x>the manual</a> for it.\n\n<b>Short</b>").text
    assert all(x in plain for x in ("See", "the manual", "for it.", "Short"))
    bar = "<div>" + " | ".join(f"<a href={i}>page {i}</a>" for i in range(30)) + "</div>"
    nested = "<div>" + "".join(f"<div><a href={i}>part {i}</a></div>" for i in range(30)) + inline + "</div>"
    got = M.clean(f"<html><body>{bar}{nested}{body}{inline}</body></html>").text
    assert "page 7" not in got and "part 7" not in got
    assert got.count("See the manual for details of it.") == 2 and got.count("A sentence") == 70


def test_words_between_angle_brackets_stay():
    for text in ("if a <b and c> d then", "x <i> y", "p <a or q> r", "List<b> of List<i> here"):
        assert M.clean(text).text == text and M.clean(text).languages == []
    assert M.clean("x <b>y</b> <input disabled> <a href=z>w</a>").text.split() == ["x", "y", "w"]


@pytest.mark.parametrize("text", ["Look at __the ModelLayer__ as well.", "It is _really important_ here."])
def test_underscores_mark_two_words_or_more(text):
    assert M.clean(text).languages == ["markdown"] and "_" not in M.clean(text).text


def test_underscores_of_identifiers_stay():
    text = "It calls __init__, _private_ and a_b_c, then _load and __call__ of _x, or _y (see id_, type_)."
    assert M.clean(text).text == text and M.clean(text).languages == []


def test_lists_of_links_go_and_lists_of_text_stay():
    bar = "<ul>" + "".join(f"<li><a href=/{i}>Menu {i}</a></li>" for i in range(9)) + "</ul>"
    text = "<ul>" + "".join(f"<li>Entry {i} says more than its <a href=/{i}>link</a> does.</li>" for i in range(3)) + "</ul>"
    body = "".join(f"<p>{'This sentence is the content of the page. ' * 6}</p>" for _ in range(5))
    got = M.clean(f"<html><body>{bar}<div>{body}{text}</div></body></html>").text
    assert "Menu" not in got and got.count("says more than its link does.") == 3 and got.count("content of the page") == 30
    assert M.clean(bar).text.count("Menu") == 9


def test_density_is_the_published_one():
    import math

    body = M._tree("<div>" + "x" * 90 + "<a>" + "y" * 10 + "</a></div>")
    M.select(body)
    div = body.children[0]
    base = math.log(100 / 90 * 10 + 10 / 100 * 100 + math.e)
    assert div.density == pytest.approx(100 / 1 * math.log(100 / 10 * 1 / 1, base))


LONG = "many words stand here and " * 1200


@pytest.mark.parametrize(
    ("before", "after", "language"),
    [
        ("**", "**", "markdown"), ("~~", "~~", "markdown"), ("[", "](http://x.y)", "markdown"), ("[", "][1]", "markdown"), ("'''", "'''", "wiki"), ("''", "''", "wiki"), ("[[", "]]", "wiki"), ("[[Page|", "]]", "wiki"),
        ("[[Image:", "]]", "wiki"), ("[http://x.y ", "]", "wiki"), ("[", "|http://x.y]", "wiki"), ("[label|http://", "]", "wiki"), ("{{", "}}", "wiki"), ("{{x|", "}}", "wiki"), ("<code>", "</code>", "html"), ("<tt>", "</tt>", "html"),
        ("\\\\[", "\\\\]", "latex"), ("\\\\(", "\\\\)", "latex"), ("\\\\begin{align}", "\\\\end{align}", "latex"), ("$\\\\alpha ", "$", "latex"),
    ],
)
def test_marks_enclose_any_length(before, after, language):
    inner = LONG.strip()
    got = M.clean(f"See {before}{inner}{after} now.")
    assert got.languages == [language]
    assert before + inner not in got.text or language == "latex"
    assert M.clean(f"See {before}short text{after} now.").languages == [language]
    if language in ("html", "latex"):  # nothing inside is read as a mark
        assert M.clean(f"See {before}{inner} == a **b** '''c'''{after} now.").languages == [language]


def test_long_sentence_is_no_program_text():
    text = f"limit = all that is left, {LONG}and no more."
    assert M.clean(text).code_blocks == 0 and M.clean(text).text == text
    assert M.clean("limit = all that is left.").code_blocks == 0
    assert M.clean(f"limit = [{'1, ' * 3000}2]").code_blocks == 1


def test_open_marks_take_linear_time():
    import time

    for hard in ("[", "[[", "[[Image:", "[a|", "[a|http://b ", "[a](", "[a][", "''", "*a ", "~~a ", "$a ", "\\\\(", "\\\\[", "<code>", "<code ", "\\\\begin{math}", "x = aaa bbb ccc ", "[[a|b|c "):
        began = time.process_time()
        assert M.clean(hard * (40_000 // len(hard))).text is not None
        assert time.process_time() - began < 10, hard


@pytest.mark.parametrize("code", ["{code}x{code}", "{noformat}\nx\n{noformat}", "{code:java}\nx{code}"])
def test_text_after_wiki_code_stays(code):
    got = M.clean(f"{code} fails as soon as **it** runs.\n\nMore.")
    assert "fails as soon as it runs." in got.text and "```" in got.text and "More." in got.text
    assert got.languages == ["markdown", "wiki"] and got.code_blocks == 1


def test_odd_texts():
    assert M.clean(None) is None
    assert M.clean("").text == ""
    deep = "<div>" * 3000 + "inner" + "</div>" * 3000
    assert "inner" in M.clean(deep).text
    assert M.clean("```\nnever closed").languages == ["markdown"]
    assert M.clean("{{{\nnever closed").languages == ["wiki"]
    assert "word" in M.clean("word " * 100_000).text
    for hard in ("[", "{{", "''", "*a", "\\(", "<code>", "x = aaa bbb ccc ", "$a", "| "):
        assert M.clean(hard * 4_000).text is not None
    assert M.clean("</p></td>").languages == ["html"]


def test_table_of_texts(spark):
    rows = [("a", "# H"), ("b", None), ("c", ""), ("a", "# H")]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("l", F.lit(1)).withColumn("languages", F.lit("x"))
    got = sorted((r["k"], tuple(r["languages"])) for r in M.clean_texts(df, "k", "t").collect())
    assert got == [("a", ("markdown",)), ("a", ("markdown",)), ("c", ())]
    assert M.clean_texts(df.limit(0), "k", "t").count() == 0


def test_valid_statement_is_the_latest(spark):
    import datetime as dt

    t = [dt.datetime(2024, 1, i + 1) for i in range(3)]
    df = spark.createDataFrame([("a", "old", t[0]), ("a", "new", t[2]), ("a", "new", t[2]), ("a", "none", None), (None, "x", t[0]), ("b", None, t[0])], "instance_id string, problem_statement string, ingested_at timestamp")
    assert sorted(map(tuple, M.valid_statements(df).collect()), key=str) == [("a", "new"), ("b", None)]


# ---- residue

GOOD = "The retry loop in io/x.py treats 502 Bad Gateway as fatal after 3 attempts."


@pytest.mark.parametrize(
    ("segment", "kind"),
    [
        ("Hello {{ name }}, thank you.", R.SLOT), ("Owner: ${owner}", R.SLOT), ("Dear [FIRST NAME],", R.SLOT), ("Build XXXX of branch _____", R.SLOT), ("Titel: <title here>", R.SLOT), ("by __AUTHOR__ on %DATE%", R.SLOT),
        ("In %(x)s wird die Klasse #{y} erzeugt.", R.SLOT), ("The docs of a_b use ${name} as the placeholder.", R.CONTENT), ("The string '<%= x %>' is never passed on by run_it.", R.CONTENT),
        ("a_b leaves {{ x }} in the page instead of nothing.", R.CONTENT), ("It calls __init__ and __repr__ of the class twice.", R.CONTENT),
        ("Paste the log here.", R.HINT), ("What did you do?", R.HINT), ("Lorem ipsum dolor sit amet.", R.FILLER), ("blah blah blah", R.FILLER), ("test test 123 test Content coming soon.", R.FILLER),
        ("404 Not Found", R.NOTICE), ("You need to enable JavaScript to run this app.", R.NOTICE), ("Zugriff verweigert!", R.NOTICE), ("Page introuvable.", R.NOTICE), ("Servicio en mantenimiento, vuelva más tarde", R.NOTICE),
        (GOOD, R.CONTENT), ('The message "Too many requests" hides the real cause in a_b.', R.CONTENT), ("Skip to content", R.NEUTRAL), ("Request id: 12ab34cd", R.NEUTRAL), ("Environment:", R.NEUTRAL),
    ],
)
def test_segments(spark, segment, kind):
    """What a message is if it recurs widely."""
    rows = [(i, segment, "ab"[i % 2]) for i in range(4)]
    parts = R.classified(spark.createDataFrame(rows, "id int, t string, s string"), "id", "t", "s").collect()
    kinds = {r["class"] for r in parts}
    assert kinds == {kind} if len(parts) == 4 else kind in kinds and R.CONTENT not in kinds


def test_masking(spark):
    one, two = "Error 17 at 2024-01-02T03:04:05Z from a@b.de, see https://x.y/z!", "error 9 at 2023-11-12 from c@d.org, see http://q/w"
    df = spark.createDataFrame([(one,), (two,), ("404 not found",), ("502 not found",)], "t string")
    got = [r[0] for r in df.select(F.transform(R.messages(F.col("t")), R.normal)).collect()]
    assert got[0] == got[1] == ["error 0 at 0 from @, see @"] and got[2] != got[3]


PAGES = [
    "HTTP Status 404 – Not Found", "The requested resource [/app] is not available", "502 Bad Gateway\nnginx/1.18.0 (Ubuntu)", "HTTP Error 400. The request hostname is invalid",
    "Please complete the security check to access example.com", "Die angeforderte Seite existiert nicht", "Cette page n'existe plus", "La page demandée est introuvable", "La página solicitada no existe",
    "This site doesn't work properly without JavaScript enabled.", "Redirecting...\nEnable JavaScript and cookies to continue", "Hmm. We're having trouble finding that site.", "Your connection is not private",
    "Dear [Customer Name], your ticket [ticket number] is open.", "### Describe the bug\nA clear and concise description of what the bug is.\n\n### Steps to reproduce\n1.\n2.\n\n### Expected behavior\n",
]
OWN = [
    "The build puts it in ${HOME}/bin for every user.", "The price in $usd and the vector x_{n} are stored.", "See [name](http://x) and a[id] for it.", "The page was broken in 3.2 and we fixed it.",
    "Discussion cannot be shown.", "Tell us which release you run.", "Content coming soon.",
]


def test_pages_need_no_recurrence_and_own_words_do(spark):
    df = spark.createDataFrame(list(enumerate(PAGES + OWN)), "id int, t string").withColumn("s", F.lit("a"))
    got = {r["id"] for r in R.without_content(R.classified(df, "id", "t", "s"), "id").collect()}
    assert got == set(range(len(PAGES)))


def test_recurrence_decides(spark):
    def cases(rows, **how):
        df = spark.createDataFrame(rows, "id int, t string, s string")
        return {r["id"] for r in R.without_content(R.classified(df, "id", "t", "s", **how), "id").collect()}

    rows = [(i, f"Discussion {i} cannot be shown.", "ab"[i % 2]) for i in range(3)]
    assert cases(rows) == {0, 1, 2} and cases(rows, recurrence=False) == set()
    assert cases([(i, t, "a") for i, t, _ in rows]) == set()  # one source
    assert cases(rows[:2]) == set()  # two documents
    assert cases([(i, t, None if s == "a" else s) for i, t, s in rows]) == {0, 1, 2}  # null is a source


def test_long_odd_texts(spark):
    hard = ["[", "{{", "''", "*a", "\\(", "<code>", "x = aaa bbb ccc ", "$a", "| ", "- ", "a.b@", "tbd ", "<p ", "1.", "0-", "please ", "%a", " \u00a0"]
    df = spark.createDataFrame([(i, h * 20_000) for i, h in enumerate(hard)], "id int, t string").withColumn("s", F.lit("a"))
    began = time.time()
    R.without_content(R.classified(df, "id", "t", "s"), "id").collect()
    assert time.time() - began < 60


def test_documents(spark):
    rows = [
        (1, "Page not found.\n\nReturn to the start page.", "a"), (2, f"Page not found.\n\n{GOOD}", "b"), (3, None, "a"), (4, "", "a"), (5, "Notes\n---\nPaste the log here.", None),
        (6, f"{GOOD} Ask {{{{ owner }}}} about it.", "a"), (7, "Notes", "a"), (8, "Sapien vestra ludit amet dolor gravis. Pulcra semper mare nihil.", "b"), (9, GOOD, "b"),
        (10, "Die Funktion liegt zwei Schritte vom ersten Treffer entfernt.", "a"), (11, GOOD * 3000, "a"), (None, "Page not found.", "a"),
    ]
    rows += [(100 + i, f"The mirror is unavailable for now, code {i}.", "ab"[i % 2]) for i in range(6)]
    rows += [(200, "The old hall is unavailable for all guests this week.", "a")]
    df = spark.createDataFrame(rows, "id bigint, t string, s string").withColumn("_h", F.lit(1)).withColumn("message", F.lit("x")).withColumn("class", F.lit(3))
    parts = R.classified(df, "id", "t", "s")
    got = {r["id"]: r["class"] for r in R.without_content(parts, "id").collect()}
    assert got == {1: R.NOTICE, 5: R.HINT, 6: R.SLOT, 8: R.FILLER} | {100 + i: R.NOTICE for i in range(6)}
    assert R.without_content(R.classified(df.limit(0), "id", "t", "s"), "id").count() == 0
