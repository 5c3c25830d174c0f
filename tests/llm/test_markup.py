"""Markup kinds and clean text."""

import time

import pytest

from sumac.llm import markup
from sumac.llm.markup import blocks, classify, clean_text, fields_of, kinds_of, markup_kinds, markup_of, residue

PLAIN = [
    "The product 2 * 426 * 419 and a < b and c > d in plain text.",
    "Here snake_case_9 and x_1 * x_2 = 73 and n^422 ~ 48.621 are names.",
    "The function f''(x) - 276 f'(x) from exercise #428 is [402] well defined.",
    "The R&D script prints x == y for all; the #P-complete case needs |x - y| < 2.",
    "Formulas $a_1 * b_2 ** c$ and $$\\emph{x} <b>$$ and \\(`x`\\) are content.",
]
MARKED = [
    ("<p>So <b>it</b> is.</p>", ["html"]),
    ("a &lt; b", ["html"]),
    ("See<!-- edited --> this", ["html"]),
    ("It is **bold** here", ["markdown"]),
    ("How *should* one", ["markdown"]),
    ("a `b_c` d", ["markdown"]),
    ("x\n\n~~~\na = b * c\n~~~\n", ["markdown"]),
    ("Title\n=====\n\ntext", ["markdown"]),
    ("| n | v |\n|---|:---:|\n| 1 | 2 |", ["markdown"]),
    ("See [this][1].\n\n[1]: /q/1", ["markdown"]),
    ("text\n\n* one\n* two\n", ["markdown"]),
    ("__NOTOC__ text", ["wiki"]),
    ("'''After counting''' both", ["wiki"]),
    ("the [[level]] of {{cite|A|2011}}", ["wiki"]),
    ("\n== Heading ==\ntext", ["wiki"]),
    ("{| class=\"w\"\n|-\n! n !! v\n|-\n| 4 || 84\n|}", ["wiki"]),
    ("why \\emph{is} it ``closed'' under limits", ["latex"]),
    ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["latex"]),
    ("see~\\ref{eq:1} and {\\it part of} it", ["latex"]),
    ("<i>a</i> and **b** and [[c]] and \\textbf{d}", ["html", "markdown", "wiki", "latex"]),
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_texts_are_left(text):
    assert markup_kinds(text) == [] and clean_text(text) == text


@pytest.mark.parametrize(("text", "kinds"), MARKED)
def test_kinds(text, kinds):
    assert markup_kinds(text) == kinds


def test_inside_another_construct_does_not_count():
    assert markup_kinds("<pre><code>a ** b ** [[c]]</code></pre>") == ["html"]
    assert markup_kinds("```\n<b>x</b> \\emph{y}\n```") == ["markdown"]


def test_structure_is_kept():
    t = "<h2>Ring</h2><ul><li>one</li><li>two</li></ul><pre><code>if a &lt; 1:\n    b</code></pre><p>So $x^2$ &amp; more.</p>"
    assert clean_text(t) == "# Ring\n\n- one\n- two\n\n```\nif a < 1:\n    b\n```\n\nSo $x^2$ & more."
    assert clean_text("\\section{Ring} Then \\emph{it} holds.\n\\begin{enumerate}\n\\item a\n\\item b\n\\end{enumerate}") == "# Ring\n\nThen it holds.\n\n- a\n- b"
    assert clean_text(None) is None and clean_text("") == ""


def test_two_passes():
    got = classify([{"type": "paragraph", "text": "\x0eHome\x0f \x0eAbout us\x0f"}, {"type": "paragraph", "text": "Print"}, {"type": "paragraph", "text": "\x0eLog in\x0f"}, {"type": "paragraph", "text": "This is the text of the page that we would like to keep, as it is long enough and has stop words."}])
    assert [(b["first"], b["label"]) for b in got] == [("bad", "bad"), ("short", "bad"), ("bad", "bad"), ("good", "good")]
    assert blocks("<p>x</p>")[0]["type"] == "paragraph"


def test_frames(spark):
    j = spark.createDataFrame([("A.1", "1", "a **b** c", None, 1), ("A.1", "1", "a **b** c", None, 1)], "topic_id string, answer_id string, question string, answer_text string, text int")
    a = spark.createDataFrame([("2", "<b>" + "word " * 50_000 + "</b>"), ("3", None), ("4", "")], "id string, body_text string")
    got = {tuple(r) for r in kinds_of(fields_of(j, a)).distinct().collect()}
    assert got == {("judge_pairs", "A.1", "1", "question", "markdown"), ("answers", "", "2", "body_text", "html")}
    assert markup_of(fields_of(j, a.limit(0)).limit(0)).count() == 0


def test_markup_inside_lines_and_kept_constructs():
    assert residue(": see [[Foo]]") == (["wiki"], ": see Foo")
    assert residue("We use\n* a [[Ring]] and so on\n* the ideal") == (["wiki"], "We use\n\n- a Ring and so on\n- the ideal")
    assert residue("- it is **b** and `c`\n- d") == (["markdown"], "- it is b and c\n- d")
    assert residue("> say *so* now")[1] == "say so now" and residue("# A **b** head")[1] == "# A b head"
    assert residue("\\section{\\emph{x} y}")[1] == "# x y" and residue("{|\n| [[A|b]] || '''c'''\n|}")[1] == "b | c"
    assert residue("It is ``so it is'' in the ring.")[1] == "It is “so it is” in the ring."


NO_MARKUP = [
    "We test if a <b and c> d then stop.", "A List<i> holds them.", "It lies in c:\\temp\\item today.", "Costs $5 and $6 in all.", "The product 2 *3* 4 is small.", "Take a_i and b_j, or _i_ alone.", "f'' and g'' are here",
]
MARKUP = [
    ("See \\textcolor{red}{the x} here.", ["latex"], "See the x here."), ("An <blink>old</blink> tag.", ["html"], "An old tag."), ("A <my-tag a='1'>x</my-tag>.", ["html"], "A x."), ("So \\frobnicate it is.", ["latex"], "So it is."),
    ("Costs $5 <b>bold</b> and $6", ["html"], "Costs $5 bold and $6"), ("A **bold** word and 2 *3* 4.", ["markdown"], "A bold word and 2 3 4."), ("Some <b>x</b> of List<i>.", ["html"], "Some x of List<i>."),
    ("See '''this''' note:\n* first one\n* second one", ["wiki"], "See this note:\n\n- first one\n- second one"), ("See **this** note:\n* first one\n* second one", ["markdown"], "See this note:\n\n- first one\n- second one"),
]


@pytest.mark.parametrize("text", NO_MARKUP)
def test_running_text_is_no_markup(text):
    assert residue(text) == ([], text)


@pytest.mark.parametrize(("text", "kinds", "clean"), MARKUP)
def test_wordings_that_are_not_in_the_data(text, kinds, clean):
    assert residue(text) == (kinds, clean)


def test_short_blocks_inherit_the_nearest_label():
    nav = "<p><a href='/a'>Home and news of the day</a></p><p>Menu</p><p><a href='/b'>Archive of the last year</a></p>"
    prose = "<p>It is known that the ring is closed in the field, and so we have that it is one of them for all that we know of it.</p><p>Menu</p>"
    assert residue(nav)[1] == "" and "Menu" in residue(prose)[1] and residue(prose + nav)[1].count("Menu") == 1


def test_kinds_come_from_the_classified_blocks(monkeypatch):
    text = "See '''this''' note:\n* first one\n* second one"
    monkeypatch.setattr(markup, "classify", lambda got, cs: [b | {"kinds": set(), "label": "good"} for b in got])
    assert residue(text)[0] == []


@pytest.mark.parametrize("part", ["* a *b* [[c]]\n", "<!-- ", "<pre> ", "[[a|", "[a](", "__a ", "'''a ", "\\emph{a ", "{{a ", "<a href='", "{|\n", "$a ", "\\( ", "* a\n\nx\n", "~~a ", "``a ", "= a  ", "<ref> ", "| a\n", "<b a=", "<zz ", "\\a"])
def test_a_megabyte_takes_seconds(part):
    text = part * (1_000_000 // len(part))
    start = time.process_time()
    residue(text)
    assert time.process_time() - start < 20
