"""Markup residue: clean text with its structure, and the kinds of markup a text holds.

A text is scanned for constructs of HTML, Markdown, wiki and LaTeX; formulas between dollar signs,
\\( \\) and \\[ \\] are content. The construct that begins first owns what lies inside it, so marks of
another kind there do not count. What is left falls into blocks, each with the constructs that stand in it, and the
blocks are classified in two passes. Pass one decides by stop-word density, length and link density: bad (mostly
links), good (long enough prose, code, formula, table), near and short; and a block with an unmistakable construct is
decided to be of its kind. Ambiguous are lists of stars that run on from a text (wiki or Markdown) and single
letters or numbers between stars or underscores (emphasis or running text). In pass two near and short blocks
take the label of the nearest decided neighbour, the better one of two as near; headings that of the block below;
ambiguous constructs take the kind of their own block or else of the nearest decided one, and count for nothing where
that has none of theirs. The kinds of a text are those of its blocks after pass two; bad blocks are left out of the
clean text of marked texts; a text without markup comes out unchanged.

Clean text: headings as "# ", list items as "- ", code between fences, formulas as they are, table cells
joined by " | ", blocks parted by blank lines.

Defined cases: a null text has null clean text and no kinds; an empty one stays empty; an unclosed
construct counts only if its opening mark alone is unmistakable (tags, commands, fences); repeated rows
count once; other columns are ignored. Each text is read whole, in time linear in its length: a construct ends
before the next one of its sort opens, blocks are swept once in either direction.
"""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")
#: Control characters that set blocks and links apart inside.
CONTROL = re.compile(r"[\f\x0e-\x11]")
#: A formula in dollars has no blank just inside them and no digit after them, so that two prices are none.
MATH = re.compile(r"\$\$.+?\$\$|\$(?![\s$])[^$\n]*(?:\n[^$\n]+)*(?<![\s\\])\$(?!\d)|\\\((?:(?!\\\().)+?\\\)|(?<!\\)\\\[(?:(?!\\\[).)+?\\\]", re.S)
#: Paths of files, whose backslashes begin no commands.
PATH = re.compile(r"(?<!\w)[A-Za-z]:\\[\w.\\ -]*[\w.]|\\\\\w[\w.-]*(?:\\[\w.-]+)+")

#: Names of HTML elements.
TAGS = "a abbr address article aside b bdi bdo big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav ol option p pre q s samp script section select small source span strike strong style sub summary sup svg table tbody td textarea tfoot th thead time title tr tt u ul var video wbr".split()
#: Text-mode commands of LaTeX with arguments that stay in the text, and without.
TEXT_COMMANDS = "emph textbf textit texttt textsc textrm textsf textsl underline uline enquote mbox footnote chapter section subsection subsubsection paragraph subparagraph title author caption href url".split()
BARE_COMMANDS = "item noindent indent newline newpage clearpage bigskip medskip smallskip par centering label ref eqref cite citep citet pageref maketitle tableofcontents hline vspace hspace usepackage documentclass bibliography index input include LaTeX TeX ldots dots textbackslash qquad quad linebreak pagebreak noalign footnotemark today".split()
STOP_WORDS = frozenset("the of and to is in that we for by this with as it be not are an on at from there which then would a i you or but der die das und ist von mit wir le la les des et est un une que pour dans el los las de y en es se no und".split())

#: Attributes of HTML that need no value.
BARE_ATTRIBUTES = "async autofocus checked compact controls defer disabled hidden loop multiple muted nohref noshade nowrap open readonly required reversed selected"
ATTRIBUTES = rf"""(?:\s+(?:[A-Za-z_:@][\w:.@-]*\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+)|(?:{BARE_ATTRIBUTES.replace(" ", "|")})(?=[\s/>])))*"""


def _upto(name: str) -> str:
    """From an element's start to its own end, before another one of its name begins."""
    return rf"<{name}\b[^<>]*>[^<]*+(?:<(?!/?{name}\b)[^<]*+)*+</{name}\s*>"


P_HTML = re.compile(
    rf"(?P<comment><!--(?:(?!<!--).)*?-->)|(?P<pre>{_upto('pre')})|(?P<code>{_upto('code')})|(?P<raw>{_upto('script')}|{_upto('style')})"
    rf"|(?P<tag></?(?P<name>{'|'.join(TAGS)}){ATTRIBUTES}\s*/?>)|(?P<custom></?(?P<other>[A-Za-z][\w-]*)(?P<attrs>{ATTRIBUTES})\s*/?>)"
    r"|(?P<entity>&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});)|(?P<doctype><!DOCTYPE[^<>]*>)",
    re.S | re.I,
)
CLOSING = re.compile(r"</([A-Za-z][\w-]*)")
P_MD = re.compile(
    r"^(?:(?P<fence>(?P<f>```+|~~~+)[^\n`]*\n.*?(?:^(?P=f)[ \t]*$|\Z))|(?P<atx> {0,3}#{1,6}[ \t]+[^\n]+)|(?P<setext>(?=[^\n]*\w)[^\n]++\n(?:={3,}|-{3,})[ \t]*$)"
    r"|(?P<table>(?=[^\n]*\|)[^\n]++\n[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$(?:\n[^\n]*\|[^\n]*)*)|(?P<quote> {0,3}>(?:[ \t][^\n]*|$)(?:\n>[^\n]*)*)"
    r"|(?P<list>(?:^[ \t]*(?:[-*+])[ \t]+\S[^\n]*(?:\n|\Z))+)|(?P<ordered>(?:^[ \t]*\d{1,3}[.)][ \t]+\S[^\n]*(?:\n|\Z)){2,})|(?P<rule>(?:-{3,}|\*{3,}|_{3,}|(?:\* ){2,}\*)[ \t]*$)|(?P<linkdef> {0,3}\[[^\[\]\n]+\]:[ \t]+\S+[^\n]*))"
    r"|(?=[!\[<`*_~])(?:(?P<image>!\[[^\[\]\n]*\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\))|(?P<link>\[(?:[^\[\]\n]|\[[^\[\]\n]*\])+\]\([^()\s]+(?:[^()\n]|\([^()\n]*\))*\)|\[[^\[\]\n]+\]\[[^\[\]\n]*\](?!\]))|(?P<auto><https?://[^<>\s]+>)"
    r"|(?P<code>(?<!`)`(?!`)[^`\n]+`(?!`)|``(?!`)(?:(?!'')[^`\n])*``(?!`))|(?P<bold>\*\*(?=[^\s*])(?:[^*\n]|\n(?!\n)|(?<=\s)\*(?=\s))*?(?<=[^\s*])\*\*(?!\*))|(?P<bold2>(?<![\w_])__(?=[^\s_])(?![A-Z]{3,}__)(?:(?!\W__[^\s_])[^\n])*?(?<=[^\s_])__(?![\w_]))"
    r"|(?P<strike>~~(?=[^\s~])(?:[^~\n]|\n(?!\n))*?(?<=[^\s~])~~(?!~))|(?P<em>(?<![\w*\\])\*(?=[^\s*])(?:[^*\n]|\n(?!\n))*?(?<=[^\s*])\*(?![\w*]))|(?P<em2>(?<![\w_\\])_(?=[^\s_])[^_\n]*?(?<=[^\s_])_(?![\w_])))",
    re.S | re.M,
)
P_WIKI = re.compile(
    r"(?P<table>^[ \t]*\{\|(?:(?!\n[ \t]*\{\|).)*?^[ \t]*\|\}|\{\|[^\n]*\n(?:(?!\n[ \t]*\{\|).)*?\n\|\})|(?P<heading>^={1,6}[ \t]*[^\s=][^=\n]*={1,6}[ \t]*$)|(?P<template>\{\{(?![{\s])[^{}\n]*(?:\n[^{}\n]*)*\}\})"
    r"|(?P<file>\[\[(?:File|Image|Category|Datei|Kategorie|Fichier|Catégorie|Archivo|Categoría)\s*:(?:[^\[\]\n]|\[\[[^\[\]\n]*\]\])*\]\])|(?P<link>\[\[[^\[\]\n]+\]\])|(?P<ext>\[https?://[^\s\[\]]+(?:\s[^\[\]\n]*)?\])"
    rf"|(?P<switch>__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|NEWSECTIONLINK|NOINDEX|INDEX|HIDDENCAT)__)|(?P<ref><ref\b[^<>]*/>|{_upto('ref')}|</?(?:nowiki|references|gallery|math|syntaxhighlight)\b[^<>]*>)"
    r"|(?P<bold>(?<![\w'])'''(?:'')?(?=[^\s'])(?:(?!\s''')[^\n])*?(?<=[^\s'])'''(?:'')?(?![\w']))|(?P<em>(?<![\w'`)\]])''(?=[^\s'(])(?:(?!'')[^\n])*?(?<=[^\s'(])''(?![\w']))",
    re.S | re.M,
)
#: One argument in braces, with braces inside it.
ARG = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
ARG_AT_END = re.compile(r"\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}$")
P_LATEX = re.compile(
    rf"(?P<verb>\\begin\{{(?P<v>verbatim\*?|lstlisting|equation\*?|align\*?|gather\*?|displaymath|tabular)\}}(?:(?!\\begin\{{(?P=v)\}}).)*?\\end\{{(?P=v)\}})|(?P<env>\\(?:begin|end)\{{[A-Za-z]+\*?\}}(?:\[[^\[\]\n]*\])?)"
    rf"|(?P<two>\\(?:textcolor|colorbox|href|hyperref|hypertarget|hyperlink|parbox|raisebox|resizebox|scalebox|foreignlanguage|fontsize|setlength|newcommand|renewcommand|multicolumn)\*?(?:\[[^\[\]\n]*\])?{ARG}(?:\[[^\[\]\n]*\])?{ARG}(?:{ARG})?)"
    rf"|(?P<arg>\\(?P<cmd>{'|'.join(TEXT_COMMANDS)})\*?(?:\[[^\[\]\n]*\])?\{{(?P<inner>[^{{}}]*(?:\{{[^{{}}]*\}}[^{{}}]*)*)\}})|(?P<bare>\\(?P<cmd2>{'|'.join(BARE_COMMANDS)})(?![A-Za-z])\*?(?:\[[^\[\]\n]*\])?(?:\{{[^{{}}\n]*\}})?)"
    r"|(?P<group>\{\\(?:it|bf|em|tt|sc|rm|sf|sl|small|large|Large|footnotesize|tiny|huge|Huge|itshape|bfseries|scshape|ttfamily|normalsize|scriptsize)(?![A-Za-z])[^{}]*\})|(?P<quote>``(?=[^\s`])(?:(?!''|\n\n)[^`])*?'')"
    r"|(?P<br>\\\\(?:\[[^\[\]\n]*\])?)|(?P<comment>(?<=\n)%[^\n]*)|(?P<esc>\\[%&#_](?![A-Za-z]))|(?P<other>\\[A-Za-z]{2,}\*?\{[^{}\n]*\})|(?P<lone>(?<![\w\\])\\[a-z]{4,}(?=[\s.,;:)]|$))",
    re.S,
)
#: Marks without which the scan of a kind can find nothing.
MAY_HTML = re.compile(r"<[A-Za-z/!]|&[#A-Za-z0-9]+;")
MAY_MD = re.compile(r"`|~~|\*\S|__|(?<!\w)_\S|\]\(|\]\[|\]:|<http|^ {0,3}(?:#{1,6}[ \t]|>|[-+*][ \t]|[-*_=]{3})|^[ \t]+[-+*][ \t]|^[ \t]*\d{1,3}[.)][ \t]|--|\|[ \t]*:?-", re.M)
MAY_WIKI = re.compile(r"\[\[|\{\{|\{\||(?<![\w'])''|^=|__[A-Z]|\[http|<(?:ref|nowiki|/|gallery|math|syntax)", re.M)
MAY_LATEX = re.compile(r"\\[A-Za-z\\%&#_]|``|\n%")


#: Markdown blocks whose text is open to further constructs, and the text of one of their lines.
OPEN = frozenset(("quote", "list", "ordered", "atx"))
LINE = re.compile(r"^[ \t]*(?:[-+*]|\d{1,3}[.)]|#{1,6}|>)?[ \t]*([^\n]+)", re.M)
#: Constructs that stand on lines of their own.
ON_LINES = frozenset(("fence", "setext", "table", "rule", "linkdef", "heading", "verb", "env"))


class Construct:
    __slots__ = ("start", "end", "kind", "what", "m")

    def __init__(self, kind: str, what: str, m: re.Match):
        self.start, self.end, self.kind, self.what, self.m = m.start(), m.end(), kind, what, m


#: Ambiguous constructs: a single letter that is no word, or a number, between the marks of emphasis.
WEAK = re.compile(r"(?:\*|_)[\W_]*(?:[b-zB-HJ-Z]|\d+)[\W_]*(?:\*|_)")


def _named(kind: str, names: tuple[str, ...], m: re.Match) -> Construct:
    return Construct(kind, next(k for k in names if m.group(k) is not None), m)


HTML_SORTS = ("comment", "pre", "code", "raw", "tag", "custom", "entity", "doctype")
LATEX_SORTS = ("verb", "env", "two", "arg", "bare", "group", "quote", "br", "comment", "esc", "other", "lone")


def _html(shown: str) -> list[Construct]:
    """Tags need attributes that look like such; an unknown one, or one that follows a letter at once (`List<i>`), its end tag."""
    closing = {m[1].lower() for m in CLOSING.finditer(shown)}
    out = []
    for m in P_HTML.finditer(shown):
        c = _named("html", HTML_SORTS, m)
        name = (m["name"] or m["other"] or "").lower()
        bare = c.what == "custom" or (c.what == "tag" and m[0][1] != "/" and m[0][-2:] != "/>" and shown[m.start() - 1 : m.start()].isalnum() and len(name) == 1 and " " not in m[0])
        if not (bare and name not in closing):
            out.append(c)
    return out


def constructs(text: str) -> tuple[list[Construct], str]:
    """Outermost constructs in order, and the text with its formulas masked."""
    shown = MATH.sub(lambda m: "\ue000" * len(m[0]), text) if "$" in text or "\\(" in text or "\\[" in text else text
    if ":\\" in shown or "\\\\" in shown:
        shown = PATH.sub(lambda m: "\ue001" * len(m[0]), shown)
    found: list[Construct] = []
    if MAY_HTML.search(shown):
        found += _html(shown)
    if MAY_MD.search(shown):
        for m in P_MD.finditer(shown):
            found.append(Construct("markdown", "fence" if m["fence"] is not None else m.lastgroup, m))
            if m.lastgroup in OPEN:
                for line in LINE.finditer(shown, m.start(), m.end()):
                    found += [Construct("markdown", x.lastgroup, x) for x in P_MD.finditer(shown, line.start(1), line.end())]
    if MAY_WIKI.search(shown):
        found += [Construct("wiki", m.lastgroup, m) for m in P_WIKI.finditer(shown)]
    if MAY_LATEX.search(shown):
        found += [_named("latex", LATEX_SORTS, m) for m in P_LATEX.finditer(shown)]
    found.sort(key=lambda c: (c.start, -c.end))
    out: list[Construct] = []
    end = 0
    for c in found:
        if c.start >= end:
            out.append(c)
            end = c.end
            if c.what in OPEN and c.kind != "latex":
                end = c.start + 1  # their text is open to further constructs
    return out, shown


def ambiguous(c: Construct) -> tuple[str, ...]:
    """The kinds an ambiguous construct may be of; empty if it is unmistakable."""
    if c.kind == "markdown" and c.what == "list":
        text = c.m.string
        runs_on = c.start and not text.endswith("\n\n", 0, c.start)  # Markdown sets lists apart by a blank line
        return ("markdown", "wiki") if c.m[0].lstrip()[:1] == "*" and (runs_on or not c.m[0].strip(" \t\n*").strip()) else ()
    return (c.kind,) if c.what in ("em", "em2") and WEAK.fullmatch(c.m[0]) else ()


def markup_kinds(text: str | None) -> list[str]:
    return residue(text)[0]


def _plain(text: str) -> str:
    """The text a construct keeps, without the constructs inside it."""
    out, at = [], 0
    for c in constructs(text)[0]:
        if (c.what in OPEN and c.kind != "latex") or c.what in ON_LINES or c.start < at:
            continue
        out += [text[at : c.start], _inner(c, text)]
        at = c.end
    return "".join([*out, text[at:]])


LINK_TEXT = re.compile(r"\[((?:[^\[\]]|\[[^\[\]]*\])*)\]")


def _inner(c: Construct, text: str) -> str:
    """What a construct leaves in the clean text; blocks are set apart by form feeds and a letter for their type."""
    raw, m, w = text[c.start : c.end], c.m, c.what
    block = lambda t, s: f"\f{t}{s.strip(chr(10))}\f\n"
    if c.kind == "html":
        name = (m["name"] or "").lower()
        if w in ("comment", "raw", "doctype"):
            return ""
        if w == "entity":
            return html.unescape(raw)
        if w == "custom":
            return ""
        if w == "pre":
            return block("C", html.unescape(re.sub(r"<[^>]+>", "", raw)))
        if w == "code":
            return html.unescape(re.sub(r"<[^>]+>", "", raw))
        if re.fullmatch("h[1-6]", name):
            return "\f\n" if raw.startswith("</") else "\fH"
        if name == "li":
            return "\f\n" if raw.startswith("</") else "\fL"
        if name == "a":
            return "\x0f" if raw.startswith("</") else "\x0e"
        if name in ("td", "th"):
            return " | " if raw.startswith("</") else ""
        if name in ("p", "div", "blockquote", "ul", "ol", "table", "tr", "hr", "section", "article", "dl", "dt", "dd"):
            return "\f\n"
        return "\n" if name == "br" else ""
    if c.kind == "latex":
        if w == "verb":
            body = re.sub(r"^\\begin\{[^}]*\}|\\end\{[^}]*\}$", "", raw)
            return block("F" if m["v"][:3] in ("equ", "ali", "gat", "dis") else "C", body)
        if w == "env" or w in ("comment",):
            return "\f\n"
        if w == "arg":
            inner, cmd = _plain(text[m.start("inner") : m.end("inner")]), m["cmd"]
            if cmd in ("chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph", "title"):
                return block("H", inner)
            return f" ({inner})" if cmd == "footnote" else inner
        if w == "two":
            return "" if re.match(r"\\(?:fontsize|setlength|(?:re)?newcommand)", raw) else _plain(re.search(ARG_AT_END, raw)[1])
        if w == "lone":
            return ""
        if w == "bare":
            return "\f\n\fL" if m["cmd2"] == "item" else "…" if m["cmd2"] in ("ldots", "dots") else ""
        if w == "group":
            return _plain(re.sub(r"^\{\\[A-Za-z]+\s*|\}$", "", raw))
        if w == "quote":
            return f"“{_plain(raw[2:-2])}”"
        if w == "esc":
            return raw[1:]
        return "\n" if w == "br" else _plain(raw[raw.index("{") + 1 : -1])
    if c.kind == "wiki":
        if w == "table":
            rows = [re.sub(r"\s*(?:\|\||!!)\s*", " | ", _plain(x.strip().lstrip("|!").strip())) for x in raw.split("\n")[1:-1] if not x.strip().startswith("|-")]
            return block("T", "\n".join(rows))
        if w == "heading":
            return block("H", _plain(raw.strip().strip("=").strip()))
        if w == "template":
            parts = raw[2:-2].split("|")
            return parts[-1] if parts[0].strip() in ("math", "mvar", "lang", "nowrap") and len(parts) > 1 else ""
        if w in ("link", "ext"):
            return "\x0e" + _plain(raw[2:-2].split("|")[-1] if w == "link" else raw[1:-1].partition(" ")[2]) + "\x0f"
        if w in ("bold", "em"):
            return _plain(raw.strip("'"))
        return ""
    if w == "fence":
        return block("C", "\n".join(x for k, x in enumerate(raw.rstrip().split("\n")) if k and not re.fullmatch(r"\s*(?:```+|~~~+)\s*", x)))
    if w == "setext":
        return block("H", _plain(raw.split("\n")[0]))
    if w == "table":
        rows = [_plain(x.strip().strip("|").strip()) for x in raw.split("\n")]
        return block("T", "\n".join(re.sub(r"\s*\|\s*", " | ", x) for k, x in enumerate(rows) if k != 1))
    if w in ("image", "rule", "linkdef"):
        return block("R", " ") if w == "linkdef" else ""
    if w == "link":
        return "\x0e" + _plain(LINK_TEXT.match(raw)[1]) + "\x0f"
    if w == "code":
        return raw.strip("`")
    return _plain(raw.strip("*_~")) if w in ("bold", "bold2", "strike", "em", "em2") else raw


#: Marks the place of a construct, by its number, in the text of its block.
PLACE = re.compile("\x10(\\d+)\x11")
HEADING, ITEM, QUOTATION = re.compile(r"#{1,6}\s+(.*?)\s*#*$"), re.compile(r"(?:[-*+]|\d{1,3}[.)])\s+(\S.*)$"), re.compile(r"^>\s?")


def blocks(text: str, cs: list[Construct] | None = None) -> list[dict]:
    """Blocks of a marked text: type (paragraph, heading, list, code, table, formula, mark), text, the numbers of its
    constructs, label of both passes, kinds."""
    text = CONTROL.sub(" ", text)
    cs = constructs(text)[0] if cs is None else cs
    out, at = [], 0
    for k, c in enumerate(cs):
        if c.start < at:
            continue
        place = f"\x10{k}\x11"
        if c.what in OPEN and c.kind != "latex":
            out += [text[at : c.start], place]
            at = c.start
            continue
        inner = _inner(c, text)
        head = 2 if inner[:1] == "\f" else 0
        out += [text[at : c.start], inner[:head], place, inner[head:]]
        at = c.end
    flat = "\f\n" + "".join([*out, text[at:]])
    got: list[dict] = []
    for piece in flat.split("\f")[1:]:  # each begins with the letter of its type or a line break
        kind, body = (piece[:1], piece[1:]) if piece[:1] in tuple("HLCTFPR") else ("P", piece)
        for para in [body] if kind in "CTF" else re.split(r"\n[^\S\n]*\n", body):
            if not para.strip():
                continue
            if kind == "R":  # where links lead, no text
                got.append({"type": "mark", "text": "", "at": _places(para)[0]})
                continue
            if kind == "P":
                got += _lines(para)
                continue
            at, bare = _places(para)
            if kind in "CTF" and bare.strip():
                got.append({"type": {"C": "code", "T": "table", "F": "formula"}[kind], "text": bare.strip("\n"), "at": at})
            else:
                bare = " ".join(bare.split())
                got.append({"type": ("heading" if kind == "H" else "list") if bare else "mark", "text": bare, "at": at})
    return classify(got, cs)


def _places(t: str) -> tuple[list[int], str]:
    return ([int(k) for k in PLACE.findall(t)], PLACE.sub("", t)) if "\x10" in t else ([], t)


def _lines(para: str) -> list[dict]:
    """A paragraph's lines, with Markdown headings, list items and quotations told apart."""
    out: list[dict] = []
    for line in para.split("\n"):
        at, s = _places(line)
        s = s.strip()
        if m := HEADING.match(s):
            out.append({"type": "heading", "text": m[1], "at": at})
        elif m := ITEM.match(s):
            out.append({"type": "list", "text": m[1], "at": at})
        elif s:
            s = QUOTATION.sub("", s)
            if out and out[-1]["type"] == "paragraph":
                out[-1]["lines"].append(s)
                out[-1]["at"] += at
            elif s:
                out.append({"type": "paragraph", "lines": [s], "at": at})
            elif at:
                out.append({"type": "mark", "text": "", "at": at})
        elif at:
            if out:
                out[-1]["at"] += at
            else:
                out.append({"type": "mark", "text": "", "at": at})
    for b in out:
        if "lines" in b:
            b["text"] = "\n".join(b.pop("lines"))
    return out


LINKED, LETTERS = re.compile(r"\x0e([^\x0f]*)\x0f?"), re.compile(r"[^\W\d_]+")
IS_MATH = re.compile(r"\$|\\\(|\\\[")


def _nearest(held: list) -> list[tuple[float, object]]:
    """For each place the distance to, and the value at, the nearest earlier place whose value is not empty."""
    out, last, value = [], -1, None
    for k, v in enumerate(held):
        out.append((k - last, value) if value else (math.inf, None))
        if v:
            last, value = k, v
    return out


def classify(got: list[dict], cs: list[Construct] | None = None, short: int = 40, long: int = 120, stop_low: float = 0.1, stop_high: float = 0.25, links: float = 0.5) -> list[dict]:
    """Pass one and two of the block rules: labels and kinds of blocks."""
    for b in got:
        linked = sum(len(x) for x in LINKED.findall(b["text"])) if "\x0e" in b["text"] else 0
        t = b["text"].replace("\x0e", "").replace("\x0f", "")
        words = LETTERS.findall(t.lower())
        density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
        share = linked / len(t) if t else 0.0
        if b["type"] == "mark":
            label = ""
        elif b["type"] in ("code", "table", "formula"):
            label = "good"
        elif share > links:
            label = "bad"
        elif b["type"] != "heading" and IS_MATH.search(t):
            label = "good"  # formulas are content
        elif len(t) < short or b["type"] == "heading":
            label = "short"
        elif density >= stop_high or (len(t) > long and density >= stop_low):
            label = "good"
        else:
            label = "near"
        sure = {cs[k].kind for k in b.get("at", ()) if not ambiguous(cs[k])}
        b |= {"text": t, "first": label, "label": label, "stop_density": density, "link_density": share, "kinds": sure}
    firm = [b["first"] if b["first"] in ("good", "bad") else "" for b in got]
    marked = [b["kinds"] for b in got]
    before, after = _nearest(firm), _nearest(firm[::-1])[::-1]
    kind_before, kind_after = _nearest(marked), _nearest(marked[::-1])[::-1]
    named: list[set] = []
    for k, b in enumerate(got):
        (d, left), (e, right) = before[k], after[k]
        if b["first"] in ("short", "near"):
            if b["type"] == "heading":
                b["label"] = right or left or "good"
            else:
                b["label"] = "good" if not (left or right) or (d == e and "good" in (left, right)) else left if d <= e else right
        own = b["kinds"]
        (d, left), (e, right) = kind_before[k], kind_after[k]
        near = own or (left if d <= e else right) or set()
        kinds = set(own)
        for c in (cs[n] for n in b.get("at", ())):
            may = ambiguous(c)
            kinds |= {next((x for x in reversed(may) if x in near), may[0])} if len(may) > 1 else {x for x in may if x in near}
        named.append(kinds)
    for b, kinds in zip(got, named, strict=True):
        b["kinds"] = kinds
    return got


def clean_text(text: str | None) -> str | None:
    return residue(text)[1]


def residue(text: str | None) -> tuple[list[str], str | None]:
    """Kinds of markup in a text and its clean text, from one scan and both passes over its blocks."""
    if not text:
        return [], text
    cs = constructs(CONTROL.sub(" ", text))[0]
    if not cs:
        return [], text
    got = blocks(text, cs)
    has = set().union(*(b["kinds"] for b in got))
    if not has:
        return [], text
    out: list[str] = []
    last = ""
    for b in got:
        if b["label"] == "bad" or b["type"] == "mark":
            continue
        t = {"heading": f"# {b['text']}", "list": f"- {b['text']}", "code": f"```\n{b['text']}\n```"}.get(b["type"], b["text"].strip())
        if b["type"] == "paragraph":
            t = "\n".join(" ".join(x.split()) if "$" not in x else x.strip() for x in t.split("\n"))
        out.append(("\n" if last == b["type"] == "list" else "\n\n" if out else "") + t)
        last = b["type"]
    return [k for k in KINDS if k in has], "".join(out)


def markup_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with markup_kinds (array) and clean_text, one pass in Arrow batches."""

    @F.pandas_udf("struct<markup_kinds:array<string>,clean_text:string>")
    def both(ts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([residue(t if isinstance(t, str) else None) for t in ts], columns=["markup_kinds", "clean_text"], dtype=object)

    made = both.asNondeterministic()(F.col(text))  # else a filter inferred for a later explode runs it again
    return texts.select("*", made.alias("_m")).select("*", "_m.markup_kinds", "_m.clean_text").drop("_m")


def kinds_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts without the text, with one row per markup_kind."""
    made = markup_of(texts, text)
    return made.select(*[c for c in texts.columns if c != text], F.explode("markup_kinds").alias("markup_kind"))


def fields_of(judge_pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """table_name, topic_id, answer_id, field_name, text of all text fields, narrow."""
    one = lambda df, t, topic, key, f: df.select(F.lit(t).alias("table_name"), topic.alias("topic_id"), F.col(key).alias("answer_id"), F.lit(f).alias("field_name"), F.col(f).alias("text"))
    j = F.col("topic_id")
    return one(judge_pairs, "judge_pairs", j, "answer_id", "question").unionByName(one(judge_pairs, "judge_pairs", j, "answer_id", "answer_text")).unionByName(one(answers, "answers", F.lit(""), "id", "body_text")).filter("text IS NOT NULL")
