"""LaTeX formulas to MathML: a converter of the plain subset, and the hook for any other one.

Presentation markup covers letters, numbers, operators, scripts, fractions, roots, binomials, accents, fences, tables, text and
fonts (which are left out). Content markup covers what a reader of arithmetic takes for certain: sums, products
(also without a sign), quotients, powers, indices, roots, functions before an argument, absolute values, relations and chains of
them. A formula beyond that has no content markup.

Defined cases: null and blank formulas have no markup; unbalanced braces and unknown commands are no error: the braces
close at the end, a command stands as an identifier of its name; a formula of any length is read once, nesting deeper than
DEPTH has no markup.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from html import escape

import pandas as pd
from pyspark.sql import DataFrame

TOKEN = re.compile(r"\\[A-Za-z]+|\\.|[0-9]+(?:[.,][0-9]+)*|[A-Za-z]|\S")
DEPTH = 150
#: Commands and the operators they stand for; Greek letters follow from their names.
OPERATORS = {
    "cdot": "⋅", "times": "×", "div": "÷", "pm": "±", "mp": "∓", "ast": "∗", "star": "⋆", "circ": "∘", "bullet": "∙", "oplus": "⊕", "otimes": "⊗", "wedge": "∧", "vee": "∨", "cap": "∩", "cup": "∪", "setminus": "∖",
    "le": "≤", "leq": "≤", "ge": "≥", "geq": "≥", "ne": "≠", "neq": "≠", "equiv": "≡", "approx": "≈", "sim": "∼", "simeq": "≃", "cong": "≅", "propto": "∝", "ll": "≪", "gg": "≫", "mid": "∣", "nmid": "∤", "parallel": "∥", "perp": "⊥",
    "in": "∈", "notin": "∉", "ni": "∋", "subset": "⊂", "subseteq": "⊆", "supset": "⊃", "supseteq": "⊇", "to": "→", "rightarrow": "→", "leftarrow": "←", "mapsto": "↦", "Rightarrow": "⇒", "Leftarrow": "⇐", "iff": "⇔", "Leftrightarrow": "⇔", "implies": "⇒", "longrightarrow": "⟶",
    "sum": "∑", "prod": "∏", "int": "∫", "iint": "∬", "oint": "∮", "bigcup": "⋃", "bigcap": "⋂", "coprod": "∐", "partial": "∂", "nabla": "∇", "forall": "∀", "exists": "∃", "neg": "¬", "lnot": "¬", "colon": ":", "ldots": "…", "dots": "…", "cdots": "⋯", "vdots": "⋮", "prime": "′",
    "langle": "⟨", "rangle": "⟩", "lfloor": "⌊", "rfloor": "⌋", "lceil": "⌈", "rceil": "⌉", "|": "‖", "Vert": "‖", "vert": "|", "lvert": "|", "rvert": "|", "{": "{", "}": "}", "lbrace": "{", "rbrace": "}", "%": "%", "&": "&", "#": "#", "_": "_", "$": "$",
}
#: Commands that stand for identifiers.
IDENTIFIERS = {"infty": "∞", "emptyset": "∅", "varnothing": "∅", "ell": "ℓ", "hbar": "ℏ", "Re": "ℜ", "Im": "ℑ", "aleph": "ℵ", "varepsilon": "ε", "vartheta": "ϑ", "varphi": "φ", "varrho": "ϱ", "varsigma": "ς", "epsilon": "ϵ", "phi": "ϕ", "imath": "ı", "jmath": "ȷ"}
FUNCTIONS = frozenset("sin cos tan cot sec csc sinh cosh tanh coth arcsin arccos arctan exp log ln lg det dim ker gcd lim limsup liminf max min sup inf arg deg hom mod bmod Pr".split())
#: Functions that content markup has an element for.
CONTENT_FUNCTIONS = frozenset("sin cos tan cot sec csc sinh cosh tanh coth arcsin arccos arctan exp log ln arg".split())
FONTS = frozenset("mathbf mathbb mathcal mathfrak mathrm mathsf mathit mathtt boldsymbol bm operatorname displaystyle textstyle scriptstyle limits nolimits big Big bigg Bigg bigl bigr Bigl Bigr left right quad qquad".split())
ACCENTS = {"hat": "^", "widehat": "^", "bar": "¯", "overline": "¯", "tilde": "~", "widetilde": "~", "vec": "→", "dot": "˙", "ddot": "¨"}
TEXTS = frozenset("text textrm textbf textit mbox".split())
FENCES = {"pmatrix": "()", "bmatrix": "[]", "vmatrix": "||", "Vmatrix": "‖‖", "Bmatrix": "{}", "matrix": "", "cases": "{", "array": "", "aligned": "", "smallmatrix": ""}
OPEN, CLOSE = {"(", "[", "{", "⟨", "⌊", "⌈"}, {")", "]", "}", "⟩", "⌋", "⌉"}


def greek(name: str) -> str | None:
    size = "CAPITAL" if name[:1].isupper() else "SMALL"
    try:
        return unicodedata.lookup(f"GREEK {size} LETTER {({'lambda': 'lamda', 'Lambda': 'Lamda'}.get(name, name)).upper()}")
    except KeyError:
        return None


class TooDeep(ValueError):
    pass


class _Reader:
    def __init__(self, latex: str):
        self.tokens, self.at, self.depth = TOKEN.findall(latex), 0, 0
        self.raw = latex
        self.ends = [m.end() for m in TOKEN.finditer(latex)]

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def next(self) -> str:
        t = self.peek()
        self.at += 1
        return t

    def row(self, stop: frozenset[str] = frozenset()) -> list[str]:
        self.depth += 1
        if self.depth > DEPTH:
            raise TooDeep("nested too deeply")
        out: list[str] = []
        while self.peek() and self.peek() not in stop:
            e = self.scripted()
            if e:
                out.append(e)
        self.depth -= 1
        return out

    def group(self) -> str:
        """The next argument as one element."""
        while self.peek().lstrip("\\") in FONTS and self.peek().startswith("\\"):
            self.next()
        if self.peek() == "{":
            self.next()
            r = self.row(frozenset("}"))
            self.next()
            return r[0] if len(r) == 1 else f"<mrow>{''.join(r)}</mrow>"
        return self.atom() or "<mrow></mrow>"

    def plain(self) -> str:
        """The text of the next argument as it is written."""
        if self.next() != "{":
            return self.tokens[self.at - 1] if self.at <= len(self.tokens) else ""
        start, depth = self.ends[self.at - 1], 1
        while depth and self.peek():
            depth += {"{": 1, "}": -1}.get(self.next(), 0)
        return self.raw[start : self.ends[min(self.at, len(self.ends)) - 1] - (0 if depth else 1)]

    def scripted(self) -> str:
        base, below, above = self.atom(), "", ""
        while self.peek() in ("_", "^", "'"):
            t = self.next()
            if t == "'":
                above = above + "<mo>′</mo>"
            elif t == "_":
                below = below + self.group()
            else:
                above = above + self.group()
        base = base or ("<mrow></mrow>" if below or above else "")
        one = lambda x: x if x.count("<mo>′</mo>") < 2 else f"<mrow>{x}</mrow>"
        if below and above:
            return f"<msubsup>{base}{below}{one(above)}</msubsup>"
        return f"<msub>{base}{below}</msub>" if below else f"<msup>{base}{one(above)}</msup>" if above else base

    def atom(self) -> str:
        t = self.next()
        if not t or t in ("}", "&", "\\\\"):
            return ""
        if t == "{":
            self.at -= 1
            return self.group()
        if t[0].isdigit():
            return f"<mn>{t}</mn>"
        if t[0].isalpha():
            return f"<mi>{t}</mi>"
        if t[0] != "\\" or len(t) == 1:
            return f"<mo>{escape(t)}</mo>" if not t.isalpha() else f"<mi>{t}</mi>"
        name = t[1:]
        if name in ("frac", "dfrac", "tfrac"):
            return f"<mfrac>{self.group()}{self.group()}</mfrac>"
        if name in ("binom", "dbinom", "tbinom"):
            return f"<mrow><mo>(</mo><mfrac linethickness=\"0\">{self.group()}{self.group()}</mfrac><mo>)</mo></mrow>"
        if name == "sqrt":
            if self.peek() == "[":
                self.next()
                degree = "".join(self.row(frozenset("]")))
                self.next()
                return f"<mroot>{self.group()}<mrow>{degree}</mrow></mroot>"
            return f"<msqrt>{self.group()}</msqrt>"
        if name in ACCENTS:
            return f"<mover>{self.group()}<mo>{ACCENTS[name]}</mo></mover>"
        if name in TEXTS:
            return f"<mtext>{escape(self.plain().strip())}</mtext>"
        if name == "begin":
            return self.table(self.plain())
        if name == "end":
            self.plain()
            return ""
        if name in ("pmod", "pod"):
            return f"<mrow><mo>(</mo><mi>mod</mi>{self.group()}<mo>)</mo></mrow>"
        if name in FONTS or not name.isalpha() and name not in OPERATORS:
            return ""
        if name in OPERATORS:
            return f"<mo>{escape(OPERATORS[name])}</mo>"
        return f"<mi>{IDENTIFIERS.get(name) or greek(name) or name}</mi>"

    def table(self, name: str) -> str:
        if name == "array" and self.peek() == "{":
            self.plain()
        rows, stop = [[]], frozenset(("&", "\\\\", "\\end"))
        while self.peek():
            rows[-1].append(f"<mtd>{''.join(self.row(stop))}</mtd>")
            t = self.next()
            if t == "\\\\":
                rows.append([])
            elif t != "&":
                self.plain()
                break
        body = "".join(f"<mtr>{''.join(r)}</mtr>" for r in rows if r != ["<mtd></mtd>"])
        fence = FENCES.get(name.rstrip("*"), "")
        left, right = (f"<mo>{x}</mo>" if x else "" for x in (fence[:1], fence[1:]))
        return f"<mrow>{left}<mtable>{body}</mtable>{right}</mrow>"


def bare(latex: str) -> str:
    """A formula without the signs that set it off."""
    t = latex.strip()
    for a, b in (("$$", "$$"), ("$", "$"), ("\\[", "\\]"), ("\\(", "\\)")):
        if len(t) >= len(a) + len(b) and t.startswith(a) and t.endswith(b):
            return t[len(a) : -len(b)].strip()
    return t


def presentation(latex: str | None) -> str | None:
    """Presentation MathML of a formula."""
    if not latex or not bare(latex):
        return None
    r = _Reader(bare(latex))
    try:
        out: list[str] = []
        while r.peek():
            out += r.row()
            if r.peek():
                r.next()
    except (TooDeep, RecursionError):
        return None
    return f"<math><mrow>{''.join(out)}</mrow></math>"


# Content, read from the presentation tree

RELATIONS = {"=": "eq", "≠": "neq", "<": "lt", ">": "gt", "≤": "leq", "≥": "geq", "≡": "equivalent", "≈": "approx", "∈": "in", "∉": "notin", "⊂": "subset", "⊆": "subset", "→": "tendsto", "⇒": "implies"}
SUMS = {"+": "plus", "-": "minus", "−": "minus", "∪": "union"}
PRODUCTS = {"⋅": "times", "×": "times", "∗": "times", "*": "times", "/": "divide", "÷": "divide", "∩": "intersect"}


class _Unsure(ValueError):
    pass


def _leaf(e) -> str:
    return (e.text or "").strip()


def _apply(name: str, *parts: str) -> str:
    return f"<apply><{name}/>{''.join(parts)}</apply>"


def _content(row: list) -> str:
    """Content markup of elements on one line: relations, then sums, then products, then the rest."""
    if not row:
        raise _Unsure("nothing there")
    parts, ops, depth = [[]], [], 0
    for e in row:
        t = _leaf(e) if e.tag == "mo" else ""
        depth += (t in OPEN) - (t in CLOSE)
        if t in RELATIONS and not depth:
            ops.append(RELATIONS[t])
            parts.append([])
        else:
            parts[-1].append(e)
    if ops:
        sides = [_sum(p) for p in parts]
        chain = [_apply(o, a, b) for o, a, b in zip(ops, sides, sides[1:])]
        return chain[0] if len(chain) == 1 else _apply("and", *chain)
    return _sum(row)


def _sum(row: list) -> str:
    terms, signs, depth = [[]], ["plus"], 0
    for e in row:
        t = _leaf(e) if e.tag == "mo" else ""
        depth += (t in OPEN) - (t in CLOSE)
        if t in SUMS and not depth:
            if terms[-1]:
                terms.append([])
                signs.append(SUMS[t])
            elif len(terms) == 1 and SUMS[t] == "minus":
                signs[0] = "minus"
            else:
                raise _Unsure(t)
        else:
            terms[-1].append(e)
    out = _product(terms[0])
    if signs[0] == "minus":
        out = _apply("minus", out)
    held = [out]
    for t, s in zip(terms[1:], signs[1:]):
        p = _product(t)
        if s == "plus":
            held.append(p)
        else:
            held = [_apply(s, held[0] if len(held) == 1 else _apply("plus", *held), p)]
    return held[0] if len(held) == 1 else _apply("plus", *held)


def _product(row: list) -> str:
    items, k, divide = [], 0, False
    while k < len(row):
        e = row[k]
        t = _leaf(e) if e.tag == "mo" else ""
        if t in PRODUCTS and items and k + 1 < len(row):
            divide, k = PRODUCTS[t] == "divide", k + 1
            continue
        if t in OPEN or t == "|":
            depth, j = 1, k + 1
            while j < len(row) and depth:
                s = _leaf(row[j]) if row[j].tag == "mo" else ""
                depth += -1 if (t == "|" and s == "|") else (t != "|") * ((s in OPEN) - (s in CLOSE))
                j += 1
            if depth:
                raise _Unsure(t)
            inner = _content(row[k + 1 : j - 1])
            item, k = (_apply("abs", inner) if t == "|" else inner), j
        elif e.tag == "mi" and _leaf(e) in CONTENT_FUNCTIONS:
            if k + 1 >= len(row):
                raise _Unsure(_leaf(e))
            j = k + 2
            if _leaf(row[k + 1]) in OPEN and row[k + 1].tag == "mo":
                depth, j = 1, k + 2
                while j < len(row) and depth:
                    s = _leaf(row[j]) if row[j].tag == "mo" else ""
                    depth += (s in OPEN) - (s in CLOSE)
                    j += 1
            item, k = f"<apply><{_leaf(e)}/>{_product(row[k + 1 : j])}</apply>", j
        else:
            item, k = _item(e), k + 1
        if divide:
            items[-1], divide = _apply("divide", items[-1], item), False
        else:
            items.append(item)
    if not items:
        raise _Unsure("no factor")
    return items[0] if len(items) == 1 else _apply("times", *items)


def _item(e) -> str:
    kids = list(e)
    if e.tag == "mi" and _leaf(e) in FUNCTIONS:
        raise _Unsure(_leaf(e))
    if e.tag in ("mi", "mn"):
        return f"<c{e.tag[1]}>{escape(_leaf(e))}</c{e.tag[1]}>" if e.tag == "mn" else f"<ci>{escape(_leaf(e))}</ci>"
    if e.tag == "mrow":
        return _content(kids)
    if e.tag == "mfrac" and not e.get("linethickness"):
        return _apply("divide", _content(kids[:1]), _content(kids[1:]))
    if e.tag in ("msqrt", "mroot"):
        degree = f"<degree>{_content(kids[1:])}</degree>" if e.tag == "mroot" else ""
        return f"<apply><root/>{degree}{_content(kids[:1])}</apply>"
    if e.tag == "msup" and len(kids) == 2 and _leaf(kids[1]) != "′":
        return _apply("power", _content(kids[:1]), _content(kids[1:]))
    if e.tag == "msub" and len(kids) == 2:
        return f'<apply><csymbol cd="ambiguous">subscript</csymbol>{_content(kids[:1])}{_content(kids[1:])}</apply>'
    if e.tag == "msubsup" and len(kids) == 3 and _leaf(kids[2]) != "′":
        return _apply("power", f'<apply><csymbol cd="ambiguous">subscript</csymbol>{_content(kids[:1])}{_content(kids[1:2])}</apply>', _content(kids[2:]))
    raise _Unsure(e.tag)


def content(latex: str | None) -> str | None:
    """Content MathML of a formula, or None where its meaning isn't certain."""
    import xml.etree.ElementTree as ET

    shown = presentation(latex)
    if shown is None:
        return None
    try:
        return f"<math>{_content(list(ET.fromstring(shown)[0]))}</math>"
    except (ValueError, ET.ParseError, RecursionError):
        return None


def converted(formulas: DataFrame, latex: str = "latex", converter: Callable[[], Callable[[str | None], tuple[str | None, str | None]]] | None = None) -> DataFrame:
    """formulas with pmml and cmml, batch by batch. `converter` makes, once in each worker, a function from LaTeX to both
    markups (an external program, a service); without one the plain subset is read here."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = converter() if converter else lambda x: (presentation(x), content(x))
        for x in batches:
            made = [one(t if isinstance(t, str) else None) for t in x[latex]]
            yield x.assign(pmml=pd.Series([m[0] for m in made], index=x.index, dtype=object), cmml=pd.Series([m[1] for m in made], index=x.index, dtype=object))

    fields = ", ".join(f"`{n}` {t}" for n, t in formulas.drop("pmml", "cmml").dtypes)
    return formulas.drop("pmml", "cmml").mapInPandas(run, f"{fields}, pmml string, cmml string")
