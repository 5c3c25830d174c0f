"""Formula trees from MathML: symbol layout, operator tree, path tuples. Pure functions, called in Arrow batches.

A tree is a Node: a tag and labelled edges. Layout edges are n(ext) a(bove) b(elow) o(ver) u(nder)
c (before above) d (before below) w(ithin) e(lement); operator edges are the positions of operands, all
"0" below a commutative operator. Tags carry a type before "!".
"""

from __future__ import annotations

import re
import string
import xml.etree.ElementTree as ET
from math import ceil

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Order of the layout edges, and labels of operands by position.
LAYOUT = "naboucdwe"
POSITIONS = string.digits + string.ascii_uppercase + string.ascii_lowercase
#: Content elements by the type of their operator.
FUNCTIONS = frozenset("sin cos tan cot sec csc sinh cosh tanh coth sech csch arccos arccot arccsc arcsec arcsin arctan arccosh arccoth arccsch arcsech arcsinh arctanh abs exp log ln min max ceiling floor arg gcd lcm real imaginary".split())
COMMUTATIVE = frozenset("approx eq neq equivalent plus times and or xor union intersect".split())
CONSTANTS = frozenset("infinity emptyset exponentiale imaginaryi pi eulergamma true false integers reals rationals naturalnumbers complexes primes".split())
#: Csymbol names that stand for another tag.
SYMBOLS = {"superscript": "O!SUP", "subscript": "O!SUB", "for-all": "O!forall", "forall": "O!forall", "hyperbolic-cotangent": "F!coth", "modulo": "O!rem", "Planck-constant-over-2-pi": "C!hbar", "nth-root": "O!root", "conditional": "O!conditional", "differential-d": "O!differential", "matrix": "M!matrix", "formulae-sequence": "O!form-seq", "fragments": "O!fragments"}
INVISIBLE = frozenset("⁡⁢⁣⁤")
ESCAPES = str.maketrans({"\t": r"\t", "\n": r"\n", "\r": r"\r", "?": "&quest;", ",": "&comma;", "[": "&lsqb;", "]": "&rsqb;"})
MAX_KIDS, MAX_TUPLE = 62, 200


class Node:
    """A tag with edges: (label, Node) pairs in order."""

    __slots__ = ("tag", "edges")

    def __init__(self, tag: str, edges: list | None = None):
        self.tag, self.edges = tag, edges or []

    def get(self, label: str) -> Node | None:
        return next((n for e, n in self.edges if e == label), None)

    def put(self, label: str, node: Node | None) -> Node:
        if node is not None:
            self.edges = sorted([x for x in self.edges if x[0] != label] + [(label, node)], key=lambda x: LAYOUT.find(x[0]))
        return self

    def last(self) -> Node:
        """The end of the baseline that starts here."""
        n = self
        while (m := n.get("n")) is not None:
            n = m
        return n

    def depth(self) -> int:
        return 1 + max((n.depth() for _, n in self.edges), default=0)

    def size(self) -> int:
        return 1 + sum(n.size() for _, n in self.edges)

    def leaves(self) -> int:
        return sum(n.leaves() for _, n in self.edges) if self.edges else 1


def clean_symbol(text: str | None) -> str:
    t = (text or "").strip()
    return "" if t in INVISIBLE else t.translate(ESCAPES)


def run_length(path: str) -> str:
    """Edge paths of more than five labels by counts."""
    return re.sub(r"(.)\1*", lambda m: f"{len(m[0])}{m[1]}", path) if len(path) > 5 else path


def run_length_back(code: str) -> str:
    return re.sub(r"(\d+)(\D)", lambda m: m[2] * int(m[1]), code) if code[:1].isdigit() else code


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def parse_xml(markup: str) -> ET.Element | None:
    """The root of a MathML text; entities of HTML and undeclared prefixes are tolerated; None if it is no XML."""
    if not markup or not markup.strip():
        return None
    import html

    text = re.sub(r"&(?!(?:lt|gt|amp|quot|apos|#\d+|#x[0-9a-fA-F]+);)(\w+);", lambda m: html.unescape(m[0]), markup.strip())
    text = re.sub(r"<(/?)(\w+):", r"<\1", text)
    try:
        return ET.fromstring(text)
    except ET.ParseError:
        return None


def isolate(markup: str, content: bool) -> ET.Element | None:
    """Presentation or content part of combined markup, annotations of other kinds left out."""
    root = parse_xml(markup)
    if root is None:
        return None
    for sem in root.iter():
        if _local(sem) == "semantics":
            kids = list(sem)
            part = next((k for k in kids if _local(k) == "annotation-xml" and ("Content" in k.get("encoding", "")) == content), None)
            if part is not None:
                return next(iter(part), None)
            if kids and not content:
                return kids[0]
            if content:
                rest = [k for k in kids if not _local(k).startswith("annotation")]
                return rest[0] if rest and _local(rest[0]) in ("apply", "ci", "cn", "csymbol") else None
    return root


# Layout trees


def _chain(nodes: list[Node]) -> Node | None:
    """Nodes on one baseline; matrices that touch become one."""
    nodes = [n for n in nodes if n is not None and not (n.tag in ("W!", "") and not n.edges)]
    if not nodes:
        return None
    head = at = nodes[0]
    for n in nodes[1:]:
        if at.tag.startswith("M!") and n.tag.startswith("M!") and at.get("n") is None and at.get("w") and n.get("w") and (m := re.fullmatch(r"(M!\D*)1x(\d+)", at.tag)) and (k := re.fullmatch(r"M!\D*1x(\d+)", n.tag)):
            cell = at.get("w")
            while cell.get("e"):
                cell = cell.get("e")
            cell.put("e", n.get("w"))
            at.tag = f"{m[1]}1x{int(m[2]) + int(k[1])}"
            continue
        at.last().put("n", n)
        at = n
    return head


def _fenced(opening: str, cells: list[list[Node]], closing: str) -> Node:
    """A fenced list as a matrix of one row: cells joined by element edges."""
    chains = [_chain(c) or Node("W!") for c in cells]
    if len(chains) == 1 and chains[0].tag.startswith("M!") and not chains[0].get("n") and chains[0].tag[2:3] not in tuple("({|&∥"):
        chains[0].tag = f"M!{opening}{closing}{chains[0].tag[2:]}"
        return chains[0]
    for a, b in zip(chains, chains[1:], strict=False):
        a.put("e", b)
    empty = len(chains) == 1 and chains[0].tag == "W!" and not chains[0].edges
    node = Node(f"M!{opening}{closing}" + ("" if empty else f"1x{len(chains)}"))
    return node if empty else node.put("w", chains[0])


def layout_tree(e: ET.Element | None) -> Node | None:
    """Symbol layout tree of presentation MathML."""
    if e is None:
        return None
    name, kids = _local(e), list(e)
    sub = lambda k: layout_tree(kids[k]) if k < len(kids) else None
    solid = lambda n: n if n is not None else Node("W!")
    typed = {"mn": "N!", "mi": "V!", "mtext": "T!", "ms": "T!"}
    if name in ("math", "semantics", "mstyle", "mphantom", "merror") and len(kids) <= 1 or name == "semantics":
        return sub(0)
    if name in typed:
        t = clean_symbol(e.text)
        return Node(typed[name] + t if t else "W!")
    if name == "mo":
        return Node(clean_symbol(e.text))
    if name in ("mspace", "none", "mprescripts", "malignmark", "maligngroup"):
        return Node("W!")
    if name == "qvar":
        return Node("?" + (e.get("name") or clean_symbol(e.text)))
    if name == "mfenced":
        cells = [[layout_tree(k)] for k in kids] or [[]]
        return _fenced(e.get("open", "(").translate(ESCAPES), cells, e.get("close", ")").translate(ESCAPES))
    if name == "mfrac":
        return Node("O!divide").put("o", solid(sub(0))).put("u", solid(sub(1)))
    if name == "msqrt":
        return Node("O!root").put("w", _chain([layout_tree(k) for k in kids]))
    if name == "mroot":
        return Node("O!root").put("w", sub(0)).put("c", sub(1))
    if name == "menclose":
        return Node(e.get("notation", "longdiv")).put("w", _chain([layout_tree(k) for k in kids]))
    if name in ("msub", "msup", "msubsup", "munder", "mover", "munderover"):
        base = solid(sub(0))
        below = {"msub": 1, "msubsup": 1, "munder": 1, "munderover": 1}.get(name)
        above = {"msup": 1, "msubsup": 2, "mover": 1, "munderover": 2}.get(name)
        stacked = name.startswith("mu") or name == "mover" or (base.tag[1:2] != "!" and base.tag[:1] != "?" and len(base.tag) == 1 and base.tag in "∑∏∫⋃⋂∐⨁⨂⋀⋁∮")
        at = base.last()
        for k, (over, plain) in ((below, ("u", "b")), (above, ("o", "a"))):
            if k is not None:
                at.put(over if stacked else plain, sub(k))
        return base
    if name == "mmultiscripts":
        base, labels, k = solid(sub(0)), ("b", "a"), 1
        while k < len(kids):
            if _local(kids[k]) == "mprescripts":
                labels, k = ("d", "c"), k + 1
                continue
            for label in labels:
                n = sub(k)
                if n is not None and n.tag != "W!":
                    old = base.get(label)
                    base.put(label, _chain([old, n]) if old else n)
                k += 1
        return base
    if name == "mtable":
        rows = [[_chain([layout_tree(x) for x in cell]) or Node("W!") for cell in row if _local(cell) == "mtd"] for row in kids if _local(row) in ("mtr", "mlabeledtr")]
        cols = max(map(len, rows), default=0)
        cells = [c for row in rows for c in [*row, *(Node("W!") for _ in range(cols - len(row)))]]
        for a, b in zip(cells, cells[1:], strict=False):
            a.put("e", b)
        return Node(f"M!{len(rows)}x{cols}").put("w", cells[0] if cells else None)
    nodes = [n for n in (layout_tree(k) for k in kids) if n is not None and not (n.tag in ("W!", "") and not n.edges)]
    pairs = {"(", "{", "|", "∥", "&lsqb;"}, {")", "}", "|", "∥", "&rsqb;"}
    if len(nodes) > 2 and nodes[0].tag in pairs[0] and nodes[-1].tag in pairs[1] and not nodes[0].edges:
        cells: list[list[Node]] = [[]]
        for n in nodes[1:-1]:
            cells[-1].append(n)
            if n.tag == "&comma;":
                cells.append([])
        end, closing = nodes[-1], nodes[-1].tag
        m = _fenced(nodes[0].tag, cells, closing)
        for label, n in end.edges:
            m.put(label, n)
        return m
    return _chain(nodes)


# Operator trees


def _split(node: Node) -> Node:
    """No commutative operator with more operands than there are labels."""
    kids = [n for _, n in node.edges]
    if len(kids) > MAX_KIDS and node.tag.startswith("U!"):
        part = ceil(len(kids) / ceil(len(kids) / MAX_KIDS))
        groups = [kids[k : k + part] for k in range(0, len(kids), part)]
        return _operator(node.tag, [_operator(node.tag, g) if len(g) > 1 else g[0] for g in groups])
    return node


#: Operators among the elements of content MathML.
OPERATORS = frozenset(
    """abs and approx arg cartesianproduct card ceiling codomain compose conjugate curl declare diff divergence divide domain eq
    equivalent exists exp factorial factorof floor fn forall gcd geq grad gt ident image imaginary implies in int intersect inverse
    lambda laplacian lcm leq limit ln log logbase lt max mean median min minus mode moment momentabout neq not notin notprsubset
    notsubset or outerproduct partialdiff piece piecewise plus power product prsubset quotient real reln rem root scalarproduct
    sdev selector setdiff subset sum tendsto times transpose union variance vectorproduct xor""".split()
)


class UnknownElement(ValueError):
    """A content element that is no part of the language; its formula has no tuples."""


def _operator(tag: str, kids: list[Node]) -> Node:
    label = (lambda k: "0") if tag.startswith("U") else (lambda k: POSITIONS[min(k, MAX_KIDS - 1)])
    return _split(Node(tag, [(label(k), n) for k, n in enumerate(kids)]))


def operator_tree(e: ET.Element | None, known: dict | None = None, last: list | None = None) -> Node | None:
    """Operator tree of content MathML. <share> repeats the element it names, else the right side of the relation before it."""
    if e is None:
        return None
    known = {} if known is None else known
    last = [] if last is None else last
    node = _operator_tree(e, known, last)
    if node is not None and (key := e.get("id") or e.get("{http://www.w3.org/XML/1998/namespace}id")):
        known[key] = node
    return node


def _operator_tree(e: ET.Element, known: dict, last: list) -> Node | None:
    name, kids = _local(e), list(e)
    sub = lambda k: operator_tree(k, known, last) or Node("W!")
    typed = {"ci": "V!", "cn": "N!", "mtext": "T!"}
    if name in ("math", "semantics"):
        return operator_tree(kids[0], known, last) if kids else None
    if name in typed:
        t = clean_symbol("".join(e.itertext()))
        return Node(typed[name] + t if t else "W!")
    if name == "qvar":
        return Node("?" + (e.get("name") or clean_symbol(e.text)))
    if name == "share":
        key = (e.get("href") or e.get("src") or "").lstrip("#")
        return known.get(key) or (last[-1] if last else Node("W!"))
    if name == "cerror":
        return _operator("E!", [sub(k) for k in kids])
    if name in ("vector", "list", "set"):
        return _operator(f"M!{name[0].upper()}-{len(kids)}", [sub(k) for k in kids])
    if name == "matrix":
        rows = [sub(k) for k in kids]
        cols = max((len(r.edges) for r in rows), default=0)
        return _operator(f"M!M-{len(rows)}x{cols}", [_operator("M!R!", [n for _, n in r.edges] + [Node("E!")] * (cols - len(r.edges))) for r in rows])
    if name == "matrixrow":
        return _operator("M!R!", [sub(k) for k in kids])
    if name == "interval":
        a, b = {"open": "OO", "open-closed": "OC", "closed-open": "CO"}.get(e.get("closure", "closed"), "CC")
        return _operator(f"O!interval({a}-{b})", [sub(k) for k in kids])
    if name in ("bvar", "lowlimit", "uplimit", "degree", "condition", "domainofapplication", "otherwise"):
        inner = [sub(k) for k in kids]
        return inner[0] if len(inner) == 1 else _operator(f"O!{name}", inner)
    if name == "apply":
        if not kids:
            return None
        if _local(kids[0]) == "root":
            degree = [sub(k) for k in kids[1:] if _local(k) == "degree"]
            rest = [sub(k) for k in kids[1:] if _local(k) != "degree"]
            return _operator("O!root", rest + (degree or [Node("N!2")]))
        head = sub(kids[0])
        args = [sub(k) for k in kids[1:]]
        if head.edges:
            main = head.edges[0][1].tag if head.tag in ("O!SUB", "O!SUP") else ""
            return _operator("+!" + main, [head, *args])
        tag = "F!" + head.tag[2:] if head.tag.startswith("V!") else head.tag
        if _local(kids[0]) in COMMUTATIVE | {"lt", "gt", "leq", "geq", "in", "subset"} and args:
            last.append(args[-1])
        return _operator(tag, args)
    if name == "csymbol":
        t = clean_symbol("".join(e.itertext()))
        return Node(SYMBOLS.get(t) or ("M!D-" + t[10:].lstrip("-") if t.startswith("delimited-") else "") or (f"U!{t}" if t in COMMUTATIVE else f"F!{t}" if t in FUNCTIONS else f"O!{t}" if t and not t.isspace() else "W!"))
    if name == "determinant":
        return Node("F!det")
    if name in FUNCTIONS:
        return Node(f"F!{name}")
    if name in COMMUTATIVE:
        return Node(f"U!{name}")
    if name in CONSTANTS:
        return Node(f"C!{name}")
    if name not in OPERATORS and name not in ("unknown", "annotation"):
        raise UnknownElement(name)
    tag = f"-!{clean_symbol(e.text)}" if name in ("unknown", "annotation") else f"O!{name}"
    return _operator(tag, [sub(k) for k in kids])


# Tuples


def path_tuples(root: Node | None, layout: bool, window: int = 2, ends: bool = True) -> list[str]:
    """Every ancestor and descendant within window edges, and the ends of baselines or leaves: node, descendant, path between, path from the root."""
    if root is None:
        return []
    out: list[str] = []
    short = run_length if layout else (lambda p: p)
    todo = [(root, "")]
    while todo:
        node, at = todo.pop()
        loc = short(at) or "-"
        near = [(n, label) for label, n in node.edges]
        todo += [(n, at + label) for label, n in node.edges]
        while near:
            n, path = near.pop(0)
            out.append(f"{node.tag}\t{n.tag}\t{short(path)}\t{loc}")
            if len(path) < window:
                near += [(m, path + label) for label, m in n.edges]
        if ends and (node.get("n") is None if layout else not node.edges):
            out.append(f"{node.tag}\t0!\t{'n' if layout else '0'}\t{loc}")
    return sorted(t for t in out if len(t) <= MAX_TUPLE)


def tuples_of(markup: str | None, kind: str, window: int = 2) -> list[str]:
    """Tuples of MathML markup, kind slt or opt; an unreadable formula has none."""
    if not markup:
        return []
    try:
        layout = kind != "opt"
        e = isolate(markup, content=not layout)
        return path_tuples(layout_tree(e) if layout else operator_tree(e), layout, window)
    except (ValueError, RecursionError):
        return []


def tree_of(markup: str | None, kind: str) -> Node | None:
    """The tree of MathML markup; an unreadable formula has none."""
    try:
        return layout_tree(isolate(markup or "", False)) if kind != "opt" else operator_tree(isolate(markup or "", True))
    except (ValueError, RecursionError):
        return None


def written(root: Node | None) -> str:
    """Bracket string of a tree: [tag] with labelled edges, reversible."""
    return "" if root is None else f"[{root.tag}{''.join(f',{label}{written(n)}' for label, n in root.edges)}]"


def read_tree(text: str) -> Node | None:
    """The tree of a bracket string."""
    if not text:
        return None
    at = 0

    def node() -> Node:
        nonlocal at
        at += 1
        start = at
        while text[at] not in ",[]" or (text[at] == "," and at + 2 < len(text) and text[at + 2] != "["):
            at += 1
        n = Node(text[start:at])
        while text[at] == ",":
            label = text[at + 1]
            at += 2
            n.edges.append((label, node()))
        at += 1
        return n

    return node()


def graph(root: Node | None, marked: frozenset[str] = frozenset()) -> str:
    """Graphviz text of a tree; marked tags are filled."""
    lines, todo, n = [], [(root, None, "")] if root else [], 0
    while todo:
        node, parent, label = todo.pop()
        me, n = n, n + 1
        lines.append(f'  n{me} [label="{node.tag}"{", style=filled" if node.tag in marked else ""}];')
        if parent is not None:
            lines.append(f'  n{parent} -> n{me} [label="{label}"];')
        todo += [(k, me, e) for e, k in reversed(node.edges)]
    return "\n".join(["digraph formula {", *lines, "}"])


# Column functions


def tuples_udf(kind: str, window: int = 2):
    """MathML column to array of tuples."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def f(c: pd.Series) -> pd.Series:
        return pd.Series([tuples_of(x, kind, window) for x in c], index=c.index, dtype=object)

    return f


def tree_facts_udf(kind: str):
    """MathML column to struct of bracket string, size, depth, leaves."""

    @F.pandas_udf("struct<tree:string,size:int,depth:int,leaves:int>")
    def f(c: pd.Series) -> pd.DataFrame:
        trees = [tree_of(x, kind) for x in c]
        return pd.DataFrame([(written(t), t.size() if t else 0, t.depth() if t else 0, t.leaves() if t else 0) for t in trees], columns=["tree", "size", "depth", "leaves"])

    return f


def run_length_udf(back: bool = False):
    @F.pandas_udf(T.StringType())
    def f(c: pd.Series) -> pd.Series:
        return c.map(lambda x: None if x is None else run_length_back(x) if back else run_length(x))

    return f


def erase_types(tuple_: Column) -> Column:
    """V!x to V! in all parts of a tuple."""
    return F.array_join(F.transform(F.split(tuple_, "\t"), lambda p: F.when(F.contains(p, F.lit("!")), F.concat(F.split_part(p, F.lit("!"), F.lit(1)), F.lit("!"))).otherwise(p)), "\t")


def node_tokens(tag: Column, mode: str) -> Column:
    """Tokens of a node tag: value, type, separated or whole."""
    kind, value = F.regexp_extract(tag, r"^([^!]*!)", 1), F.regexp_replace(tag, r"^[^!]*!", "")
    both = F.when(kind == "", F.array(tag)).when(value == "", F.array(kind)).otherwise(F.array(kind, value))
    return {"value": F.when(F.size(both) > 1, F.slice(both, 2, 1)).otherwise(both), "type": F.slice(both, 1, 1), "separated": both, "whole": F.array(tag)}[mode]


def tuple_tokens(tuple_: Column, mode: str) -> Column:
    """Node tokens of a tuple, then one token for each edge and location label, prefixed n: or e:."""
    p = F.split(tuple_, "\t")
    nodes = F.transform(F.concat(node_tokens(F.get(p, F.lit(0)), mode), node_tokens(F.get(p, F.lit(1)), mode)), lambda x: F.concat(F.lit("n:"), x))
    edges = F.transform(F.filter(F.split(F.concat(F.get(p, F.lit(2)), F.coalesce(F.get(p, F.lit(3)), F.lit(""))), ""), lambda x: x != ""), lambda x: F.concat(F.lit("e:"), x))
    return F.concat(nodes, edges)


def is_trivial(tuples: Column, operator: bool) -> Column:
    """No tuples; or one distinct content tag and, in operator trees, no operator."""
    tags = F.array_distinct(F.filter(F.flatten(F.transform(tuples, lambda t: F.slice(F.split(t, "\t"), 1, 2))), lambda x: x != "0!"))
    one = F.size(tags) <= 1
    if operator:
        one = one & ~F.exists(tags, lambda x: F.substring(x, 1, 2).isin("O!", "U!", "F!", "+!", "M!"))
    return (F.size(tuples) == 0) | one


def containment(query: Column, answer: Column) -> Column:
    """Share of the query's distinct tuples found in the answer; 0 for an empty query."""
    q = F.array_distinct(query)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, answer)) / F.size(q))
