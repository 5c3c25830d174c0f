"""Sentence units of every document, across languages and scripts.

Blocks are cut at blank lines. Formulas, file names and numbers are opaque. Spaced scripts: every run of
closing marks outside a number, name or quotation that goes on is a node of a terminator lattice, whose arcs are possible units.
The odds that a unit ends at a mark come from the word before it (abbreviation, initial, ordinal, numbering), a
quotation or bracket closing there, the opening after it and the style of the unit, so they depend on where the arc
starts. An arc costs the logarithm of the odds against going on at each mark within it and against ending at its
last; a unit that opens with a closing mark, or in lower case between units that do not, costs more. The cheapest
path through the lattice of a block gives its units. Starts that no later mark can tell apart are held as one, the
cheaper, so the search is exact and few starts are open at a time.

Spaceless scripts: the text on both sides of a gap or a closing quotation is segmented by a word lattice, the cheapest
path through dictionary words and single characters. The gap is then scored by the particle that ends the left side
and the word that opens the right one, on top of what gaps of the script mean: in Thai, which has no closing mark, a gap
closes a unit whatever stands around it (but for the repetition mark, which belongs to its left); in Chinese and
Japanese, where marks close units, a gap closes one only if the words say so. More words may be given as `dictionary`.

Defined cases: null, empty and blank texts give no units; repeated rows of a document count once (the
first text in order); units cover all that is not white space; offsets are code points, end exclusive.
Each document is read whole by one call, in time linear in its length: quotations are matched by stacks,
and what a mark's odds depend on lies within NEAR characters before it.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumac.llm.once import once

SCHEMA = "doc_id bigint, unit_no int, start_char int, end_char int, unit string"

#: Abbreviations after which a sentence goes on, lower case, without the last full stop.
ABBREVIATIONS = frozenset(
    """cf e.g eg i.e ie viz vs resp approx prof dr mr mrs ms st ch chap w.r.t al ed eds rem messrs mt ft
    z.b d.h u.a b h bzw ca vgl abschn nr s bd hr fr gl gln abb kap sog evtl ggf inkl z d h u allg bzgl einschl insb
    m mme mlle mm env éq p.ex c.-à-d c-à-d av
    pág págs ec ecs aprox p.ej ej sr sra srta dr núm cap
    см разд ок т.е т е рис стр гл п ср напр проф г ур св акад им
    डॉ प्रो श्री श्रीमती د أ م ص""".split()
)
#: Abbreviations before a number, words of their own elsewhere; titles before a name; months before a day.
BEFORE_NUMBER = frozenset("no nos p pp fig figs eq eqs sec secs thm lem prop cor def vol vols ex op art par tab app ref refs ver v jan feb mar apr jun jul aug sep sept oct nov dec janv févr juil déc ene abr ago dic".split())
TITLES = frozenset("lt col gen capt cpt sgt maj cmdr adm brig rev hon gov sen rep pres supt insp fr sr dra ing lic mgr dipl".split())
#: Abbreviations that may end a sentence.
MAY_END = frozenset("etc usw a.m p.m т.д т.п и.т.д др и.т.п u.s.w inc ltd co corp bros plc llc gmbh jr sr ph.d esq u.s u.k e.u d.c b.c a.d".split())
#: The word before a German ordinal.
BEFORE_ORDINAL = frozenset("das der die dem den des am vom zum im beim ab bis und jedes jeder".split())
#: Words with which a sentence goes on after a quotation or an ending abbreviation: conjunctions,
#: prepositions, forms of being and verbs of speech.
GOES_ON = frozenset(
    """and or but in on at to of for from with by as is was are were which that who although while before after then than because
    answer answers answered ask asks asked say says said reply replies replied write writes wrote add adds added shout shouts shouted insist insists insisted
    und oder aber im in auf mit als weil denn sagt sagte fragt fragte schreibt schrieb ruft rief heißt meint meinte
    et ou mais avant dans de a puis dit demanda demande écrit répondit y o pero en de con antes dijo preguntó escribió respondió siguió
    и или но в на с что как сказал сказала спросил спросила писал писала написал считал ответил और या में से कि ने लिखा कहा पूछा ثم و أو في من إلى قال وقال سأل كتب""".split()
)
#: Dictionary of the word lattice: particles that end a clause, words that open one, words that take up a
#: quotation or go on with a sentence, and other words in frequent use, so that these are not cut out of longer ones.
FINAL_PARTICLES = frozenset(
    """か ね よ わ ぞ さ のだ だろう でしょう である です でした ます ました ません だ だった た ない なかった ください
    的 了 吗 呢 吧 啊 呀 嘛 啦 过 着 矣 也 ครับ ค่ะ คะ นะ จ้ะ หรือ ไหม หรือไม่ แล้ว เสมอ เลย ด้วย""".split()
)
OPENERS = frozenset(
    """以上 以上より しかし そして また さらに したがって よって ゆえに だから なぜなら つまり すなわち 例えば たとえば ところが 一方 ここで 次に まず 最後に もし なお ただし 彼 彼女 私 我々 これ それ この その あの 今 昨日 第 なんと
    我 我们 你 他 她 它 他们 她们 这 那 这个 那个 因此 所以 因为 但是 但 然而 不过 而且 另外 此外 如果 假设 假如 虽然 于是 首先 其次 最后 例如 注意 综上 综上所述 由 从 对于 关于 当 今天 昨天 现在 设 令 将 多么
    ถ้า หาก ดังนั้น เพราะ เมื่อ จาก สมมติ สมมติว่า เรา เขา ฉัน ผม มัน และ แต่ อย่างไรก็ตาม นอกจากนี้ ต่อมา ต่อไป โดย สำหรับ ใน""".split()
)
FOLLOWERS = frozenset("と って という との とか は が を に も の で から まで など 然后 并 并且 就 而 地 的 之 来 说 道 问 写 是 等 一词 一句 ๆ ฯ ว่า ที่ ซึ่ง ของ".split())
DICTIONARY = FINAL_PARTICLES | OPENERS | FOLLOWERS | frozenset("へ や より ので のに こと もの ため よう する なる いる ある できる 在 和 与 或 不 有 没有 可以 那么 这样 一个 什么 因 为 以 及 其 所 เป็น ได้ จะ ไม่ นั้น นี้ มี ให้ กับ ก็ คือ ต้อง".split())
LONGEST = max(map(len, DICTIONARY))
#: Characters of either side of a gap that the lattice segments.
SPAN = 16

#: A formula in dollars has no blank just inside them and no digit after them, so that two prices are none.
MATH = re.compile(r"\$\$.+?\$\$|\$(?![\s$])[^$\n]*(?:\n[^$\n]+)*(?<![\s\\])\$(?!\d)|\\\((?:(?!\\\().)+?\\\)|\\\[(?:(?!\\\[).)+?\\\]", re.S)
BLANK = re.compile("\\n[^\\S\\n]*\\n\\s*|\\u2029")
MARKS = re.compile(r"(?:\.{2,}|…+|[.!?؟۔।॥。！？｡‼⁇⁈⁉]+)+")
CLOSERS = ")]}\"'”’»“›」』）】》〉"
OPENING = "([{\"'“‘„«‹「『（【《〈¿¡"
PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "《": "》", "[": "]"}
WIDE = re.compile(r"[　-ヿ㐀-鿿＀-￯]")
THAI_GAP = re.compile(r"(?<=[฀-๿])\s+(?=[฀-๿])")
HAS_THAI = re.compile(r"[\u0e00-\u0e7f]")
GAP = re.compile(r"(?<=[\u3040-\u30ff\u3400-\u9fff])\s+(?=[\u3040-\u30ff\u3400-\u9fff])")
WORD_BEFORE = re.compile(r"[^\s()\[\]{}\"“”„«»‘,;:¿¡]+$")


def lattice(text: str, words: frozenset[str] = DICTIONARY) -> list[str]:
    """The cheapest segmentation of text: a dictionary word costs 1, any other character 2."""
    longest = max(LONGEST, max(map(len, words))) if words is not DICTIONARY else LONGEST
    best, back = [0] + [10**9] * len(text), [0] * (len(text) + 1)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + longest) + 1):
            cost = 1 if text[i:j] in words else 2 if j == i + 1 else None
            if cost is not None and best[i] + cost < best[j]:
                best[j], back[j] = best[i] + cost, i
    out, j = [], len(text)
    while j:
        out.append(text[back[j] : j])
        j = back[j]
    return out[::-1]


#: What a gap of a script means by itself, and what the words beside it add.
THAI_PRIOR, WIDE_PRIOR, PARTICLE, OPENER, FOLLOWER = 6, -1, 2, 2, -4


def gap_score(left: str, right: str, prior: int, words: frozenset[str] = DICTIONARY) -> int:
    """Whether a gap in a spaceless script ends a unit (above 0): the script's prior, a final particle before it, an
    opening word or one that goes on after it."""
    if right[:1] in "ๆฯ":
        return -9
    last, first = lattice(left[-SPAN:], words)[-1:], lattice(right[:SPAN], words)[:1]
    score = prior + (PARTICLE if last and last[0] in FINAL_PARTICLES else 0)
    return score + (FOLLOWER if first and first[0] in FOLLOWERS and first[0] not in OPENERS else OPENER if first and first[0] in OPENERS else 0)


def opening(right: str, words: frozenset[str] = DICTIONARY) -> int:
    """How far the first word of a text in a spaceless script opens a sentence: 1, 0 or -1 if it goes on with one."""
    first = lattice(right[:SPAN], words)[:1]
    return 0 if not first else 1 if first[0] in OPENERS else -1 if first[0] in FOLLOWERS else 0


def quoted(text: str) -> list[int]:
    """For each character the end of the outermost quotation that holds it, or -1."""
    ends: dict[int, int] = {}
    for c in "“„«「『‘":
        if c not in text:
            continue
        close = {"„": "“”", "‘": "’"}.get(c, PAIRS.get(c, ""))
        held: list[int] = []
        for m in re.finditer(f"[{c}{close}]", text):
            if m[0] == c:
                held.append(m.start())
            elif held:
                ends[held.pop()] = m.start()
    straight = [m.start() for m in re.finditer('"', text)]
    if not ends and len(straight) < 2:
        return [-1] * len(text)
    after = dict(zip(straight, straight[1:], strict=False))
    inside, at = [-1] * len(text), 0
    for i in sorted([*ends, *straight]):
        end = ends.get(i, -1) if text[i] != '"' else after.get(i, -1)
        if i >= at and end > i:
            inside[i : end + 1] = [end] * (end + 1 - i)
            at = end + 1
    return inside


#: Cost of a unit in lower case between units that are not.
MIXED_STYLE = 3.0
#: Cost of a decision against odds of exp(score), for the scores of _ends.
#: Marks that end nothing if a letter or digit follows at once.
INNER = re.compile(r"[.!?]+")
AGAINST = {s: math.log1p(math.exp(s)) for s in range(-9, 10)}
NOT_BLANK = re.compile(r"\S")
NEXT_WORD = re.compile(rf"[{re.escape(OPENING)}]*([^\W\d_]+)")
#: Characters before a mark that hold the words which _ends reads.
NEAR = 400
#: Characters after a unit's start within which it makes a difference that the unit starts there (numbering).
HEAD = 24
VOWEL = re.compile(r"[aeiouyàâäåæèéêëìíîïòóôöøùúûüÿœ]")
SAME_TWO = re.compile(r"([A-Z])\1")
LETTER = re.compile(r"[^\W\d_]")
WIDE_MARKS, QUOTES = frozenset("。！？｡"), frozenset('"”’»“」』')
AND_SO_ON, EXAMPLE = re.compile(r"(?:т|т\.)\s*[дп]$"), re.compile(r"e[xj]\.", re.I)
ROMAN_NEXT, ROMAN = re.compile(r"[IVXLC]+\b"), re.compile("[ivxlcdm]+")
INITIALS, NUMBERING = re.compile(r"[^\W\d_](?:\.-?[^\W\d_])*"), re.compile(r"\d{1,4}|[ivxlcdm]{1,6}|[IVXLCDM]{1,6}")


def _ends(text: str, shown: str, a: int, b: int, close: int, after: int, unit_start: int, lower_style: bool, upper_style: bool, words: frozenset[str] = DICTIONARY) -> int:
    """Logarithm of the odds that the unit from unit_start ends at the mark text[a:b], closed up to `close`; the text goes on at `after`."""
    mark, nxt = text[a:b], text[after : after + LONGEST]
    gap = after > close
    wide = not WIDE_MARKS.isdisjoint(mark) or (bool(WIDE.match(text[a - 1 : a])) and mark[0] != ".")
    closed = text[b:close].strip()
    word = NEXT_WORD.match(text, after)
    word = word[1] if word else ""
    lower_next = word[:1].islower()
    goes_on = bool(word) and word.lower() in GOES_ON and (upper_style or not word[0].isupper())
    caseless_next = bool(word) and word[0].lower() == word[0].upper()
    ellipsis = "…" in mark or ".." in mark
    if ellipsis:
        return 3 if word[:1].isupper() and gap and not upper_style else -3
    if closed and not QUOTES.isdisjoint(closed):
        if wide or bool(WIDE.match(nxt)):
            return 3 if opening(text[after : after + SPAN], words) > 0 else -3
        if goes_on:
            return -4
        if lower_next and not lower_style:
            return -3
        if nxt[0] in ",;:-–—،":
            return -5
        return 2
    if wide:
        return 5
    if nxt[0] in ",;:،" or (not gap and not closed and mark[-1:] not in "।॥۔؟"):
        return -5
    if closed and lower_next and not lower_style:
        return -2
    if set(mark) != {"."}:
        return -1 if lower_next and not lower_style and closed else 4
    if closed and closed[0] in ")]":
        return 3
    left = WORD_BEFORE.search(shown[unit_start:a])
    token = left[0] if left else ""
    low = token.lower().lstrip("¿¡*_")
    before = shown[unit_start : unit_start + left.start()] if left else ""
    number_next, upper_next = nxt[:1].isdigit() or nxt[:1] in "(\ue000" or nxt[:1] == "$", word[:1].isupper()
    if low in MAY_END or (low in ("д", "п", "тд", "тп") and AND_SO_ON.search(shown[max(unit_start, a - 6) : a].lower())):
        if goes_on or (lower_next and not lower_style) or (low not in ("etc", "a.m", "p.m") and (lower_style or upper_style)):
            return -2
        if caseless_next and nxt[0] not in "$\\":
            return -1
        return -2 if nxt[:1].isdigit() else 2
    if low in ABBREVIATIONS:
        return -3
    if low in BEFORE_NUMBER and (number_next or ROMAN_NEXT.match(nxt)):
        return -3
    if (low == "p" and EXAMPLE.match(nxt)) or (low in ("ex", "ej") and before.rstrip().lower().endswith("p.")):  # p. ex., p. ej.
        return -3
    if low in TITLES and upper_next and not lower_style:
        return -3 if token[0].isupper() or upper_style else 1
    if SAME_TWO.fullmatch(token):  # EE. UU.
        return -3 if lower_next or SAME_TWO.match(nxt) else 1
    if len(low) > 1 and low.isascii() and low.isalpha() and not VOWEL.search(low) and not upper_style and not ROMAN.fullmatch(low):
        return -2  # no vowel: a word cut short
    if INITIALS.fullmatch(token) and (token.isupper() or lower_style or len(token) > 1):
        return -3  # initials
    if NUMBERING.fullmatch(token):
        if not before.strip():
            return -3  # numbering
        if token.isdigit() and before.split()[-1].lower() in BEFORE_ORDINAL and word:
            return -3
        if token.isdigit() and lower_next and not lower_style:
            return -3
    if lower_next and not lower_style:
        return -1 if len(low) <= 3 and low.isalpha() and not before.strip() else 1
    return 4


def spans(text: str | None, words: frozenset[str] = DICTIONARY) -> list[tuple[int, int]]:
    """Start and end of each unit of a text."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    at = 0
    for m in [*BLANK.finditer(text), None]:
        out += block_spans(text, at, m.start() if m else len(text), words)
        at = m.end() if m else len(text)
    return out


class _Start:
    """A unit that begins at a node of the lattice, as far as it has been read."""

    __slots__ = ("at", "cost", "node", "lower", "mixed", "has_lower", "uppers", "words")

    def __init__(self, shown: str, at: int, cost: float, node: int, mixed: bool):
        self.at, self.cost, self.node, self.mixed = at, cost, node, mixed
        letter = LETTER.search(shown, at, at + 2)
        self.lower = bool(letter) and letter[0].islower()
        self.has_lower, self.uppers, self.words = self.lower, 0, -2  # its first piece begins with the mark before it

    def read(self, piece: str, upper: bool, words: int) -> None:
        self.words += words
        if not self.has_lower:
            self.has_lower = not upper
            if upper and self.uppers < 4:
                self.uppers = min(4, self.uppers + sum(map(str.isupper, piece)))

    def state(self, at: int) -> tuple:
        """What marks after `at` depend on."""
        return self.lower, self.mixed, self.has_lower, 0 if self.has_lower else self.uppers, self.at if self.words < 3 and at - self.at <= HEAD else -1


def block_spans(whole: str, lo: int, hi: int, words: frozenset[str] = DICTIONARY) -> list[tuple[int, int]]:
    text = whole[lo:hi]
    shown = MATH.sub(lambda m: "\ue000" * len(m[0]), text)
    inside = quoted(shown)
    begin = NOT_BLANK.search(shown)
    if not begin:
        return []
    nodes = [(0, -1)]  # end of a unit, node at its start
    live, read = [_Start(shown, begin.start(), 0.0, 0, False)], begin.start()
    marks = [(m.start(), m.end(), 0) for m in MARKS.finditer(shown)]
    gaps = []
    if HAS_THAI.search(shown):
        gaps = [(m.start(), m.end(), THAI_PRIOR) for m in THAI_GAP.finditer(shown)]
    gaps += [(m.start(), m.end(), WIDE_PRIOR) for m in GAP.finditer(shown)]
    for a, b, prior in sorted([*marks, *gaps]) if gaps else marks:
        if prior:
            if inside[a] < 0 and gap_score(shown[max(0, a - SPAN) : a], shown[b : b + SPAN], prior, words) > 0:
                best = min(live, key=lambda s: s.cost)
                nodes.append((a, best.node))
                live, read = [_Start(shown, b, best.cost, len(nodes) - 1, False)], b
            continue
        close = b
        while True:
            k = close
            while k < len(shown) and shown[k] in "   \n" and k - close < 2:
                k += 1
            if close < len(shown) and shown[close] in CLOSERS and (shown[close] not in "“\"" or inside[close] == close) and (shown[close] not in "'’" or close + 1 >= len(shown) or not shown[close + 1].isalnum()):
                close += 1
            elif k < len(shown) and k > close and shown[k] in "»" and inside[k] == k:
                close = k + 1
            else:
                break
        after = NOT_BLANK.search(text, close)
        if not after:
            break
        after = after.start()
        if inside[a] >= close or (after == b and INNER.fullmatch(text, a, b) and text[b].isalnum()):  # the quotation goes on, or a number or a name
            continue
        if MARKS.match(shown, after):  # a unit does not open with a mark
            continue
        piece = shown[read:a]
        upper, n_words, read = ("A" + piece).isupper(), max(0, len(piece.split()) - 1), a
        word = NEXT_WORD.match(text, after)
        upper_next, lower_next = bool(word) and word[1][0].isupper(), bool(word) and word[1][0].islower()
        scores: dict[tuple, int] = {}
        ends: dict[bool, tuple[float, int]] = {}  # the cheapest units that end here, by whether the next is of another style
        for s in live:
            s.read(piece, upper, n_words)
            upper_style = not s.lower and not s.has_lower and s.uppers > 3
            key = (s.lower, upper_style, s.at if s.words < 3 and a - s.at <= HEAD else -1)
            score = scores.get(key)
            if score is None:
                score = scores[key] = _ends(text, shown, a, b, close, after, max(s.at, a - NEAR), s.lower, upper_style, words)
            cost = s.cost + AGAINST[-score] + (MIXED_STYLE if s.mixed and upper_next else 0.0)
            mixed = lower_next and not s.lower
            if mixed not in ends or cost < ends[mixed][0]:
                ends[mixed] = (cost, s.node)
            s.cost += AGAINST[score]
        kept: dict[tuple, _Start] = {}
        for s in live:
            if (k := s.state(a)) not in kept or s.cost < kept[k].cost:
                kept[k] = s
        live = list(kept.values())
        for mixed, (cost, node) in ends.items():
            nodes.append((close, node))
            live.append(_Start(shown, after, cost, len(nodes) - 1, mixed))
    cuts, node = [], min(live, key=lambda s: s.cost).node
    while node:
        cuts.append(nodes[node][0])
        node = nodes[node][1]
    cuts.reverse()
    out, at = [], 0
    for c in [*cuts, len(text)]:
        piece = text[at:c]
        s = at + len(piece) - len(piece.lstrip())
        e = at + len(piece.rstrip())
        if e > s:
            out.append((lo + s, lo + e))
        at = c
    return out


def sentence_units(documents: DataFrame, key: str = "doc_id", text: str = "text", dictionary: frozenset[str] = frozenset(), units: bool = True) -> DataFrame:
    """doc_id, unit_no (from 0), start_char, end_char, unit: the ordered units of every document. `dictionary` adds words to
    the word lattice; without units, their texts are left out."""
    words = DICTIONARY | dictionary
    docs = once(documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL"), "doc_id")

    def split(batches):
        for x in batches:
            found = [spans(t, words) for t in x["text"]]
            n = [len(f) for f in found]
            both = np.array([s for f in found for s in f], np.int32).reshape(-1, 2)
            out = {"doc_id": x["doc_id"].to_numpy().repeat(n), "unit_no": np.concatenate([np.arange(k) for k in n] or [[]]).astype(np.int32), "start_char": both[:, 0], "end_char": both[:, 1]}
            if units:
                out["unit"] = pd.Series([t[a:b] for t, f in zip(x["text"], found, strict=True) for a, b in f], dtype=object)
            yield pd.DataFrame(out)

    return docs.mapInPandas(split, SCHEMA if units else SCHEMA.removesuffix(", unit string"))
