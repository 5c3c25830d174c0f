"""Broken prompt and response pairs: ordered rules, every triggered defect type emitted.

Rules, in order of precedence: emptiness, refusals by structure in sixteen languages (`refusals`), copied question, script or
language mismatch, unclosed delimiters and abrupt endings. `defects` gives all that hold for a record with
their order; the first is its defect. is_refusal and finish_reason are not read.

Defined cases: a null response is empty; a null or blank question can neither be copied nor have a
language; repeated rows of a key count once (the least response, then question); texts of any length
are read whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumac.llm import refusals
from sumac.llm.once import once
from sumac.llm.sentences import ABBREVIATIONS, BLANK, MATH, spans

#: Defect types in order of precedence.
TYPES = ("empty", "refusal", "copies_question", "other_language", "truncated")

#: Labels and placeholders that are no answer.
LABELS = "answer|final answer|the answer|response|reply|solution|result|question|prompt|q|a|antwort|lösung|frage|réponse|solution|respuesta|solución|pregunta|ответ|решение|вопрос|答案|回答|解答|答|问题|質問|解|คำตอบ|الجواب|الإجابة|السؤال|उत्तर|प्रश्न"
LABEL = re.compile(rf"(?im)^[\s>#*_]*(?:{LABELS})[*_]*\s*[:：][*_]*")
BARE = re.compile(rf"(?:{LABELS})", re.I)
PLACEHOLDER = re.compile(r"(?:null|none|n ?a|nan|nil|todo|tbd|undefined|empty|blank|placeholder|no answer|no response|your answer here|insert answer here|x{3,}|lorem ipsum)", re.I)
THANKS = re.compile(r"(?i)\b(?:thanks?(?: you)?(?: (?:very|so) much| a lot)?(?: in advance)?|many thanks|please|hello|hi|dear all|vielen dank(?: im voraus)?|danke(?: schön)?|merci(?: d avance| d'avance| beaucoup)?|gracias(?: de antemano)?|спасибо(?: заранее)?|谢谢|ありがとうございます|どうも)\b")

QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»|「[^」]*」|『[^』]*』")
CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`", re.S)
TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->", re.S)
WORD = re.compile(r"[^\W_]+")

#: Frequent words that tell apart languages of one script.
COMMON = {
    "en": "the of and to is in that we for by this with as it be not are an on from there which then would".split(),
    "de": "der die das und ist von nicht den mit wir ein eine dass für auf gilt so wird wenn durch dem ob man es wo daraus wirklich".split(),
    "fr": "le la les de des et est un une que pour dans on par pas du en qui si avec voir où cas au sur alors quelle".split(),
    "es": "el la los las de y es un una que por en no se del con para si lo como al cuando donde entonces qué caso".split(),
    "it": "il lo gli di che non è una per con del della sono nel anche come questo".split(),
    "pt": "o os as de que não é uma por com do da em são para no na como isso".split(),
    "nl": "de het een van en is dat niet op te voor met zijn aan ook als wordt".split(),
}
COMMON_OF = {w: [k for k, ws in COMMON.items() if w in ws] for ws in COMMON.values() for w in ws}
#: Script ranges; kana decides for Japanese.
SCRIPTS = [("latin", "A-Za-zÀ-ɏ"), ("cyrillic", "Ѐ-ӿ"), ("kana", "぀-ヿ"), ("han", "㐀-鿿"), ("thai", "฀-๿"), ("arabic", "؀-ۿݐ-ݿ"), ("devanagari", "ऀ-ॿ"), ("hangul", "가-힯"), ("greek", "Ͱ-Ͽ"), ("hebrew", "֐-׿")]
SCRIPT_OF = [(name, re.compile(f"[{r}]")) for name, r in SCRIPTS]
#: Letters that names may bring into a text of another script weigh less.
PROPER = re.compile(r"\b[A-Z][a-zà-ÿ]+(?:'s)?\b")


def prose(text: str) -> str:
    """The text without code, formulas, quotations, tags and labels."""
    text = CODE.sub(" ", text)
    text = MATH.sub(" ", text)
    text = re.sub(r"\$[^$]*\Z", " ", text)
    return LABEL.sub(" ", QUOTED.sub(" ", TAG.sub(" ", text)))


def language(text: str | None) -> str:
    """Language or script of a text's prose; empty if it can't be told."""
    if not text:
        return ""
    t = prose(text)
    if t.isascii():
        if len(SCRIPT_OF[0][1].findall(PROPER.sub(" ", t))) < 6:
            return ""
    else:
        n = {name: len(p.findall(t)) for name, p in SCRIPT_OF}
        n["latin"] = len(SCRIPT_OF[0][1].findall(PROPER.sub(" ", t)))
        kana, wide = n["kana"], n["kana"] + n["han"]
        n["han"] = n["kana"] = 0
        n["wide"] = 2 * wide
        top = max(n, key=n.get)
        if n[top] < 6:
            return ""
        if top == "wide":
            return "ja" if kana * 5 > wide else "zh"
        if top != "latin":
            return top
    hits: Counter = Counter()
    for w in WORD.findall(t.lower()):
        for lang in COMMON_OF.get(w, ()):
            hits[lang] += 1 / len(COMMON_OF[w])
    first = hits.most_common(2)
    if not first or first[0][1] < 2 or (len(first) > 1 and first[0][1] < 1.25 * first[1][1]):
        return ""
    return first[0][0]


@lru_cache(maxsize=4096)
def _language(question: str) -> str:
    return language(question)


def is_blank(response: str | None) -> bool:
    if response is None:
        return True
    t = html.unescape(TAG.sub(" ", response))
    t = unicodedata.normalize("NFKC", re.sub(r"^\s*(```|~~~)\w*\s*$", "", t, flags=re.M))
    t = re.sub(r"\\(?:begin|end)\{\w+\*?\}|\\[\[\]()]", " ", t)
    words = " ".join(WORD.findall(t))
    if not words:
        return not re.search(r"[∎∅∞√∑∫±≤≥=<>]\s*\S", t)
    return bool(BARE.fullmatch(words) or PLACEHOLDER.fullmatch(words))


def is_refusal(response: str) -> bool:
    """Every unit of the response refuses or only apologises, and at least one refuses; read block by block up to the first that does not."""
    t = QUOTED.sub(" ", LABEL.sub(" ", CODE.sub(" ", response))).replace("’", "'")

    def units():
        at = 0
        for m in [*BLANK.finditer(t), None]:
            block = t[at : m.start() if m else len(t)]
            yield from (block[a:b] for a, b in spans(block))
            at = m.end() if m else len(t)

    return refusals.is_refusal(units())


@lru_cache(maxsize=4096)
def _plain_question(question: str) -> tuple[tuple[str, ...], frozenset]:
    q = _plain(question)
    return tuple(q), frozenset(_runs(q))


def _plain(t: str) -> list[str]:
    return WORD.findall(THANKS.sub(" ", LABEL.sub(" ", TAG.sub(" ", t))).lower())


def _runs(w: list[str]) -> list[tuple[str, ...]]:
    return list(zip(w, w[1:], w[2:]))


def is_copy(response: str, question: str | None, part: float = 0.5, own: float = 0.1) -> bool:
    """Nothing but the question: at most `own` of the response's runs of three words are its own, and more than `part` of the question's are there."""
    if not question:
        return False
    q, there = _plain_question(question)
    r = _plain(response)
    if len(q) < 3 or len(r) < 3:
        return bool(q) and list(q) == r
    here = _runs(r)
    if sum(x not in there for x in here) > max(own * len(here), 2 if len(here) > 8 else 0):
        return False
    return len(there & set(here)) > part * len(there)


def is_truncated(response: str) -> bool:
    """An open fence, formula, bracket or quotation, or an end that is no end of a sentence."""
    t = response.rstrip("\u200b\ufeff \t\r\n\u00a0")
    for fence in ("```", "~~~"):
        if len(re.findall(rf"(?m)^\s*{fence}", t)) % 2:
            return True
    t = re.sub(r"\s*(?:</\w+>|\*\*|__)+$", "", t)
    closed = re.search(r"(?:```|~~~)$", t) is not None
    bare = CODE.sub("", t)
    if len(re.findall(r"(?<!\\)\$", bare)) % 2 or bare.count("\\(") > bare.count("\\)") or bare.count("\\[") > bare.count("\\]") or len(re.findall(r"\\begin\{", bare)) > len(re.findall(r"\\end\{", bare)):
        return True
    if closed:
        return False
    shown = MATH.sub("\ue000", bare)
    para = re.split(r"\n\s*\n", shown.strip())[-1]
    for a, b in (("«", "»"), ("„", "“"), ("「", "」"), ("『", "』"), ("《", "》")):
        if para.count(a) > para.count(b) + (para.count("”") if a == "„" else 0):
            return True
    if "„" not in para and para.count("“") > para.count("”"):
        return True
    if para.count('"') % 2 or para.rfind("(") > para.rfind(")") or para.rfind("（") > para.rfind("）"):
        return True
    last = para.split("\n")[-1]
    if re.fullmatch(r"\s*(?:\d+[.)]|[-*+•])\s*", last):
        return True
    if not WORD.search(shown):
        return False
    end = shown.rstrip().rstrip("*_`")
    if re.search(r"[.!?…。！？।॥؟۔∎■□]+[\"'”’»“)\]」』）]*$", end):
        if end.endswith("."):
            token = re.search(r"([^\s(\[{\"“«„]+)\.$", end)
            low = token[1].lower() if token else ""
            if low in ABBREVIATIONS and low not in ("no", "sec", "art", "ed", "m", "st", "cap", "ex", "d", "h", "z", "b", "u", "s", "p", "g"):
                return True
            if token and re.fullmatch(r"[A-Z]", token[1]) and re.search(r"\b(?:of|von|de|by|and|und|et|y|из|работы)\s+[A-Z]\.$", end):
                return True
            if re.fullmatch(r"\s*\d+\.", last):
                return True
        return False
    if re.search(r"\ue000\s*$", end):
        tail = t.rstrip()
        before = re.sub(r"[\s\ue000]+$", "", end)
        if re.search(r"\\(?:blacksquare|square|qed|Box)\s*\$+$", tail) or re.search(r"[.!?。！？।؟][\"'”’»“)\]」』）]*$", before):
            return False
        return not (tail.endswith("$$") or tail.endswith("\\]") or len(WORD.findall(shown)) < 4)
    if re.search(r"[\u0e00-\u0e7f]$", end):
        return False  # Thai has no closing mark
    return len(WORD.findall(bare)) >= 4 or bool(re.search(r"[,;:=+*/<(\[{-]$", end))


def defects(question: str | None, response: str | None) -> list[str]:
    """All defect types that hold, in order of precedence."""
    if is_blank(response):
        return ["empty"]
    out = []
    if is_refusal(response):
        out.append("refusal")
    if is_copy(response, question):
        out.append("copies_question")
    a = _language(question) if question else ""
    b = language(response) if a else ""
    if a and b and a != b:
        out.append("other_language")
    if is_truncated(response):
        out.append("truncated")
    return out


def broken_pairs(pairs: DataFrame, key: str = "gen_id", question: str = "question", response: str = "response") -> DataFrame:
    """key, defect_type, precedence: one row per record and triggered type; precedence 1 is the record's defect."""
    one = once(pairs.select(F.col(key).alias("_key"), F.col(response).alias("_r"), F.col(question).alias("_q")), "_key")
    text = lambda t: t if isinstance(t, str) else None

    @F.pandas_udf("array<string>")
    def find(q: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([defects(text(a), text(b)) for a, b in zip(q, r, strict=True)], index=q.index, dtype=object)

    return one.select(F.col("_key").alias(key), F.posexplode(find.asNondeterministic()("_q", "_r")).alias("pos", "defect_type")).select(key, "defect_type", (F.col("pos") + 1).alias("precedence"))


def defect_report(found: DataFrame, pairs: DataFrame, key: str = "gen_id", by: str = "config_name") -> DataFrame:
    groups = pairs.groupBy(key).agg(F.min(by).alias(by))
    return groups.join(found.filter("precedence = 1"), key, "left").groupBy(by).agg(F.count(F.lit(1)).alias("n_records"), *[F.count_if(F.col("defect_type") == t).alias(f"n_{t}") for t in TYPES])
