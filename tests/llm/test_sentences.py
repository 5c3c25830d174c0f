"""Sentence units by script."""

import random
import time

import pytest

from sumac.llm import sentences
from sumac.llm.sentences import THAI_PRIOR, WIDE_PRIOR, gap_score, lattice, sentence_units, spans

CASES = [
    ["It is so.", "Is it?", "Yes!"],
    ["Prof. Lompra and Dr. Dwetor proved it, i.e. they showed that $a. B$.", "See e.g. Sec. 3.2 of the notes."],
    ["It works for groups, rings, etc.", "Well... the ring might be closed.", "The seminar starts at 9 a.m. and ends at 5 p.m.", "$x$ is closed."],
    ['Bel wrote "Is it closed? I doubt it." and moved on.', 'She said "It is closed."', "He concluded that “it is. Nothing works.” in a note."],
    ["(The ring is closed.)", "The work of B. J. Pelpra covers lemma86.tex, version 1.2.3.", "By No. 255 in vol. 207, p. 254, it is 4.5."],
    ["Das 12. Beispiel stammt von T. Wexven.", "Die Folge gilt z. B. für $x$.", "Prof. Jol bewies am 21. März, dass es usw. gilt.", "Welch ein Beweis!"],
    ["Voir p. 24, éq. 3.1, où M. Narqui l'a écrit.", "Camtorov a écrit « Est-ce nul ? J'en doute. » avant de conclure.", "Quelle belle preuve !", "La fonction se factorise, p. ex. par la courbe."],
    ["El espectro se factoriza, p. ej. por la matriz.", "¿Es igual?", "Dwe escribió «¿Es trivial? Lo dudo.» y siguió adelante."],
    ["По условию мера и т. д. не меняется, т. е. выполнено $x$.", "Ошибка ок. 2,5 процента."],
    ["man sieht leicht, dass es gilt, z. b. für $x$.", "prof. hal bewies es am 4. märz.", "it is so."],
    ["RECALL THAT IT IS CLOSED.", "BY RESTRICTING, IT IS SO."],
    ["क्या माप संहत है?", 'Lom ने लिखा, "क्या माप संवृत है? मुझे संदेह है।" और आगे बढ़ गए।', "डॉ. Cam के अनुसार यह संवृत नहीं है।"],
    ["هل الزمرة مستمرة؟", "سأل Ost «هل الدالة محدودة؟ أشك في ذلك.» ثم تابع."],
]


@pytest.mark.parametrize("units", CASES)
def test_spaced_scripts(units):
    for gap in (" ", "  ", "\n"):
        text = gap.join(units)
        assert [text[a:b] for a, b in spans(text)] == units


def test_spaceless_scripts():
    units = ["商空间是闭的吗？", "Lon问：“映射是闭的吗？我不信。”然后继续计算。", "注意第3.4节中的映射不是闭的……至少现在不是。", "体は連続なのか？", "Tasは「体は閉か？疑わしい。」と書いて計算を続けた。"]
    text = "".join(units)
    assert [text[a:b] for a, b in spans(text)] == units
    thai = "ถ้า $x$ แล้วริงจะกระทำ เส้นโค้งนั้นชัดแจ้งจริงหรือไม่\nเราจะแสดงว่า"
    assert [thai[a:b] for a, b in spans(thai)] == ["ถ้า $x$ แล้วริงจะกระทำ", "เส้นโค้งนั้นชัดแจ้งจริงหรือไม่", "เราจะแสดงว่า"]
    assert gap_score("ต่าง", "ๆ", THAI_PRIOR) < 0 < gap_score("หรือไม่", "ถ้า", WIDE_PRIOR) and gap_score("ก", "ข", WIDE_PRIOR) < 0 < gap_score("ก", "ข", THAI_PRIOR)
    assert "".join(lattice("以上より環は閉である")) == "以上より環は閉である" and "以上より" in lattice("以上より環")


HELD_OUT = [
    ["It costs $5.", "He paid $6."], ["Lt. Col. Smith came.", "He left."], ["Gen. Lee won.", "Then he left."], ["See Jan. 5 for it.", "It was in Jan.", "He left."], ["Op. 12 is short.", "Next."],
    ["Los EE. UU. ganaron.", "Luego."], ["Acme Corp. announced it.", "Good."], ["The answer is no.", "We go on."], ["I like art.", "He does not."], ["Mt. Everest is high.", "So."],
    ["He lives in the U.S. and works.", "Yes."], ["He (i.e. Bob) left!", "(Really.)", "And then?"], ["The price is $3.50.", "It fell."], ["Is $x$ closed?", "$y$ is."],
    ["我们去了商店", "他买了苹果"], ["昨日は店に行きました", "彼は林檎を買った"], ["我们 的书"], ["この本は面白い とても"],
]


@pytest.mark.parametrize("units", HELD_OUT)
def test_wordings_that_are_not_in_the_data(units):
    text = " ".join(units)
    assert [text[a:b] for a, b in spans(text)] == units


def test_the_word_lattice_decides(monkeypatch):
    text, quote = "我们去了商店 他买了苹果", "她说：“走吧。我不信。”因此我们没有走。"
    assert len(spans(text)) == 2 and len(spans("甲乙 丙丁", frozenset({"丙丁"}))) == 1
    with_lattice = spans(quote)
    monkeypatch.setattr(sentences, "lattice", lambda text, words=None: list(text))
    assert len(spans(text)) == 2 and spans(quote) != with_lattice  # 他 is one character, 因此 two


@pytest.mark.parametrize("part", ["“", '"a. ', "! ", "!a", " ", "\r", "\\(", "$ a ", "\n", "a", "“a. „b! «c? "])
def test_a_megabyte_takes_seconds(part):
    text = part * (1_000_000 // len(part))
    start = time.process_time()
    spans(text)
    assert time.process_time() - start < 12


def test_blocks_and_offsets():
    text = "Rigid lattice\n\n  It is\nso.  Then \n \nEnd without mark"
    assert [text[a:b] for a, b in spans(text)] == ["Rigid lattice", "It is\nso.", "Then", "End without mark"]
    assert spans(None) == [] and spans("") == [] and spans(" \n\n ") == []


def test_frames(spark):
    rows = [(1, "A ring. So it is.", 0), (1, "A ring. So it is.", 0), (2, None, 0), (3, "", 0), (4, "It is so. " * 20_000, 0)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, unit_no int")
    n = {r.doc_id: r["count"] for r in sentence_units(d).groupBy("doc_id").count().collect()}
    assert n == {1: 2, 4: 20_000} and sentence_units(d.limit(0)).count() == 0


def test_later_marks_revise_an_early_cut():
    for units in (["It holds for approxx. the ring is closed.", "Then it is so."], ["it holds for approxx.", "the ring is closed.", "then it is so."], ["What ? !", "Yes."]):
        text = " ".join(units)
        assert [text[a:b] for a, b in spans(text)] == units


def test_starts_held_as_one_lose_no_path(monkeypatch):
    r = random.Random(1)
    parts = ["The", "ring", "approxx.", "etc.", "e.g.", "usw.", "N.", "x.", "12.", "am", "RING", "CLOSED.", "is?", "!", "so.", '"Is it?"', "(so.)", "Then", "...", "$x$."]
    texts = [" ".join(r.choices(parts, k=r.randint(3, 25))) for _ in range(300)]
    found = [spans(t) for t in texts]
    monkeypatch.setattr(sentences._Start, "state", lambda self, at: (id(self),))
    assert [spans(t) for t in texts] == found
