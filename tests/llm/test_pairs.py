"""Defects of pairs, one rule at a time."""

import pytest

import refusal_wordings as wordings
from sumac.llm.pairs import broken_pairs, defect_report, defects, is_refusal, language

Q = "How to show that the filtered part of the field is controlled by $r$\n\nBy choosing a basis, every graded eigenvalue is closed under limits. Can somebody give a hint?"
FINE = [
    "Yes.", "$x = 0$.", "It is 7.", "No.",
    "By symmetry the ring is closed. $$x^2$$",
    "We only need the bound. Q.E.D.", "It is monic of degree five. $\\blacksquare$",
    "I cannot answer part (c), but parts (a) and (b) are as follows. The ring is closed.",
    'It would be wrong to claim "The provided context does not contain enough information to answer this question." here. The ring is closed.',
    Q + "\n\nThe kernel is closed by the second lemma, and hence the field is controlled. Every ideal is maximal in it, as we have seen before.",
    "The code follows.\n\n```python\nx = 1\n```",
]
BROKEN = [
    (None, "empty"), ("", "empty"), (" \u200b", "empty"), ("...", "empty"), ("<p></p>", "empty"), ("Answer:", "empty"), ("**Answer:**\n\n", "empty"), ("N/A", "empty"), ("```\n```", "empty"), ("$$ $$", "empty"), ("null", "empty"),
    ("The provided context does not contain enough information to answer this question.", "refusal"), ("I'm sorry, but I cannot answer this from the passages given.", "refusal"), ("Hmm. I won't be able to solve this one for you.", "refusal"), ("Leider kann ich diese Frage anhand des Kontexts nicht beantworten.", "refusal"), ("Désolé, je ne peux pas répondre à cette question avec ce contexte.", "refusal"), ("Lo siento, no puedo responder a esta pregunta.", "refusal"), ("抱歉，我无法回答这个问题。", "refusal"),
    (Q, "copies_question"), (Q.upper(), "copies_question"), ("Question: " + Q + "\n\nAnswer:", "copies_question"), ("Thanks for your question. " + Q, "copies_question"),
    ("Wir zeigen nun, dass die Folge von Beldra konvex ist und der Ring nicht kompakt ist.", "other_language"), ("如果映射是闭的，那么范数作用在环上。", "other_language"), ("Так как норма непрерывна, то решётка действует на кольце.", "other_language"),
    ("The ring is closed. Therefore, by", "truncated"), ("Hence we obtain $\\binom{42}{11 \\cdot \\frac{", "truncated"), ("Here is a script:\n\n```python\nfor i in range(7):\n    total += a[i] *", "truncated"), ("Proceed as follows:\n\n1. completing the square;\n2. ", "truncated"), ("One more remark on the ideal (which is absolutely convergent", "truncated"),
]


@pytest.mark.parametrize("response", FINE)
def test_fine(response):
    assert defects(Q, response) == []


@pytest.mark.parametrize(("response", "kind"), BROKEN)
def test_broken(response, kind):
    assert defects(Q, response)[:1] == [kind]


def test_language_of_quotations():
    assert language("Zarkinsky calls this „Für die Abbildung gilt das nicht und so weiter“ in the original, and the rest of it is clear.") == "en"
    assert language("") == "" and language(None) == "" and defects(None, "Yes.") == []


def test_frames(spark):
    rows = [(1, Q, "", 0, "c"), (1, Q, "", 0, "c"), (2, None, "word " * 30_000 + ".", 0, "c"), (3, Q, None, 1, None), (None, Q, None, 1, None)]
    g = spark.createDataFrame(rows, "gen_id bigint, question string, response string, defect_type int, config_name string")
    found = broken_pairs(g.select("gen_id", "question", "response", "config_name"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, "empty", 1), (3, "empty", 1)]
    assert {r.config_name: (r.n_records, r.n_empty) for r in defect_report(found, g).collect()} == {"c": (2, 1), None: (2, 1)}
    assert broken_pairs(g.limit(0)).count() == 0


def scores(refusals, answers):
    found, wrong = sum(map(is_refusal, refusals)), sum(map(is_refusal, answers))
    return found / len(refusals), found / (found + wrong)


def test_refusals_in_wordings_that_are_not_in_the_data():
    for part in (slice(0, None, 2), slice(1, None, 2)):
        recall, precision = scores(wordings.REFUSALS[part], wordings.ANSWERS[part])
        assert recall >= 0.95 and precision >= 0.95
    recall, precision = scores(wordings.END_REFUSALS, wordings.END_ANSWERS)
    assert recall >= 0.5 and precision >= 0.9
