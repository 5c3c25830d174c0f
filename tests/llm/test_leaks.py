"""Leaks against brute force; Myers' distance against the textbook recurrence."""

import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from sumac.llm.leaks import find_leaks, leak_report, myers
from sumac.llm.words import words


def distance(p, t):
    """Least edits between p and any stretch of t."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b or a == 0)))
        row = new
    return min(row)


@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), min_size=1, max_size=16))
def test_myers(p, t):
    assert myers(np.array([p], np.uint64), np.array([t], np.uint64))[0] == distance(p, t)


def test_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.randint(5, 40)))) for k in range(12)]
    docs = []
    for k in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(0, 30))]
        if k % 2:
            p = r.choice(items)[1].split()
            at = r.randrange(len(p))
            p = p[at : at + 14]
            if k % 3 == 0 and p:
                p[len(p) // 2] = "edited"
            w[5:5] = p
        docs.append((k, " ".join(w), k))
    docs += [(900, None, 0), (901, "", 0), (None, "x", 0), (1, docs[1][1], 5)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame([*items, (50, None), (None, "x y")], "item_id bigint, text string")
    windows = {k: [words(t)[a : a + 12] for a in range(len(words(t)) - 11)] for k, t in items}
    want = {}
    for k, t, _ in docs:
        if k is not None and t:
            for item, ws in windows.items():
                best = min((distance(x, words(t)) for x in ws), default=9)
                if best <= 1:
                    want[k, item] = best
    for block in (2_000_000, 40):
        got = {(x.doc_id, x.item_id): x.distance for x in find_leaks(d, i, 12, 1, block).collect()}
        assert {k: v for k, v in got.items() if v == 0} == {k: v for k, v in want.items() if v == 0}
        assert got == want
    assert {(x.doc_id, x.item_id) for x in find_leaks(d, i, 12, 0).collect()} == {k for k, v in want.items() if v == 0}
    assert find_leaks(d, i.limit(0)).count() == 0 and leak_report(find_leaks(d.limit(0), i)).count() == 0
