"""Reference integrity on small tables against plain Python."""

from datetime import datetime as dt

from sumac.operators.references import ForeignKey, orphan_references, orphan_report

A = "id string, parent_id string, loaded_at timestamp, extra int"
Q = "id string, accepted_answer_id string, accepted_at timestamp, loaded_at timestamp, table_name string"
KEYS = [ForeignKey("answers", "parent_id", "questions"), ForeignKey("questions", "accepted_answer_id", "answers", time="accepted_at")]


def day(n):
    return dt(2020, 1, n)


def run(spark, answers, questions, removed):
    t = {"answers": spark.createDataFrame(answers, A), "questions": spark.createDataFrame(questions, Q)}
    r = spark.createDataFrame(removed, "post_id string, removed_at timestamp")
    return {(x.table_name, x.record_key): (x.ref_state, x.origin, x.depth, x.ref_month) for x in orphan_references(t, KEYS, r).collect()}


def test_states(spark):
    answers = [("a1", " q1.0 ", day(5), 1), ("a2", "q9", day(5), 1), ("a3", "q2", day(1), 1), ("a4", None, day(1), 1), ("a5", " ", day(1), 1), ("a6", "q3", day(9), None), ("a7", "q3", day(2), None)]
    questions = [("q1", None, None, day(1), "x"), ("q2", None, None, day(3), "x"), ("q3", None, None, day(1), "x")]
    got = run(spark, answers, questions, [("q3", day(9)), ("q3", day(12))])
    assert got == {("answers", "a2"): ("missing", "direct", 0, "2020-01"), ("answers", "a3"): ("late", "direct", 0, "2020-01"), ("answers", "a6"): ("deleted", "direct", 0, "2020-01")}


def test_repeated_rows_first_loaded_counts(spark):
    answers = [("a1", "q1", day(2), 1), ("a1", "q9", day(5), 1), ("a1", "q1", day(2), 1)]
    assert run(spark, answers, [("q1", None, None, day(1), None)], []) == {}


def test_cascade_and_cycle(spark):
    answers = [("a1", "gone", day(5), 1), ("a2", "q1", day(5), 1), ("a3", "q2", day(5), 1), ("a4", "q2", day(6), 1)]
    questions = [("q1", "a1", day(6), day(1), "x"), ("q2", "a2", day(6), day(1), "x")]
    got = run(spark, answers, questions, [])
    assert {k: v[:3] for k, v in got.items()} == {("answers", "a1"): ("missing", "direct", 0), ("questions", "q1"): ("inherited", "inherited", 1), ("answers", "a2"): ("inherited", "inherited", 2), ("questions", "q2"): ("inherited", "inherited", 3), ("answers", "a3"): ("inherited", "inherited", 4), ("answers", "a4"): ("inherited", "inherited", 4)}


def test_null_time_and_empty(spark):
    got = run(spark, [], [("q1", "a9", None, day(1), "x"), (None, "a9", day(1), day(1), "x")], [("a9", day(1))])
    assert got == {("questions", "q1"): ("missing", "direct", 0, None)}
    t = {"answers": spark.createDataFrame([], A), "questions": spark.createDataFrame([], Q)}
    empty = orphan_references(t, KEYS, spark.createDataFrame([], "post_id string, removed_at timestamp"))
    assert empty.count() == 0 and orphan_report(empty).count() == 0
