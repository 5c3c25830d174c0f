"""Sizes, caps and the fixed-size sample."""

import os

import pytest
from pyspark.sql import functions as F

from sumac.llm import mixing

D = "doc_id bigint, text string, source string, n_tokens int"
M = "source string, target_share double, max_repeats int"
needs_files = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer files")


@needs_files
def test_sizes_and_short_sources(spark):
    rows = [(1, "one two three", " A ", 0), (1, "one two three", " A ", 0), (2, None, "a", 0), (3, "x " * 100, "B", 0), (4, "x", None, 0), (5, "x", "  ", 0), (6, "word " * 30_000, "c", 0)]
    docs = mixing.sized(spark.createDataFrame(rows, D))
    got = {r.doc_id: (r.source, r.n_tokens) for r in docs.collect()}
    assert got[1] == ("a", 3) and got[2] == ("a", 0) and set(got) == {1, 2, 3, 6}
    cap = mixing.capacity(docs, spark.createDataFrame([("a ", 0.5, 2), ("none", 0.1, 9), ("C", 0.4, 1)], M))
    assert {r.source for r in mixing.short_sources(mixing.allot(docs, cap)).collect()} == {"a", "none"}
    empty = mixing.sized(spark.createDataFrame([], D))
    assert {r["size"] for r in mixing.capacity(empty, spark.createDataFrame([("a", 1.0, 1)], M)).collect()} == {0}


def sample(spark, n=3000, weight=None, bins=1024, share=(0.5, 0.5), cap=(5, 5)):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), (F.col("id") % 7 + 1).alias("n_tokens"))
    mix = spark.createDataFrame([("a", share[0], cap[0]), ("b", share[1], cap[1])], M)
    weight = F.lit(1.0) if weight is None else weight
    c = mixing.allot(docs, mixing.capacity(docs, mix), weight=weight)
    e = mixing.expected_copies(docs, c, weight=weight)
    return e, mixing.pareto_sample(e, bins=bins), c


def test_fixed_size_and_shares(spark):
    for bins in (1024, 4):
        e, s, c = sample(spark, bins=bins)
        want = {r.source: r.t for r in e.groupBy("source").agg(F.sum("copies").alias("t")).collect()}
        for r in s.groupBy("source").agg(F.sum("times").alias("t"), F.count(F.lit(1)).alias("n")).collect():
            assert r.t == round(want[r.source]) and r.n == (1000 if r.source == "a" else 2000)
        assert s.filter("times < floor(copies) OR times > floor(copies) + 1").count() == 0
        got = {r.source: r.share for r in mixing.shares(s, c).collect()}
        assert abs(got["a"] - 0.5) < 0.02


def test_unequal_probabilities(spark):
    e, s, _ = sample(spark, weight=F.when(F.col("doc_id") % 2 == 0, 1.5).otherwise(0.5), share=(0.1, 0.1))
    r = s.groupBy((F.col("doc_id") % 2).alias("odd"), "source").agg(F.avg("times").alias("got"), F.avg("copies").alias("want")).collect()
    assert len(r) == 4 and all(abs(x.got - x.want) < 0.05 for x in r)


def test_caps_and_empty(spark):
    _, s, c = sample(spark, share=(0.9, 0.1), cap=(2, 1))
    assert {r.times for r in s.filter("source = 'a'").collect()} == {2}
    assert s.limit(0).count() == 0 and mixing.pareto_sample(sample(spark)[0].limit(0)).count() == 0


@needs_files
def test_sources_without_tokens(spark):
    docs = mixing.sized(spark.createDataFrame([(1, None, "a", 0), (2, "", "a", 0)], D))
    cap = mixing.allot(docs, mixing.capacity(docs, spark.createDataFrame([("a", 1.0, 3)], M)))
    s = mixing.pareto_sample(mixing.expected_copies(docs, cap))
    got = mixing.shares(s, cap).collect()
    assert s.count() == 0 and [(r["size"], r.used_tokens, r.share) for r in got] == [(0, 0, 0.0)]


def test_what_a_cap_cuts_off_goes_to_other_documents(spark):
    rows = [(k, "a", 1000 if k < 5 else 10) for k in range(300)] + [(k, "b", 10) for k in range(300, 400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    mix = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 1)], M)
    c = mixing.allot(docs, mixing.capacity(docs, mix))
    e = mixing.expected_copies(docs, c)
    got = {r.source: r.t for r in e.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t")).collect()}
    assert abs(got["a"] - 0.7 * 8950) < 1e-6 and e.filter("doc_id < 5 AND copies = 1").count() == 5 and e.filter("source = 'a' AND copies < 1").count() == 295
    assert got["b"] == 1000 and [r.source for r in mixing.short_sources(c).collect()] == ["b"]
    s = mixing.pareto_sample(e)
    assert all(r.whole_copies_exact and r.size_fixed and r.cap_held and r.share_met for r in mixing.sample_checks(s, c).collect())


def test_longer_documents_are_likelier(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), (F.col("id") % 4 + 1).alias("n_tokens"))
    c = mixing.allot(docs, mixing.capacity(docs, spark.createDataFrame([("a", 0.2, 3)], M)))
    used = {r.n_tokens: r.t for r in mixing.pareto_sample(mixing.expected_copies(docs, c)).groupBy("n_tokens").agg(F.avg("times").alias("t")).collect()}
    assert all(abs(used[k] - k * used[1]) < 0.05 * k for k in used) and used[4] > 3 * used[1]
