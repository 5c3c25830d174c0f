"""Retrieval evaluation: graded and judged-only measures, holes, pools, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sumac.operators.search import top
from sumac.runtime import broadcast_if_small

RELEVANT = 2


def trec_order(run: DataFrame, by: list[str], depth: int | None = None) -> DataFrame:
    """Rank by score, ties by document id as string, both descending."""
    return top(run, by, [F.desc("score"), F.desc(F.col("doc_id").cast("string"))], depth)


def judged_only(run: DataFrame, qrels: DataFrame) -> DataFrame:
    return run.join(qrels.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")


def holes(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Unjudged documents of the top k (run must be ranked)."""
    return run.filter(F.col("rank") <= k).join(qrels.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti")


def hole_rate(run: DataFrame, qrels: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Unjudged over returned within the top k of each query; k must be positive."""
    if k <= 0:
        raise ValueError("k must be positive")
    j = run.filter(F.col("rank") <= k).join(qrels.select("qid", "doc_id", F.lit(1).alias("judged")), ["qid", "doc_id"], "left")
    return j.groupBy(*by).agg(F.round(F.avg(F.when(F.col("judged").isNull(), 1.0).otherwise(0.0)), 6).alias("hole_rate"))


def ideal(qrels: DataFrame, cutoffs: tuple[int, ...]) -> DataFrame:
    """qid, n_rel, n_judged and the ideal DCG at each cutoff, over all judged grades of a topic."""
    r = top(qrels.filter("rel IS NOT NULL"), ["qid"], [F.desc("rel"), F.asc("doc_id")], None, "i")
    return r.groupBy("qid").agg(
        F.count_if(F.col("rel") >= RELEVANT).alias("n_rel"),
        F.count_if(F.col("rel") < RELEVANT).alias("n_non"),
        *[F.sum(F.when(F.col("i") <= k, F.col("rel") / F.log2(F.col("i") + F.lit(1.0))).otherwise(0.0)).alias(f"idcg_{k}") for k in cutoffs],
    )


def measures(run: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = (5, 10, 20, 100, 1000), prime: bool = False, depth: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One row a query of qrels that the run answers: nDCG, precision, recall, MAP at the cutoffs, MAP, bpref.

    prime drops unjudged documents before ranking; depth cuts the run before that. by: further keys of the run."""
    keys = [*by, "qid"]
    if depth:
        run = trec_order(run, keys, depth).drop("rank")
    j = run.join(qrels.filter("rel IS NOT NULL").select("qid", "doc_id", "rel"), ["qid", "doc_id"], "inner" if prime else "left")
    r = trec_order(j, keys).withColumn("is_rel", F.when(F.col("rel") >= RELEVANT, 1).otherwise(0)).withColumn("is_non", F.when(F.col("rel") < RELEVANT, 1).otherwise(0))
    w = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("seen", F.sum("is_rel").over(w)).withColumn("non_above", F.sum("is_non").over(w))
    r = r.join(ideal(qrels, cutoffs), "qid")
    at = lambda x, k: F.sum(F.when(F.col("rank") <= k, x).otherwise(0.0))
    gain = F.coalesce(F.col("rel"), F.lit(0)) / F.log2(F.col("rank") + F.lit(1.0))
    ap = F.when(F.col("is_rel") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)
    least = F.least("n_rel", "n_non")
    bp = F.when((F.col("is_rel") == 1) & (least > 0), F.lit(1.0) - F.least("non_above", "n_rel") / F.when(least > 0, least)).when(F.col("is_rel") == 1, 1.0).otherwise(0.0)
    n_rel = F.first("n_rel")
    part = lambda x: F.round(F.when(n_rel > 0, x / n_rel).otherwise(0.0), 6)
    out: list[Column] = []
    for k in cutoffs:
        i = F.first(f"idcg_{k}")
        out += [F.round(F.when(i > 0, at(gain, k) / i).otherwise(0.0), 6).alias(f"ndcg_{k}"), F.round(at(F.col("is_rel"), k) / k, 6).alias(f"p_{k}"), part(at(F.col("is_rel"), k)).alias(f"recall_{k}"), part(at(ap, k)).alias(f"map_{k}")]
    return r.groupBy(*keys).agg(*out, part(F.sum(ap)).alias("map"), part(F.sum(bp)).alias("bpref"))


def macro(per_query: DataFrame, names: list[str], qrels: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over evaluated queries, or over all topics of qrels with missing ones as 0."""
    if qrels is not None:
        topics = qrels.select("qid").distinct()
        if by:
            topics = topics.crossJoin(broadcast_if_small(per_query.select(*by).distinct(), 100_000))  # all topics of all runs are the result
        per_query = topics.join(per_query, [*by, "qid"], "left")
        means = [F.round(F.avg(F.coalesce(F.col(n), F.lit(0.0))), 6).alias(n) for n in names]
    else:
        means = [F.round(F.avg(n), 6).alias(n) for n in names]
    return per_query.groupBy(*by).agg(F.count(F.lit(1)).alias("n_queries"), *means)


def long_form(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys, metric, value."""
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select(*keys, "m.*")


def overlay(human: DataFrame, judge: DataFrame) -> DataFrame:
    """Human labels, and the judge's where there is none."""
    return human.select("qid", "doc_id", "rel").unionByName(judge.join(human, ["qid", "doc_id"], "left_anti").select("qid", "doc_id", "rel"))


def pool(runs: DataFrame, depth: int) -> DataFrame:
    """qid, doc_id, n_runs of all documents in the top depth of any run."""
    return trec_order(runs, ["run", "qid"], depth).groupBy("qid", "doc_id").agg(F.countDistinct("run").alias("n_runs"))


def audit(run: DataFrame, human: DataFrame, judge: DataFrame, depth: int = 20) -> DataFrame:
    """Top documents with both labels and whether the human one is missing."""
    r = run.filter(F.col("rank") <= depth)
    r = r.join(human.select("qid", "doc_id", F.col("rel").alias("human_label")), ["qid", "doc_id"], "left")
    return r.join(judge.select("qid", "doc_id", F.col("rel").alias("llm_label")), ["qid", "doc_id"], "left").withColumn("is_hole", F.col("human_label").isNull())


def conflicts(labels: DataFrame) -> DataFrame:
    """Pairs that got more than one label, with the least and greatest."""
    return labels.filter("rel IS NOT NULL").groupBy("qid", "doc_id").agg(F.min("rel").alias("least"), F.max("rel").alias("most"), F.count(F.lit(1)).alias("n")).filter("least <> most")


def calibrate(ours: DataFrame, published: DataFrame, tolerance: float = 0.0005) -> DataFrame:
    """metric, value, published, within tolerance."""
    return ours.join(published, "metric").select("metric", "value", "published", (F.abs(F.col("value") - F.col("published")) <= tolerance).alias("ok"))
