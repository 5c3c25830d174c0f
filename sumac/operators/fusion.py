"""Fusion and reranking of runs (run, qid, doc_id, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sumac.operators.search import top
from sumac.runtime import broadcast_if_small


def ranked(runs: DataFrame, depth: int | None = None) -> DataFrame:
    """rank within (run, qid) by score, then document."""
    return top(runs, ["run", "qid"], [F.desc("score"), F.asc("doc_id")], depth)


def minmax(score: Column, by: list[str]) -> Column:
    """Scores of a group to 0..1; all equal gives 0.5."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi == lo, F.lit(0.5)).otherwise((score - lo) / (hi - lo))


def _cut(df: DataFrame, depth: int | None, digits: int = 9) -> DataFrame:
    df = df.select("qid", "doc_id", F.round("score", digits).alias("score"))
    return top(df, ["qid"], [F.desc("score"), F.asc("doc_id")], depth)


def rrf(runs: DataFrame, k: int = 60, depth: int | None = None, weights: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion, weighted by run where weights (run, weight) are given."""
    r = ranked(runs)
    part = F.lit(1.0) / (F.col("rank") + k)
    if weights is not None:
        r = r.join(broadcast_if_small(weights, 100_000), "run")
        part = part * F.col("weight")
    return _cut(r.groupBy("qid", "doc_id").agg(F.sum(part).alias("score")), depth)


def combsum(runs: DataFrame, depth: int | None = None, mnz: bool = False) -> DataFrame:
    """Sum of min-max scores; mnz times the number of runs that hold the document."""
    r = runs.withColumn("s", minmax(F.col("score"), ["run", "qid"]))
    total = F.sum("s") * F.count(F.lit(1)) if mnz else F.sum("s")
    return _cut(r.groupBy("qid", "doc_id").agg(total.alias("score")), depth)


def overlap(runs: DataFrame) -> DataFrame:
    """qid, n_any, n_all, share: documents in all channels over documents in any."""
    n = runs.select("run").distinct().agg(F.count(F.lit(1)).alias("n_runs"))
    per = runs.groupBy("qid", "doc_id").agg(F.countDistinct("run").alias("k"))
    return per.crossJoin(F.broadcast(n)).groupBy("qid").agg(F.count(F.lit(1)).alias("n_any"), F.count_if(F.col("k") == F.col("n_runs")).alias("n_all")).withColumn("share", F.round(F.col("n_all") / F.col("n_any"), 6))


def blocked(inner: DataFrame, outer: DataFrame, k: int = 60, depth: int | None = None) -> DataFrame:
    """Fuse the inner runs first, then their result with the outer ones."""
    one = rrf(inner, k).select(F.lit("block").alias("run"), "qid", "doc_id", "score")
    return rrf(outer.select("run", "qid", "doc_id", "score").unionByName(one), k, depth)


def rerank(candidates: DataFrame, similarity: DataFrame, alpha: float = 0.5, pool: int = 100, how: str = "mean") -> DataFrame:
    """candidates (qid, doc_id, score, rank) blended with the best similarity per topic formula.

    similarity: qid, formula, doc_id, sim. The pool's text and formula scores are min-max scaled and mixed; the tail
    keeps its order after the pool; topics without similarities are unchanged."""
    best = similarity.groupBy("qid", "doc_id", "formula").agg(F.max("sim").alias("sim"))
    n = similarity.groupBy("qid").agg(F.countDistinct("formula").alias("n_formulas"))
    score = {"mean": F.sum("sim") / F.first("n_formulas"), "max": F.max("sim"), "sum": F.sum("sim")}[how]
    formula = best.join(n, "qid").groupBy("qid", "doc_id").agg(score.alias("formula_score"))
    c = candidates.withColumn("in_pool", F.col("rank") <= pool).join(formula, ["qid", "doc_id"], "left").join(n.select("qid", F.lit(True).alias("has")), "qid", "left")
    c = c.withColumn("fs", F.coalesce("formula_score", F.lit(0.0)))
    text, form = minmax(F.col("score"), ["qid", "in_pool"]), minmax(F.col("fs"), ["qid", "in_pool"])
    c = c.withColumn("blend", F.when(F.col("in_pool") & F.col("has"), F.round(F.lit(1 - alpha) * text + F.lit(alpha) * form, 9)))
    return top(c, ["qid"], [F.desc("in_pool"), F.desc_nulls_last("blend"), F.asc("rank")], None, "new_rank").select("qid", "doc_id", "rank", "new_rank", "blend")


def churn(reranked: DataFrame, pool: int) -> DataFrame:
    """Changes, mean shift and Spearman's rho between the two ranks of each topic's pool."""
    p = reranked.filter(F.col("rank") <= pool)
    d = F.col("rank") - F.col("new_rank")
    n = F.count(F.lit(1)).cast("double")
    return p.groupBy("qid").agg(
        F.count_if(d != 0).alias("n_changed"),
        F.round(F.avg(F.abs(d)), 6).alias("mean_shift"),
        F.round(F.when(n > 1, F.lit(1.0) - F.lit(6.0) * F.sum(d * d) / (n * (n * n - 1))).otherwise(F.lit(1.0)), 6).alias("rho"),
    )


def no_op(pool: DataFrame, similarity: DataFrame, churned: DataFrame, coverage: float = 40.0, topics: float = 50.0, rho: float = 0.98, spread: float = 0.01) -> DataFrame:
    """Whether reranking can do nothing: percent of a topic's pool with similarities, percent of topics with any, mean rho, mean
    range of the best similarities within a topic, and the verdict, true if any of them is beyond its threshold.

    pool: qid, doc_id of the candidates; churned: one row a topic that was reranked, with rho."""
    best = similarity.groupBy("qid", "doc_id").agg(F.max("sim").alias("sim"))
    per = pool.join(best, ["qid", "doc_id"], "left").groupBy("qid").agg(F.avg(F.col("sim").isNotNull().cast("int")).alias("c"), (F.max("sim") - F.min("sim")).alias("s"))
    a = per.agg(F.round(F.avg("c") * 100, 6).alias("coverage"), F.round(F.avg(F.col("s").isNotNull().cast("int")) * 100, 6).alias("topic_coverage"), F.round(F.coalesce(F.avg("s"), F.lit(0.0)), 6).alias("mean_spread"))
    b = churned.agg(F.round(F.coalesce(F.avg("rho"), F.lit(1.0)), 6).alias("mean_rho"))
    verdict = (F.col("coverage") < coverage) | (F.col("topic_coverage") < topics) | (F.col("mean_rho") > rho) | (F.col("mean_spread") < spread)
    return a.crossJoin(F.broadcast(b)).select("*", verdict.alias("no_op"))  # one row each
