"""References, contexts and accounting of generated answers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumac.functions.columns import REFERENCE_JOIN, number_or_null
from sumac.operators.search import top

METRICS = [("faithfulness", True, False), ("factual_correctness_precision", False, True), ("factual_correctness_recall", False, True)]


def reference_order() -> list[Column]:
    return [F.desc("rel"), F.desc("score"), F.desc(F.col("doc_id").try_cast("bigint")), F.desc("doc_id")]


def ranked_references(qrels: DataFrame, answers: DataFrame, least: int = 2) -> DataFrame:
    """qid, doc_id, rel, score, text, r: judged answers from grade least on, best first."""
    a = answers.select(F.col("id").alias("doc_id"), "score", F.col("body_text").alias("text"))
    return top(qrels.filter(F.col("rel") >= least).join(a, "doc_id"), ["qid"], reference_order(), None, "r")


def references(qrels: DataFrame, answers: DataFrame, most: int = 5) -> DataFrame:
    """One row a topic: joined text, ids used, grade 3 available and used, whether grade 2 had to fill."""
    r = ranked_references(qrels, answers)
    used = F.col("r") <= most
    out = r.groupBy("qid").agg(
        F.count_if(F.col("rel") == 3).alias("n_high_available"),
        F.count_if(used & (F.col("rel") == 3)).alias("n_high_used"),
        F.max(F.when(used & (F.col("rel") == 2), True).otherwise(False)).alias("fallback_used"),
        F.sort_array(F.collect_list(F.when(used, F.struct("r", "doc_id", "text")))).alias("rows"),  # at most `most` a topic
    )
    return out.select("qid", F.array_join(F.transform("rows", lambda x: F.coalesce(x.text, F.lit(""))), REFERENCE_JOIN).alias("reference_text"), F.transform("rows", lambda x: x.doc_id).alias("answer_ids_used"), "n_high_available", "n_high_used", "fallback_used")


def oracle_contexts(qrels: DataFrame, answers: DataFrame, k: int = 5, disjoint: bool = False, most: int = 5) -> DataFrame:
    """qid, position, doc_id: the reference answers themselves, or the next k of grade 3 after them."""
    r = ranked_references(qrels, answers)
    if disjoint:
        r = top(r.filter("rel = 3"), ["qid"], [F.asc("r")], None, "h").filter(F.col("h").between(most + 1, most + k)).withColumn("position", F.col("h") - most)
    else:
        r = r.filter(F.col("r") <= min(k, most)).withColumn("position", F.col("r"))
    return r.select("qid", "position", "doc_id")


def run_contexts(run: DataFrame, answers: DataFrame, k: int = 5) -> DataFrame:
    """qid, contexts: texts of a run's first k by its rank column; missing answers are skipped."""
    a = answers.select(F.col("id").alias("doc_id"), F.col("body_text").alias("text")).filter("text IS NOT NULL")
    hits = run.filter(F.col("rank") <= k).join(a, "doc_id")
    return hits.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "text"))), lambda x: x.text).alias("contexts"))


def contexts(source: str, topics: DataFrame, run: DataFrame | None = None, qrels: DataFrame | None = None, answers: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Context source by name: none, run, reference or disjoint; arguments a source needs are checked."""
    if source == "none":
        return topics.select("qid", F.array().cast("array<string>").alias("contexts"))
    if answers is None or (run if source == "run" else qrels) is None:
        raise ValueError(f"context source {source} lacks its inputs")
    if source == "run":
        return run_contexts(run, answers, k)
    if source in ("reference", "disjoint"):
        o = oracle_contexts(qrels, answers, k, source == "disjoint").withColumnRenamed("position", "rank")
        return run_contexts(o, answers, k)
    raise ValueError(f"unknown context source {source}")


def applicable(spark, metrics: list[tuple[str, bool, bool]] = METRICS) -> DataFrame:
    return spark.createDataFrame(metrics, "metric string, requires_context boolean, requires_reference boolean")


def tasks(generations: DataFrame, references: DataFrame, metrics: DataFrame) -> DataFrame:
    """gen_id, metric for every metric whose needs a record meets; what does not apply is skipped, not 0."""
    g = generations.join(references.select(F.col("qid").alias("topic_id"), "reference_text"), "topic_id", "left").crossJoin(F.broadcast(metrics))  # a fixed table
    return g.filter((~F.col("requires_context") | (F.size("contexts") > 0)) & (~F.col("requires_reference") | F.col("reference_text").isNotNull())).select("gen_id", "metric")


def accounting(scores: DataFrame, by: list[str], value: str = "value", refusal: str = "is_refusal") -> DataFrame:
    """Coverage, selective mean, composite with refusals as 0, and their drift."""
    v, r = F.col(value), F.coalesce(F.col(refusal), F.lit(False))
    a = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(~r).alias("n_answered"), F.avg(F.when(~r, v)).alias("s"), F.avg(F.when(r, 0.0).otherwise(v)).alias("c"), F.count(v).alias("n_scored"))
    cover = F.col("n_answered") / F.col("n")
    return a.select(*by, "n", "n_answered", "n_scored", F.round(cover, 6).alias("coverage"), F.round("s", 6).alias("selective"), F.round("c", 6).alias("composite"), F.round(F.abs(F.col("s") * cover - F.col("c")), 6).alias("drift"))


def claim_ratios(claims: DataFrame, by: list[str]) -> DataFrame:
    """claims (by, side, supported): precision over the response's claims, recall over the reference's, faithfulness over the context's."""
    share = lambda side: F.round(F.avg(F.when(F.col("side") == side, F.col("supported").cast("double"))), 6)
    return claims.groupBy(*by).agg(share("response").alias("precision"), share("reference").alias("recall"), share("context").alias("faithfulness"))


def matched_subset(scores: DataFrame, subset: DataFrame, keys: list[str], by: list[str], value: str) -> DataFrame:
    """Means over all rows and over the subset, and their difference; the subset must lie in the population."""
    s = scores.join(subset.select(*keys, F.lit(True).alias("in_subset")), keys, "left")
    a = s.groupBy(*by).agg(F.avg(value).alias("a"), F.avg(F.when(F.col("in_subset"), F.col(value))).alias("m"), F.count_if(F.col("in_subset")).alias("n_matched"))
    return a.select(*by, F.round("a", 6).alias("mean_all"), F.round("m", 6).alias("mean_matched"), "n_matched", F.round(F.col("m") - F.col("a"), 6).alias("delta"))


def inside(subset: DataFrame, population: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the subset that the population lacks; must be empty."""
    return subset.join(population, keys, "left_anti")


def cacheable(attempts: Column) -> Column:
    """Only if every attempt failed validation."""
    return (F.size(attempts) > 0) & F.forall(attempts, lambda x: x.is_validation)


def generate(prompts: DataFrame, model, column: str = "prompt") -> DataFrame:
    """Hook of a generator or judge: model is a function of a list of prompts, called a batch at a time on the executors."""
    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return pd.Series(model(list(s)), index=s.index)

    return prompts.select("*", f(F.col(column)).alias("response"))


def parsed_scores(raw: DataFrame, columns: list[str]) -> DataFrame:
    return raw.select(*[c for c in raw.columns if c not in columns], *[number_or_null(F.col(c)).alias(c) for c in columns])


def judge_messages(pairs: DataFrame, template: str, system: str | None = None, shots: list[dict] | None = None, assistant: str = "assistant") -> DataFrame:
    """pairs with messages, an array of (role, content): the system turn, two turns for each worked example (question,
    answer, reasoning, label), the pair's own turn. template holds {question} and {answer_text}; a null text is empty."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    fixed = [turn("system", F.lit(system))] if system else []
    for x in shots or []:
        fixed.append(turn("user", F.lit(template.replace("{question}", x["question"]).replace("{answer_text}", x["answer"]))))
        fixed.append(turn(assistant, F.lit(f"{x['reasoning']}\nLABEL: {x['label']}")))
    parts = re.split(r"(\{question\}|\{answer_text\})", template)
    text = [F.coalesce(F.col(p[1:-1]), F.lit("")) if p in ("{question}", "{answer_text}") else F.lit(p) for p in parts if p]
    return pairs.withColumn("messages", F.array(*fixed, turn("user", F.concat(*text))))


def prompt_of(messages: Column) -> Column:
    """Messages as one text for models without roles."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m.role, F.lit(": "), m.content)), "\n\n")
